"""reelgrid: a Spark-native engine for clip annotation data and training corpora."""

__version__ = "0.1.0"
