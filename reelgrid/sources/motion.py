"""Vehicle motion and calibration files as rows that the time series operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators.timeseries import yaw_degrees


def _owner() -> object:
    """The clip that a file belongs to: its name up to the first dot."""
    return F.split(F.col("_metadata.file_name"), r"\.")[0]


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """uuid, frame, t_us of Parquet files of frame times, one for each clip.

    The times are the column timestamp, or the first column where a file has none so named.
    """
    files = spark.read.option("mergeSchema", True).parquet(path)
    names = [c for c in ("timestamp", *files.columns) if c in files.columns]
    return files.select(_owner().alias("uuid"), F.col("_metadata.row_index").alias("frame"), F.coalesce(*[F.col(f"`{c}`").cast("bigint") for c in dict.fromkeys(names)]).alias("t_us"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """uuid, t_us, speed, ax, yaw_deg of documents that hold each clip's samples as arrays, two a second.

    Clips without times give no rows; values that an array lacks are null.
    """
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    clips = docs.select(F.try_variant_get("doc", "$.clips", "map<string,variant>").alias("clips")).select(F.explode("clips").alias("uuid", "v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", f"array<{kind}>")
    each = clips.select("uuid", get("vx", "double").alias("vx"), get("vy", "double").alias("vy"), get("ax", "double").alias("ax"), get("yaw_deg", "double").alias("yaw"), F.posexplode(get("t_us", "bigint")).alias("i", "t_us"))
    at = lambda c: F.get(c, F.col("i"))
    return each.select("uuid", "t_us", F.hypot(at("vx"), at("vy")).alias("speed"), at("ax").alias("ax"), at("yaw").alias("yaw_deg"))


def motion_samples(raw: DataFrame) -> DataFrame:
    """uuid, t_us, speed, ax, curvature, yaw_deg, x, y, z of samples with velocity and rotation (a hundred a second); without time none."""
    return raw.where("timestamp IS NOT NULL").select(
        "uuid", F.col("timestamp").cast("bigint").alias("t_us"), F.hypot("vx", "vy").alias("speed"), "ax", "curvature", yaw_degrees(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")).alias("yaw_deg"), "x", "y", "z"
    )


def read_calibration(spark: SparkSession, intrinsics: str, extrinsics: str) -> DataFrame:
    """uuid, cam, cx, cy, poly (lowest power first), max_angle, width, height and the camera's place: qx to qw, x, y, z.

    Only cameras that both files know; the model of a lens is a JSON text.
    """
    m = lambda path, kind: F.try_variant_get("m", f"$.{path}", kind)
    lens = spark.read.parquet(intrinsics).select("uuid", "cam", F.try_parse_json("model_parameters").alias("m")).where("m IS NOT NULL")
    lens = lens.select("uuid", "cam", m("principal_point[0]", "double").alias("cx"), m("principal_point[1]", "double").alias("cy"), m("angle_to_pixeldist_poly", "array<double>").alias("poly"), m("max_angle", "double").alias("max_angle"), m("resolution[0]", "int").alias("width"), m("resolution[1]", "int").alias("height"))
    place = spark.read.parquet(extrinsics).select("uuid", "cam", *[F.col(c).cast("double") for c in ("qx", "qy", "qz", "qw", "x", "y", "z")])
    return lens.join(place, ["uuid", "cam"])
