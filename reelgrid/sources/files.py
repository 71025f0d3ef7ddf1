"""Reading result tables, label documents, taxonomies, logs and listings; writing them back.

Everything is read as text and cast by name, never with an inferred schema.  Rows keep
the name of their file and their place in it, as several operators depend on that order.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Mapping, Sequence
from pathlib import PurePosixPath
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: columns of a result table, in order
RESULT_COLUMNS = (
    "uuid", "n_frames", "verdict", "n_classes", "classes", "parse_ok", "observation", "ego_behavior",
    "unusual_elements", "group_scores", "score_reason", "tier_score", "ego_speed_kmh", "ego_motion",
    "ego_behavior_measured", "margin_min", "margin_mean", "n_close_tokens", "illumination", "illumination_reason",
    "precipitation", "precipitation_reason", "road_surface", "road_surface_reason", "atmospheric_obscurants",
    "atmospheric_obscurants_reason", "time_spans", "field_scores",
)
# fixed values: former column names
OLD_NAMES = {"categories": "classes", "n_categories": "n_classes", "category_scores": "class_scores", "category": "class"}


def located(df: DataFrame) -> DataFrame:
    """df with file (its name) and pos (growing within a file)."""
    return df.withColumns({"file": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "pos": F.monotonically_increasing_id()})


def read_results(spark: SparkSession, pattern: str, columns: Sequence[str] = RESULT_COLUMNS) -> DataFrame:
    """Result tables (CSV with line breaks and quotes in cells) as text, with file and pos.

    Files may have former column names, lack columns (null) or have more (left out);
    each file's own header decides.
    """
    # one job finds every file's first line; only the files' names and headers come to the driver
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value"), F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("path").agg(F.min_by("value", "at").alias("head")).collect()
    by_header: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(heads, key=lambda r: r.path):
        by_header.setdefault(tuple(next(csv.reader([r.head.lstrip("\ufeff")]))), []).append(r.path)
    parts = []
    for header, paths in by_header.items():
        schema = ", ".join(f"`{h or f'_c{i}'}` string" for i, h in enumerate(header))
        df = located(spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(paths))
        df = df.withColumnsRenamed({o: n for o, n in OLD_NAMES.items() if o in df.columns and n not in df.columns})
        parts.append(df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns], "file", "pos"))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns) + ", file string, pos bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_counts(rows: DataFrame) -> DataFrame:
    """Rows of each file."""
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def _doc(spark: SparkSession, path: str) -> Column:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("doc"))


def read_label_documents(spark: SparkSession, path: str, groups: Sequence[str] = ("Dynamic object", "Driving environment")) -> DataFrame:
    """Labels of JSON documents: file, uuid, classes, class_scores (null where classes is a list), group_scores,
    weather, rain_snow_fog, note, missing (no classes at all).

    Clips stand under 'clips' or at the top; what isn't an object is left out.
    """
    docs = _doc(spark, path).where("doc IS NOT NULL")
    clips = F.coalesce(F.try_variant_get("doc", "$.clips", "variant"), F.col("doc"))
    view = f"_documents_{uuid4().hex}"
    docs.select("file", clips.alias("clips")).createOrReplaceTempView(view)
    each = spark.sql(f"SELECT file, key AS uuid, value AS v FROM {view}, LATERAL variant_explode(clips)").where("schema_of_variant(v) LIKE 'OBJECT%' AND uuid <> '_meta'")
    get = lambda p, t: F.try_variant_get("v", p, t)
    classes = F.coalesce(get("$.classes", "variant"), get("$.categories", "variant"))
    kind = F.schema_of_variant(classes)
    scores = F.when(kind.startswith("OBJECT"), F.try_variant_get(classes, "$", "map<string,int>"))
    names = F.when(kind.startswith("ARRAY"), F.try_variant_get(classes, "$", "array<string>")).otherwise(F.map_keys(scores))
    group = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(g).alias("k"), get(f"$['{g}']", "int").alias("v")) for g in groups]), lambda e: e["v"].isNotNull() & (e["v"] != -1)))
    return each.select("file", "uuid", names.alias("class_list"), scores.alias("class_scores"), group.alias("group_scores"), get("$.weather", "map<string,int>").alias("weather"), get("$.rain_snow_fog", "array<string>").alias("rain_snow_fog"), F.coalesce(get("$.note", "string"), F.lit("")).alias("note"), names.isNull().alias("missing"))


def within_scale(labels: DataFrame, scale: Sequence[int] = range(5)) -> DataFrame:
    """labels whose group scores and class scores off the scale are left out, as for showing them."""
    keep = lambda c: F.map_filter(c, lambda _, v: v.isin(*scale))
    return labels.withColumns({c: keep(c) for c in ("group_scores", "class_scores") if c in labels.columns})


def labels_with(labels: DataFrame, uuid: str) -> DataFrame:
    """The files that label a clip."""
    return labels.where((F.col("uuid") == uuid) & ~F.col("missing")).select("file").distinct()


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """section, group_name, group_pos, class_name, class_pos, is_unknown, templates, recheck_keywords of a taxonomy document, in order."""
    docs = _doc(spark, path).where("doc IS NOT NULL")
    kind = "array<struct<name:string,classes:array<struct<name:string,unknown:boolean,templates:array<string>,recheck_keywords:array<string>>>>>"
    parts = []
    for section in ("normal", "special"):
        groups = docs.select(F.posexplode(F.try_variant_get("doc", f"$.{section}.scenarios", kind)).alias("group_pos", "g"))
        each = groups.select("group_pos", "g.name", F.posexplode("g.classes").alias("class_pos", "c"))
        empty = F.array().cast("array<string>")
        parts.append(each.select(F.lit(section).alias("section"), F.col("name").alias("group_name"), "group_pos", F.col("c.name").alias("class_name"), "class_pos", F.coalesce("c.unknown", F.lit(False)).alias("is_unknown"), F.coalesce("c.templates", empty).alias("templates"), F.coalesce("c.recheck_keywords", empty).alias("recheck_keywords")))
    return parts[0].unionByName(parts[1])


def has_templates(spark: SparkSession, path: str) -> bool:
    """Whether a taxonomy document is of the form whose classes have templates."""
    first = _doc(spark, path).select(F.try_variant_get("doc", "$.special.scenarios[0].classes[0].templates", "variant").isNotNull().alias("has")).first()
    return bool(first and first.has)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one JSON object a line, with file and pos; lines that can't be read, as a cut last one, are left out."""
    lines = located(spark.read.text(path))
    parsed = lines.withColumn("r", F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema)))
    return parsed.where("r IS NOT NULL").select("r.*", "file", "pos")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """uuid and pos of a list file, blank lines left out."""
    return located(spark.read.text(path)).select(F.trim("value").alias("uuid"), "pos").where("uuid <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of text files; progress bars that return to the line's start count as lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split(F.replace("value", F.lit("\r"), F.lit("\n")), "\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("pos", "line"))


def read_run_configs(spark: SparkSession, path: str) -> DataFrame:
    """run (the folder's name), config (variant), changed of run_config.json files."""
    docs = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), F.try_parse_json("value").alias("config"), F.col("_metadata.file_modification_time").alias("changed"))
    return docs.where("config IS NOT NULL")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, changed, size of the files of a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("changed"), F.col("length").alias("size"))


class ZipIndex(DataSource):
    """Members of zip files, from their directories alone: view, uuid, chunk_no, path, member.

    Options: path (a folder of view folders that hold zip files), suffix ('.mp4').  Zips
    that can't be read, as ones still being written, are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_index"

    def schema(self) -> str:
        return "view string, uuid string, chunk_no int, path string, member string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options["path"], self.options.get("suffix", ".mp4"))


class _Zip(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _ZipReader(DataSourceReader):
    def __init__(self, folder: str, suffix: str) -> None:
        self.folder, self.suffix = folder, suffix

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [_Zip(str(p)) for p in sorted(Path(self.folder).glob("*/*.zip"))] or [_Zip("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import re
        import zipfile

        if not partition.path:
            return
        at = PurePosixPath(partition.path)
        number = re.search(r"(\d+)\D*$", at.stem)
        try:
            with zipfile.ZipFile(partition.path) as z:
                names = z.namelist()
        except (zipfile.BadZipFile, OSError):
            return
        for member in names:
            if member.endswith(self.suffix):
                yield at.parent.name, PurePosixPath(member).name.split(".")[0], int(number[1]) if number else -1, partition.path, member


def zip_index(spark: SparkSession, folder: str, suffix: str = ".mp4") -> DataFrame:
    """view, uuid, path, member: of a clip in several zips the one of the highest number."""
    spark.dataSource.register(ZipIndex)
    every = spark.read.format("zip_index").option("path", folder).option("suffix", suffix).load()
    return every.groupBy("view", "uuid").agg(F.max_by(F.struct("path", "member"), F.struct("chunk_no", "path")).alias("r")).select("view", "uuid", "r.path", "r.member")


def lookup(index: DataFrame, uuids: Sequence[str], view: str = "") -> DataFrame:
    """Entries of an index for these clips, of one view if given; the filter reaches the scan."""
    found = index.where(F.col("uuid").isin(*uuids))
    return found.where(F.col("view") == view) if view else found


def keys_of(index: DataFrame, view: str) -> DataFrame:
    """uuid of the clips that a view has, in order, each once."""
    return index.where(F.col("view") == view).select("uuid").distinct().orderBy("uuid")


def member_bytes(path: str, member: str, start: int = 0, length: int = -1) -> bytes:
    """One member of a zip, or some of its bytes, read where it lies; for user functions on executors."""
    import zipfile

    with zipfile.ZipFile(path) as z, z.open(member) as f:
        f.seek(start)
        return f.read(length)


# ---------------------------------------------------------------- writing


def append_results(rows: DataFrame, folder: str) -> None:
    """Append rows to a folder of result tables; refuses rows whose columns or their order differ from the folder's."""
    spark = rows.sparkSession
    try:
        have = spark.read.parquet(folder).columns
    except Exception as e:  # an absent or empty folder has no schema
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = None
    if have is not None and have != rows.columns:
        raise ValueError(schema_difference(have, rows.columns))
    rows.write.mode("append").parquet(folder)


def write_merged(rows: DataFrame, shards: str, out: str) -> str:
    """Write rows, sorted by uuid, as the table out, then delete the shards they were read from.

    The table is written aside and gets its name by one rename, before anything is deleted;
    an older table of that name stays until then.  rows mustn't be read again afterwards.
    """
    spark = rows.sparkSession
    aside = f"{out}.new-{uuid4().hex}"
    rows.orderBy("uuid").write.option("header", True).option("escape", '"').option("emptyValue", "").csv(aside)
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fs = path(out).getFileSystem(conf)
    old = f"{out}.old-{uuid4().hex}"
    had = fs.exists(path(out))
    if had and not fs.rename(path(out), path(old)):
        raise OSError(f"{out} can't be replaced")
    if not fs.rename(path(aside), path(out)):
        raise OSError(f"{aside} can't be renamed")
    if had:
        fs.delete(path(old), True)
    for found in fs.globStatus(path(shards)) or []:
        fs.delete(found.getPath(), True)
    return out


def schema_difference(old: Sequence[str], new: Sequence[str]) -> str:
    """What differs between two lists of columns."""
    gone, come = [c for c in old if c not in new], [c for c in new if c not in old]
    parts = [f"only before: {gone}"] * bool(gone) + [f"only now: {come}"] * bool(come)
    return "; ".join(parts) or "the order differs"


def write_class_lists(lists: DataFrame, folder: str) -> None:
    """Clips by class and kind (TP, FP, FN), one folder for each; '/' in names becomes '_'."""
    safe = lists.withColumn("class_name", F.regexp_replace(F.trim("class_name"), "/", "_"))
    safe.select("class_name", "kind", "uuid").repartition("class_name", "kind").sortWithinPartitions("class_name", "kind", "uuid").write.mode("overwrite").partitionBy("class_name", "kind").text(folder)


def clip_json(columns: Sequence[str]) -> Column:
    """Columns as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns))


def to_csv(rows: list[Mapping[str, object]], columns: Sequence[str]) -> str:
    """A small table as CSV text, header first."""
    out = io.StringIO()
    w = csv.DictWriter(out, fieldnames=list(columns), extrasaction="ignore", lineterminator="\n")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()


def to_json_lines(rows: list[Mapping[str, object]]) -> str:
    """A small table as one JSON object a line."""
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
