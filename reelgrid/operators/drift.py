"""Reading files whose fields drift into one table, and reporting each change (problem 3).

Rescue-column ingestion: `ingest` enforces a target schema.  A field of the schema whose
value has the JSON type of its column goes there; everything else (unknown fields, values of
another type or out of range, nulls written out) is kept as JSON in `_rescued`, so no value
is lost.  `promote` replays rescued values into typed columns later, without reading the
source again: those of a column's own name that can be cast, and those of approved fields.
`renamed_columns` derives from the reported renames which fields those are.

Typed columns and `_rescued` together say exactly which fields a record has, of which JSON
type and value, and the report is made from them: `shapes` puts both together, `drift`
compares the shapes of a set's files.

JSON is read in Arrow batches with Python's reader, as the report must tell 2 from 2.0
and objects that differ only in the order of keys, which Spark's VARIANT can't.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.session import cut

#: Target schema of label records: column, then its Spark type.
LABEL_SCHEMA = {
    "classes": "array<string>",
    "Dynamic object": "int",
    "Driving environment": "int",
    "safety_criticality": "int",
    "rarity": "int",
    "influenced_ego": "boolean",
    "is_night": "boolean",
    "rain_snow_fog": "array<string>",
    "weather": "map<string,int>",
    "labeler": "map<string,string>",
    "note": "string",
}
#: Objects whose members count as fields of their own.
NESTED = ("weather", "labeler")
RENAMED_SHARE = (9, 10)
#: Rows that a table of changed fields may have to be broadcast; a larger one is shuffled.
SMALL = 20_000
#: Names known to be a column's, approved also where no two files of the data show the renaming.
KNOWN_NAMES = {
    "class_list": "classes", "categories": "classes",
    "dynamic_object": "Dynamic object", "DynamicObject": "Dynamic object", "Dynamic Object": "Dynamic object",
    "driving_environment": "Driving environment", "DrivingEnvironment": "Driving environment", "driving env": "Driving environment",
    "criticality": "safety_criticality", "safetyCriticality": "safety_criticality", "safety_critical_level": "safety_criticality",
    "Rarity": "rarity", "rarity_score": "rarity", "how_rare": "rarity",
    "ego_influenced": "influenced_ego", "night": "is_night", "precip_tags": "rain_snow_fog",
    "precipitation": "weather.precipitation", "road_surface": "weather.road_surface",
    "illumination": "weather.illumination", "atmospheric_obscurants": "weather.atmospheric_obscurants",
    "labeled_by": "labeler.id", "labeler_id": "labeler.id", "comment": "note", "notes": "note",
}
KEYS = ["set_id", "file_name", "written_at", "line_no", "uuid"]


def json_type(v: object) -> str:
    """boolean, integer, number (written with fraction or exponent), string, array, object or null."""
    return {bool: "boolean", int: "integer", _Number: "number", str: "string", list: "array", dict: "object", type(None): "null"}[type(v)]


class _Number(float):
    """A JSON number written with fraction or exponent."""


@contextmanager
def _any_digits() -> Iterator[None]:
    """Integers of any length can be read and written, as Python by itself refuses very long ones."""
    before = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        yield
    finally:
        sys.set_int_max_str_digits(before)


def _load(text: str | None) -> dict | None:
    if text is None:
        return None
    try:
        found = json.loads(text, parse_float=_Number, parse_constant=_Number)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _storable(text: str) -> bool:
    """Whether a text can stand in a column: halves of surrogate pairs, which JSON can escape, can't."""
    return text.isascii() or text.isprintable() or not any("\ud800" <= c <= "\udfff" for c in text)


def _fit(v: object, kind: str) -> object:
    """v if it has the JSON type of a column of the target type and is in its range, else None."""
    if kind == "int":
        return v if type(v) is int and -(2**31) <= v < 2**31 else None
    if kind == "boolean":
        return v if isinstance(v, bool) else None
    if kind == "string":
        return v if isinstance(v, str) and _storable(v) else None
    if kind == "array<string>":
        return v if isinstance(v, list) and all(isinstance(x, str) and _storable(x) for x in v) else None
    if kind.startswith("map<string,"):
        inner = kind[11:-1]
        if isinstance(v, dict) and all(_storable(k) and (x is None or _fit(x, inner) is not None) for k, x in v.items()):
            return list(v.items())
        return None
    raise ValueError(kind)


def _cast(v: object, kind: str) -> object:
    """v as a value of the target type, or None where it can't be cast."""
    if kind == "int":
        if isinstance(v, str):
            m = re.fullmatch(r"\s*([+-]?)0*([0-9]+)\s*", v)
            v = int(m[1] + m[2]) if m and len(m[2]) < 11 else None
        elif isinstance(v, float):
            v = int(v) if abs(v) < 2**31 and v == int(v) else None
    elif kind.startswith("map<string,") and isinstance(v, dict):
        inner = kind[11:-1]
        out = {k: _cast(x, inner) for k, x in v.items()}
        return list(out.items()) if all(_storable(k) and (x is not None or v[k] is None) for k, x in out.items()) else None
    return _fit(v, kind)


def _text(v: object) -> str:
    """v as JSON, with sorted keys; halves of surrogate pairs stay escaped."""
    out = json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return out if _storable(out) else json.dumps(v, sort_keys=True, separators=(",", ":"))


def _name(text: str) -> str:
    """A field's name as a column can hold it."""
    return text if _storable(text) else text.encode("utf-8", "backslashreplace").decode()


def _quoted(text: str) -> str:
    return '"' + _name(text).replace("\\", "\\\\").replace('"', '\\"') + '"'


def canonical(v: object) -> str:
    """A text that two JSON values share if they are equal; `_canonical` gives the same for columns."""
    if isinstance(v, str):
        return _quoted(v)
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_quoted(k)}:{canonical(v[k])}" for k in sorted(v)) + "}"
    return json.dumps(v)


def _quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


_JSON_TYPES = {"int": "integer", "boolean": "boolean", "string": "string", "array<string>": "array", "map<string,int>": "object", "map<string,string>": "object"}


def _canonical(c: Column, kind: str) -> Column:
    """canonical of a typed column's value."""
    if kind == "string":
        return _quote(c)
    if kind == "array<string>":
        return F.concat(F.lit("["), F.array_join(F.transform(c, _quote), ","), F.lit("]"))
    if kind.startswith("map<"):
        inner = kind[11:-1]
        each = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(_quote(e["key"]), F.lit(":"), F.coalesce(_canonical(e["value"], inner), F.lit("null"))))
        return F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))
    return c.cast("string")


_ARROW = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "map<string,int>": pa.map_(pa.string(), pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def ingest(records: DataFrame, schema: Mapping[str, str] = LABEL_SCHEMA) -> DataFrame:
    """One row for each record: its keys, the schema's columns, _rescued, _readable.

    Records whose body is null, broken or no object aren't readable; they stay, with null
    columns and the body in _rescued.  Columns of records beyond the keys aren't taken over.
    """
    schema = dict(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _any_digits():
            for b in batches:
                cols: dict[str, list] = {c: [None] * b.num_rows for c in schema}
                rescued, readable = b.column("body").to_pylist(), [False] * b.num_rows
                for i, body in enumerate(rescued):
                    found = _load(body)
                    if found is None:
                        continue
                    readable[i], rest = True, {}
                    for field, v in found.items():
                        fit = _fit(v, schema[field]) if v is not None and field in schema else None
                        if fit is None:
                            rest[field] = v
                        else:
                            cols[field][i] = fit
                    rescued[i] = _text(rest) if rest else None
                arrays = [b.column(c) for c in KEYS] + [pa.array(cols[c], _ARROW[k]) for c, k in schema.items()]
                arrays += [pa.array(rescued, pa.string()), pa.array(readable, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*KEYS, *schema, "_rescued", "_readable"])

    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    out = ", ".join([*[f"`{c}` {kinds[c]}" for c in KEYS], *[f"`{c}` {k}" for c, k in schema.items()], "_rescued string", "_readable boolean"])
    return records.select(*KEYS, "body").mapInArrow(run, out)


def _with_column(table: DataFrame, column: str, kind: str, run: Callable[[list[str | None]], pa.Array]) -> DataFrame:
    """table without _rescued, with a column that is made from it in Arrow batches."""
    kept = [c for c in table.columns if c != "_rescued"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _any_digits():
            for b in batches:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], run(b.column("_rescued").to_pylist())], names=[*kept, column])

    return table.mapInArrow(each, T.StructType([*table.select(*kept).schema.fields, T.StructField(column, T._parse_datatype_string(kind))]))


def _rescued_shapes(texts: list[str | None]) -> pa.Array:
    """field, type and value (canonical, None for null) of each rescued field, members of NESTED too."""
    ends, fields, kinds, values = [0], [], [], []
    for text in texts:
        found = _load(text) or {}
        for top in NESTED:
            if isinstance(found.get(top), dict):
                found |= {f"{top}.{k}": v for k, v in found[top].items()}
        for field, v in found.items():
            fields.append(_name(field))
            kinds.append(json_type(v))
            values.append(None if v is None else canonical(v))
        ends.append(len(fields))
    flat = pa.StructArray.from_arrays([pa.array(fields, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["field", "type", "value"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def shapes(table: DataFrame, schema: Mapping[str, str] = LABEL_SCHEMA) -> DataFrame:
    """Keys and s, an array of field, type and v (hash of the value, null for null), of each readable record.

    table: what ingest gives.  Fields come from the typed columns that aren't null and from
    _rescued.  Values are compared by their hash of 64 bits.
    """
    item = lambda field, kind, value: F.struct(field.alias("field"), kind.alias("type"), value.alias("value"))
    none = F.array().cast("array<struct<field:string,type:string,value:string>>")

    def member_of(c: str, inner: str) -> Callable[[Column], Column]:
        return lambda e: item(F.concat(F.lit(f"{c}."), e["key"]), F.when(e["value"].isNull(), "null").otherwise(_JSON_TYPES[inner]), _canonical(e["value"], inner))

    tops, members = [], []
    for c, kind in schema.items():
        col = F.col(f"`{c}`")
        tops.append(F.when(col.isNotNull(), item(F.lit(c), F.lit(_JSON_TYPES[kind]), _canonical(col, kind))))
        if c in NESTED and kind.startswith("map<"):
            inner = kind[11:-1]
            members.append(F.coalesce(F.transform(F.map_entries(col), member_of(c, inner)), none))
    typed = table.where("_readable").select(*KEYS, F.concat(F.array_compact(F.array(*tops)), *members).alias("_typed"), "_rescued")
    both = _with_column(typed, "_more", "array<struct<field:string,type:string,value:string>>", _rescued_shapes)
    hashed = F.transform(F.concat("_typed", "_more"), lambda x: F.struct(x["field"].alias("field"), x["type"].alias("type"), F.when(x["value"].isNotNull(), F.xxhash64(x["type"], x["value"])).alias("v")))
    return both.select(*KEYS, hashed.alias("s"))


def promote(table: DataFrame, approved: Mapping[str, str], schema: Mapping[str, str] = LABEL_SCHEMA) -> DataFrame:
    """Replay rescued values: approved maps a rescued field to the column it belongs in.

    A value that can be cast fills the column where that is null, and leaves _rescued;
    one that can't stays there, as does a second one for the same place.  Rescued values of
    a column's own name come first; nulls written out for a column leave _rescued.  A column
    of a map may be given with its key, as in weather.precipitation: the value becomes that
    member.  The column is added where the table lacks it (as string).
    """
    places = {c: (c, "") for c in schema if c in table.columns}
    for field, target in approved.items():
        top, _, member = target.partition(".")
        places[field] = (top, member) if target not in schema and member and schema.get(top, "").startswith("map<") else (target, "")
    order = {field: i for i, field in enumerate(places)}
    kinds = {c: schema.get(c, "string") for c, _ in places.values()}
    fields = {f.name: f for f in table.schema.fields}
    out = T.StructType([*fields.values(), *[T.StructField(c, T.StringType()) for c in kinds if c not in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _any_digits():
            for b in batches:
                rescued, readable = b.column("_rescued").to_pylist(), b.column("_readable").to_pylist()
                cols = {c: b.column(c).to_pylist() if c in fields else [None] * b.num_rows for c in kinds}
                for i, text in enumerate(rescued):
                    found = _load(text) if readable[i] else None
                    if not found:
                        continue
                    kept = dict(found)
                    for field in sorted(places.keys() & found.keys(), key=order.__getitem__):
                        c, member = places[field]
                        if found[field] is None:
                            if field in schema:
                                del kept[field]
                            continue
                        old = dict(cols[c][i] or ()) if member else cols[c][i]
                        fit = _cast(found[field], kinds[c][11:-1] if member else kinds[c])
                        if fit is None or (old.get(member) if member else old) is not None:
                            continue
                        cols[c][i] = list((old | {member: fit}).items()) if member else fit
                        del kept[field]
                    if len(kept) < len(found):
                        rescued[i] = _text(kept) if kept else None
                new = {c: pa.array(v, _ARROW[kinds[c]]) for c, v in cols.items()} | {"_rescued": pa.array(rescued, pa.string())}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in out.names], names=out.names)

    return table.mapInArrow(run, out)


def renamed_columns(table: DataFrame, schema: Mapping[str, str] = LABEL_SCHEMA) -> dict[str, str]:
    """For promote: each field that the files of the data rename to or from a column or its member.

    table: what ingest gives.  Chains of renames are followed back to a column.  A pair of
    names counts for the sets that rename one into the other, less the files that have both,
    as some values agree by chance; of several ways the one with the best weakest link is taken.
    The renames come to the driver: one row for each pair of names, however many files have it.
    """
    rows = cut(shapes(table, schema))
    pair = [F.least("field", "new_field").alias("x"), F.greatest("field", "new_field").alias("y")]
    links = cut(_changes(rows).where("change_type = 'renamed'").groupBy(*pair).agg(F.count_distinct("set_id").alias("n")))
    files = rows.select("set_id", "file_name", F.explode("s.field").alias("f")).groupBy("set_id", "file_name").agg(F.collect_set("f").alias("fs"))
    both = files.withColumn("x", F.explode("fs")).join(_small(links), "x").where(F.array_contains("fs", F.col("y"))).groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))
    near = defaultdict(list)
    for r in links.join(both, ["x", "y"], "left").selectExpr("x", "y", "n - coalesce(k, 0) AS n").where("n > 0").collect():
        near[r.x].append((r.y, r.n))
        near[r.y].append((r.x, r.n))

    columns = {*schema, *(f for f in near if f.partition(".")[0] in NESTED and "." in f)}
    heap, out = sorted((-math.inf, 0, c, c) for c in columns), {}
    while heap:
        wide, hops, field, column = heapq.heappop(heap)
        if field in out:
            continue
        out[field] = column
        for other, n in near[field]:
            if other not in columns:
                heapq.heappush(heap, (max(wide, -n), hops + 1, other, column))
    return {f: c for f, c in out.items() if f not in columns}


def _small(written: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most SMALL rows."""
    return F.broadcast(written) if written.count() <= SMALL else written


def drift(table: DataFrame, schema: Mapping[str, str] = LABEL_SCHEMA) -> DataFrame:
    """set_id, file_name, change_type, field, new_field: changes from each file to the next.

    table: what ingest gives.  Files of a set follow each other by written_at (of a file
    the earliest, then its name); unreadable records don't count, so neither does a file
    of only such.  Of a clip's records in one file the last line counts.  A set of one
    file, and an empty table, give no rows.
    """
    return _changes(cut(shapes(table, schema)))


def _changes(rows: DataFrame) -> DataFrame:
    """drift of the shapes."""
    files = rows.groupBy("set_id", "file_name").agg(F.min("written_at").alias("at"))
    order = Window.partitionBy("set_id").orderBy("at", "file_name")
    steps = files.select("set_id", "file_name", F.lag("file_name").over(order).alias("before"), F.lead("file_name").over(order).alias("after"))

    seen = rows.select("set_id", "file_name", F.explode("s").alias("x")).select("set_id", "file_name", "x.field", "x.type")
    fields = seen.groupBy("set_id", "file_name", "field").agg(F.array_sort(F.collect_set(F.when(F.col("type") != "null", F.col("type")))).alias("types"))
    placed = cut(fields.join(steps, ["set_id", "file_name"]))

    new = placed.where("before IS NOT NULL").select("set_id", F.col("before").alias("from"), F.col("file_name").alias("to"), "field", F.col("types").alias("new_types"))
    old = placed.where("after IS NOT NULL").select("set_id", F.col("file_name").alias("from"), F.col("after").alias("to"), "field", F.col("types").alias("old_types"))
    both = cut(old.join(new, ["set_id", "from", "to", "field"], "full_outer"))
    changed = both.where("old_types IS NULL OR new_types IS NULL")
    retyped = both.where("size(old_types) > 0 AND size(new_types) > 0 AND old_types <> new_types").select("set_id", "to", F.lit("retyped").alias("change_type"), "field", F.lit("").alias("new_field"))

    # clips of both files, with the values of the fields that only one of them has
    top = ~F.col("field").isin(*NESTED)
    lists = _small(cut(changed.groupBy("set_id", "from", "to").agg(F.collect_set(F.when(F.col("new_types").isNull() & top, F.col("field"))).alias("gone"), F.collect_set(F.when(F.col("old_types").isNull() & top, F.col("field"))).alias("come")).where("size(gone) > 0 AND size(come) > 0")))
    wanted = lambda names: F.transform(F.filter("s", lambda x: x["v"].isNotNull() & F.array_contains(names, x["field"])), lambda x: F.struct(x["field"].alias("f"), x["v"].alias("v")))

    def side(own: str, other: str, names: str, out: str) -> DataFrame:
        """The fields in names of each clip of a file; other rows and fields aren't shuffled."""
        mine = rows.join(lists.select("set_id", F.col(own).alias("file_name"), F.col(other).alias("_other"), names), ["set_id", "file_name"])
        picked = mine.select("set_id", F.col("file_name").alias(own), F.col("_other").alias(other), "uuid", "line_no", wanted(names).alias("s"))
        return picked.groupBy("set_id", "from", "to", "uuid").agg(F.max_by("s", F.struct("line_no", F.array_sort("s"))).alias(out))

    # a pair of fields is renamed if their values agree in nine tenths of the clips that have either;
    # only agreeing values are paired, and clips with both are counted for the pairs that can still reach it
    step = ["set_id", "from", "to"]
    clips = cut(side("from", "to", "gone", "a").join(side("to", "from", "come", "b"), [*step, "uuid"]).drop("uuid"))
    held = clips.select(*step, F.explode(F.concat("a.f", "b.f")).alias("f")).groupBy(*step, "f").agg(F.count(F.lit(1)).alias("n"))
    agree = F.flatten(F.transform("a", lambda x: F.transform(F.filter("b", lambda y: y["v"] == x["v"]), lambda y: F.struct(x["f"].alias("field"), y["f"].alias("new_field")))))
    same = clips.select(*step, F.explode(agree).alias("p")).groupBy(*step, "p.field", "p.new_field").agg(F.count(F.lit(1)).alias("same"))
    of = lambda c, n: held.select(*step, F.col("f").alias(c), F.col("n").alias(n))
    enough = lambda n: F.col("same") * RENAMED_SHARE[1] >= n * RENAMED_SHARE[0]
    near = cut(same.join(of("field", "n_old"), [*step, "field"]).join(of("new_field", "n_new"), [*step, "new_field"]).where(enough(F.greatest("n_old", "n_new"))))
    per_step = _small(cut(near.groupBy(*step).agg(F.collect_list(F.struct("field", "new_field")).alias("ps"))))
    has = lambda side, f: F.exists(side, lambda x: x["f"] == f)
    met = clips.join(per_step, step).select(*step, F.explode(F.filter("ps", lambda p: has("a", p["field"]) & has("b", p["new_field"]))).alias("p")).groupBy(*step, "p.field", "p.new_field").agg(F.count(F.lit(1)).alias("both"))
    renamed = cut(near.join(met, [*step, "field", "new_field"]).where(enough(F.col("n_old") + F.col("n_new") - F.col("both"))).select(*step, "field", "new_field"))

    one = changed.select(*step, "field", F.when(F.col("new_types").isNull(), "removed").otherwise("added").alias("change_type"))
    used = renamed.select(*step, F.explode(F.array(F.struct(F.lit("removed").alias("change_type"), F.col("field")), F.struct(F.lit("added").alias("change_type"), F.col("new_field").alias("field")))).alias("u")).select(*step, "u.change_type", "u.field")
    other = one.join(used, [*step, "change_type", "field"], "left_anti").select("set_id", "to", "change_type", "field", F.lit("").alias("new_field"))
    named = renamed.select("set_id", "to", F.lit("renamed").alias("change_type"), "field", "new_field")
    return other.unionByName(named).unionByName(retyped).withColumnRenamed("to", "file_name").select("set_id", "file_name", "change_type", "field", "new_field")


def record_drift(records: DataFrame) -> DataFrame:
    """Ingest label records and report the drift of their files."""
    return drift(ingest(records))
