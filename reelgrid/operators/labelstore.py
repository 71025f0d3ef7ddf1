"""The event-sourced label store: current state, history, polling, progress, assignment, claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.chunks import format_chunks, format_ranges, merged, parse_chunks
from reelgrid.operators.evaluate import Taxonomy
from reelgrid.operators.merge import keep_last
from reelgrid.session import cut


def once(events: DataFrame) -> DataFrame:
    """Label events (uuid, rev, ...) with one row for each revision, the last by time."""
    return keep_last(events, ["uuid", "rev"], [F.col("updated_at")])


def fold(events: DataFrame) -> DataFrame:
    """The current row of each uuid with its audit: first and last time and author, and all authors in order."""
    rest = [c for c in events.columns if c != "uuid"]
    who = F.col("labeler.id")
    firsts = events.groupBy("uuid", who.alias("who")).agg(F.min("rev").alias("at"), F.max_by(F.struct(*rest), F.struct("rev", "updated_at")).alias("row"), F.min_by(F.struct("updated_at"), F.struct("rev", "updated_at")).alias("first"))
    out = firsts.groupBy("uuid").agg(
        F.max_by("row", F.struct("row.rev", "row.updated_at")).alias("row"), F.min_by("first.updated_at", F.struct("at", "first.updated_at")).alias("created_at"), F.min_by("who", F.struct("at", "first.updated_at")).alias("created_by"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("who").isNotNull(), F.struct("at", "who")))), lambda x: x["who"]).alias("authors"),
    )
    return out.select("uuid", *[F.col("row")[c].alias(c) for c in rest], "created_at", "created_by", "authors")


#: Fields of a label, and how each becomes entries of a flat map: by key, as a list, or as one value.
FIELDS = {"group_scores": "keys", "classes": "keys", "weather": "keys", "class_list": "list", "rain_snow_fog": "list", "has_class_scores": "value", "influenced_ego": "value", "is_night": "value", "note": "value"}


def flat_fields(rows: DataFrame) -> Column:
    """A label as map from field path ('classes.Roadworks', 'note') to text; what is absent or null has no entry, lists are in order."""
    none = F.create_map().cast("map<string,string>")

    def entries(c: str, how: str) -> Column:
        v = F.col(c)
        if how == "keys":
            some = F.map_filter(v, lambda _, x: x.isNotNull())
            return F.map_from_entries(F.transform(F.map_entries(some), lambda e: F.struct(F.concat(F.lit(f"{c}."), e["key"]), e["value"].cast("string"))))
        text = F.array_join(F.array_sort(F.array_distinct(v)), "|") if how == "list" else v.cast("string")
        return F.when(v.isNotNull(), F.create_map(F.lit(c), text))

    return F.map_concat(*[F.coalesce(entries(c, how), none) for c, how in FIELDS.items() if c in rows.columns])


def changed_fields(before: Column, after: Column) -> Column:
    """array<struct<field, old, new>> of fields whose values differ, by name."""
    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    each = F.transform(keys, lambda k: F.struct(k.alias("field"), F.try_element_at(before, k).alias("old"), F.try_element_at(after, k).alias("new")))
    return F.filter(each, lambda e: ~e["old"].eqNullSafe(e["new"]))


def history(events: DataFrame) -> DataFrame:
    """uuid, rev, field, old, new: what each revision changed against the one before (the first against nothing)."""
    none = F.create_map().cast("map<string,string>")
    rows = once(events.select("uuid", "rev", "updated_at", *[c for c in FIELDS if c in events.columns]))
    rows = rows.select("uuid", "rev", flat_fields(rows).alias("after"))
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(Window.partitionBy("uuid").orderBy("rev")), none))
    return rows.select("uuid", "rev", F.explode(changed_fields(F.col("before"), F.col("after"))).alias("c")).select("uuid", "rev", "c.*")


def poll(events: DataFrame, since: Column) -> DataFrame:
    """uuid, seq of the last event of each uuid after since, newest first; the filter reaches the scan."""
    return events.where(F.col("seq") > since).groupBy("uuid").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq"), "uuid")


def meta(current: DataFrame) -> DataFrame:
    """dataset_id: labels, labelers in order, day of the last change.  Labelers are few, so their set is small."""
    return current.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("labeler.id")), "|").alias("labelers"), F.max(F.to_date("updated_at")).cast("string").alias("last_day"))


def progress(clips: DataFrame, current: DataFrame) -> DataFrame:
    """labeler, n, total: clips labelled by each labeler ('' for unnamed ones) and, at labeler null, those not labelled.

    total is summed over the result's few rows.
    """
    rows = clips.join(current.select("uuid", F.coalesce("labeler.id", F.lit("")).alias("labeler")), "uuid", "left")
    return rows.groupBy("labeler").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))


def assignment_summary(ranges: DataFrame) -> DataFrame:
    """store_id, user_id, n_chunks, chunks of assigned ranges (store_id, lo, hi, user_id; disjoint): a user's chunks and their list.

    The list is the result's own text; ranges are collected for it, not numbers.
    """
    found = F.collect_list(F.struct("lo", "hi"))
    per = ranges.groupBy("store_id", "user_id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n_chunks"), found.alias("_r"))
    return per.select("store_id", "user_id", "n_chunks", format_ranges(merged(F.col("_r"))).alias("chunks"))


def free_ranges(ranges: DataFrame) -> DataFrame:
    """store_id, lo, hi: what lies between 0 and a store's last assigned chunk and isn't assigned."""
    before = F.coalesce(F.max("hi").over(Window.partitionBy("store_id").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    gaps = ranges.select("store_id", (before + 1).alias("_lo"), (F.col("lo") - 1).alias("_hi"))
    return gaps.where("_lo <= _hi").select("store_id", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))


def assign_conflicts(state: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, user_id, n_chunks, chunks: of each request to assign, what other users hold of its chunks.

    state: store_id, chunk, user_id; requests: request_id (unique), store_id, user_id, spec.  Requests
    without user, which free chunks, and unreadable or empty lists have no conflicts.
    """
    asked = requests.where("user_id <> ''").select("request_id", "store_id", F.col("user_id").alias("_for"), F.explode(parse_chunks(F.col("spec"))).alias("chunk"))
    taken = asked.join(state.select("store_id", "chunk", "user_id"), ["store_id", "chunk"]).where("user_id <> _for")
    return taken.groupBy("request_id", "user_id").agg(F.count(F.lit(1)).alias("n_chunks"), format_chunks(F.collect_list("chunk")).alias("chunks"))


def assign_outcomes(state: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, outcome, added, removed of each request by itself against the state.

    requests as for assign_conflicts, with force b: a request replaces all chunks of its user by its
    list, or frees the list's chunks if it has no user.  It is a conflict, and changes nothing, if
    others hold some of them and it isn't forced; else unreadable (an empty list too), unchanged or changed.
    """
    asked = requests.select("request_id", "store_id", F.nullif("user_id", F.lit("")).alias("_for"), F.coalesce("force", F.lit(False)).alias("_force"), parse_chunks(F.col("spec")).alias("_ns"))
    held = state.select("store_id", "chunk", F.col("user_id").alias("_by"))
    met = asked.select("request_id", "store_id", "_for", F.explode("_ns").alias("chunk")).join(held, ["store_id", "chunk"])
    met = met.groupBy("request_id").agg(F.count(F.lit(1)).alias("_held"), F.count_if(F.col("_by") == F.col("_for")).alias("_own"))
    old = held.groupBy("store_id", F.col("_by").alias("_for")).agg(F.count(F.lit(1)).alias("_old"))
    every = asked.join(met, "request_id", "left").join(old, ["store_id", "_for"], "left").na.fill(0, ["_held", "_own", "_old"])
    outcome = (
        F.when(F.col("_ns").isNull(), "unreadable")
        .when(F.col("_for").isNull(), F.when(F.col("_held") > 0, "changed").otherwise("unchanged"))
        .when((F.col("_held") > F.col("_own")) & ~F.col("_force"), "conflict")
        .when((F.col("_own") == F.size("_ns")) & (F.col("_own") == F.col("_old")), "unchanged")
        .otherwise("changed")
    )
    added = F.when(F.col("_for").isNull(), 0).otherwise(F.size("_ns") - F.col("_own"))
    removed = F.when(F.col("_for").isNull(), F.col("_held")).otherwise(F.col("_old") - F.col("_own"))
    done = F.col("outcome") == "changed"
    return every.withColumn("outcome", outcome).select("request_id", "outcome", F.when(done, added).otherwise(0).cast("bigint").alias("added"), F.when(done, removed).otherwise(0).cast("bigint").alias("removed"))


def auto_assign(free: DataFrame, users: Sequence[str], per_user: int) -> DataFrame:
    """store_id, chunk, user_id: of free ranges (store_id, lo, hi) blocks of per_user chunks by number, one for each user in order; the rest stays free."""
    names = list(dict.fromkeys(users))
    most = per_user * len(names)
    so_far = Window.partitionBy("store_id").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    first = free.withColumn("_n", F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1).over(so_far), F.lit(0))).where(F.col("_n") < most)
    dealt = first.select("store_id", "lo", "_n", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + most - F.col("_n") - 1))).alias("chunk"))
    place = F.col("_n") + F.col("chunk") - F.col("lo")
    return dealt.select("store_id", "chunk", F.array(*map(F.lit, names))[F.floor(place / per_user).cast("int")].alias("user_id"))


def next_open(clips: DataFrame) -> DataFrame:
    """group, uuid, next_uuid: of each clip (open: not labelled yet) the next open one in order of uuid, round the end; null if none is open but itself.

    Clips are range-partitioned by group and uuid, so a group may take any number of tasks;
    the first open clip of each group in each partition (at most partitions plus groups
    many) says where to go on.  Frames run, nothing is looked up row by row.
    """
    placed = cut(clips.select("group", "uuid", "open").repartitionByRange("group", "uuid").withColumn("_part", F.spark_partition_id()))
    heads = placed.where("open").groupBy("group", "_part").agg(F.min("uuid").alias("_head"))
    every = placed.select("group", "_part").distinct().join(heads, ["group", "_part"], "left")
    later = Window.partitionBy("group").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    heads = every.select("group", "_part", F.last("_head", ignorenulls=True).over(later).alias("_later"), F.min("_head").over(Window.partitionBy("group")).alias("_first"))
    one = F.when(F.col("open"), F.col("uuid"))
    back = Window.partitionBy("group", "_part").orderBy(F.desc("uuid")).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("_near", F.last(one, ignorenulls=True).over(back)).join(heads, ["group", "_part"])
    return near.select("group", "uuid", F.nullif(F.coalesce("_near", "_later", "_first"), F.col("uuid")).alias("next_uuid"))


def active_claims(claims: DataFrame, now: Column, ttl_s: int = 90) -> DataFrame:
    """uuid, user_id, until of claims that hold at now: a clip's last claim, if its user claimed no other since and it isn't over.

    claims: uuid, user_id, ts, seq (their order).
    """
    seen = claims.where(F.col("ts") <= now)
    last = keep_last(seen.select("uuid", "user_id", "ts", "seq"), ["uuid"], [F.col("seq")])
    own = seen.groupBy("user_id").agg(F.max_by("uuid", "seq").alias("newest"))
    until = F.col("ts") + F.make_interval(secs=F.lit(ttl_s))
    return last.join(own, "user_id").where(F.col("newest") == F.col("uuid")).select("uuid", "user_id", until.alias("until")).where(F.col("until") >= now)


def save_outcomes(current: DataFrame, saves: DataFrame) -> DataFrame:
    """uuid, outcome of saves made from a base revision: created, saved, conflict (another came first) or unchanged."""
    a = current.select("uuid", F.col("rev").alias("have"), flat_fields(current).alias("old"))
    b = saves.select("uuid", "base_rev", flat_fields(saves).alias("new"))
    none = F.create_map().cast("map<string,string>")
    same = F.size(changed_fields(F.coalesce("old", none), F.col("new"))) == 0
    what = F.when(F.coalesce("have", F.lit(0)) != F.coalesce("base_rev", F.lit(0)), "conflict").when(F.col("have").isNull(), "created").when(same, "unchanged").otherwise("saved")
    return b.join(a, "uuid", "left").select("uuid", what.alias("outcome"))


def import_counts(current: DataFrame, incoming: DataFrame, known: DataFrame) -> DataFrame:
    """outcome, n of labels brought in: added, kept (one is there) or missing (no such clip)."""
    rows = incoming.select("uuid").join(known.select("uuid", F.lit(1).alias("is_known")), "uuid", "left").join(current.select("uuid", F.lit(1).alias("has")), "uuid", "left")
    what = F.when(F.col("is_known").isNull(), "missing").when(F.col("has").isNotNull(), "kept").otherwise("added")
    return rows.groupBy(what.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def page(rows: DataFrame, keep: Column, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page of rows that fit; a total order makes pages disjoint."""
    return rows.where(keep).orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def patch_labels(current: DataFrame, patches: DataFrame) -> DataFrame:
    """current (uuid and fields) after patches: what sets a field, or deletes a label, in the order of seq (unique for a uuid).

    patches: uuid, seq, is_delete, fields (names of those that it sets) and the fields.  A
    field has the last value set since the label's last deletion; a label that was deleted
    and is set again begins anew, with nulls.  Names that current lacks are ignored.
    """
    columns = [c for c in current.columns if c != "uuid"]
    gone = F.max(F.when(F.coalesce("is_delete", F.lit(False)), F.col("seq"))).over(Window.partitionBy("uuid"))
    later = patches.withColumn("_gone", gone).where("NOT coalesce(is_delete, false) AND (_gone IS NULL OR seq > _gone)")
    sets = lambda c: F.array_contains("fields", c)
    last = [F.max_by(F.when(sets(c), F.struct(F.col(c).alias("v"))), F.when(sets(c), F.col("seq"))).alias(f"_{c}") for c in columns if c in patches.columns]
    put = later.groupBy("uuid").agg(F.lit(True).alias("_put"), *last)
    deleted = patches.where("is_delete").select("uuid", F.lit(True).alias("_cleared")).distinct()
    have = current.join(deleted, "uuid", "left_anti").withColumn("_have", F.lit(True))
    both = have.join(put, "uuid", "full_outer")
    value = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}")["v"]).otherwise(F.col(c)) if c in patches.columns else F.col(c)
    return both.where("_have OR _put").select("uuid", *[value(c).alias(c) for c in columns])


def rewrite_classes(taxonomy: DataFrame, edits: DataFrame) -> DataFrame:
    """taxonomy after edits (one for each old name): add, rename, move to another group, change templates, delete.

    edits: old_name (null: a new class), class_name, group_name, templates, is_delete; a null
    leaves what is there.  Other columns of the taxonomy stay as they are.  A class that is
    new or moved comes last in its group; a new group comes after the others.
    """
    e = edits.select("old_name", F.col("class_name").alias("_name"), F.col("group_name").alias("_group"), F.col("templates").alias("_templates"), F.coalesce("is_delete", F.lit(False)).alias("_delete"))
    changed = taxonomy.join(e.where("old_name IS NOT NULL"), F.col("class_name") == F.col("old_name"), "left").where("NOT coalesce(_delete, false)")
    put = {"class_name": F.coalesce("_name", "class_name"), "templates": F.coalesce("_templates", "templates"), "_moved": F.coalesce(F.col("_group") != F.col("group_name"), F.lit(False)), "_to": F.coalesce("_group", "group_name")}
    rows = changed.withColumns(put)
    new = e.where("old_name IS NULL AND NOT _delete").select(F.col("_name").alias("class_name"), F.col("_group").alias("_to"), F.col("_templates").alias("templates"), F.lit(True).alias("_moved"))
    every = rows.select(*taxonomy.columns, "_moved", "_to").unionByName(new, allowMissingColumns=True)
    groups = taxonomy.groupBy(F.col("group_name").alias("_to")).agg(F.min("group_pos").alias("_gp"), F.max("class_pos").alias("_cp"))
    placed = every.join(groups, "_to", "left")
    fresh = F.dense_rank().over(Window.orderBy(F.col("_gp").isNotNull(), "_to"))  # the taxonomy is small and fixed
    most = F.max("_gp").over(Window.partitionBy())
    nth = F.row_number().over(Window.partitionBy("_to", "_moved").orderBy("class_name"))
    place = {"_at": F.coalesce("_gp", most + fresh), "_n": F.when(F.col("_moved"), F.coalesce("_cp", F.lit(-1)) + nth).otherwise(F.col("class_pos"))}
    out = {"group_name": F.col("_to"), "group_pos": F.col("_at").cast("int"), "class_pos": F.col("_n").cast("int")}
    return placed.withColumns(place).withColumns(out).select(*taxonomy.columns)


def label_errors(labels: DataFrame, previous: DataFrame, tax: Taxonomy, *, scale: Sequence[int] = range(5), of_group: Mapping[str, Sequence[int]] | None = None, precipitation: Sequence[str] = ("rain", "snow", "fog"), longest_note: int = 4000) -> DataFrame:
    """uuid, errors (array, in order) of labels that may not be saved.

    A class must be in the taxonomy or in the clip's label before; its score must be on the
    scale, without 0, a group's score among those of the group (of_group, else the scale),
    unless it is as before; weather values must be on the scale, precipitation tags among
    the given ones, a note not longer than allowed.  Nulls are absent values.
    """
    was = previous.select("uuid", F.col("classes").alias("_classes"), F.col("group_scores").alias("_groups"))
    rows = labels.join(was, "uuid", "left")
    none = F.create_map().cast("map<string,int>")
    values = lambda vs: F.array(*map(F.lit, vs)).cast("array<int>")
    scored = lambda c, before, allowed: F.filter(F.map_entries(F.coalesce(c, none)), lambda e: e["value"].isNotNull() & ~F.array_contains(allowed(e["key"]), e["value"]) & ~e["value"].eqNullSafe(F.try_element_at(F.coalesce(before, none), e["key"])))
    say = lambda what, es: F.transform(es, lambda e: F.concat(F.lit(f"{what}."), e["key"], F.lit(" = "), e["value"].cast("string")))
    groups = F.create_map(*[x for g, vs in (of_group or {}).items() for x in (F.lit(g), values(vs))]) if of_group else None
    of = lambda g: F.coalesce(F.try_element_at(groups, g), values(scale)) if groups is not None else values(scale)
    known = F.array(*map(F.lit, tax.groups)).cast("array<string>")
    unknown = F.array_except(F.map_keys(F.coalesce("classes", none)), F.concat(known, F.map_keys(F.coalesce("_classes", none))))
    parts = [
        F.transform(unknown, lambda c: F.concat(F.lit("unknown class "), c)),
        say("classes", scored(F.col("classes"), F.col("_classes"), lambda _: values([v for v in scale if v]))),
        say("group_scores", scored(F.col("group_scores"), F.col("_groups"), of)),
        say("weather", scored(F.col("weather"), none, lambda _: values(scale))),
        F.transform(F.array_except(F.coalesce("rain_snow_fog", F.array().cast("array<string>")), F.array(*map(F.lit, precipitation))), lambda t: F.concat(F.lit("unknown tag "), t)),
        F.when(F.length("note") > longest_note, F.array(F.concat(F.lit("note of "), F.length("note").cast("string"), F.lit(" characters")))).otherwise(F.array().cast("array<string>")),
    ]
    return rows.select("uuid", F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]).alias("errors")).where("size(errors) > 0")


def mismatches(kept: DataFrame, folded: DataFrame) -> DataFrame:
    """uuid, state of labels of a kept document that aren't what the log says: missing, extra or different."""
    a = kept.select("uuid", flat_fields(kept).alias("_kept"))
    b = folded.select("uuid", flat_fields(folded).alias("_log"))
    both = a.join(b, "uuid", "full_outer")
    same = F.size(changed_fields(F.col("_kept"), F.col("_log"))) == 0
    state = F.when(F.col("_kept").isNull(), "missing").when(F.col("_log").isNull(), "extra").when(~same, "different")
    return both.select("uuid", state.alias("state")).where("state IS NOT NULL")


def clip_view(clips: DataFrame, audited: DataFrame, claims: DataFrame, assigned: DataFrame) -> DataFrame:
    """Clips (uuid, store_id, chunk) with what is known of each: rev, labelled or not, authors, names, claim and assignee.

    audited: what fold gives; claims: active_claims; assigned: store_id, chunk, user_id.  A
    labeler without name goes by its id.  All joins are by key and keep every clip.
    """
    labels = audited.select("uuid", "rev", F.coalesce("labeler.name", "labeler.id").alias("labeler"), "created_by", "created_at", "updated_at", "authors")
    held = claims.select("uuid", F.col("user_id").alias("claimed_by"))
    owner = assigned.select("store_id", "chunk", F.col("user_id").alias("assignee"))
    rows = clips.join(labels, "uuid", "left").join(held, "uuid", "left").join(owner, ["store_id", "chunk"], "left")
    return rows.select("uuid", "store_id", "chunk", F.col("rev").isNotNull().alias("labeled"), F.coalesce("rev", F.lit(0)).alias("rev"), "labeler", "created_by", "created_at", "updated_at", "authors", "claimed_by", "assignee")


def counts_of(view: DataFrame, user: str) -> DataFrame:
    """One row for a user: all clips, labelled and claimed ones, those the user labelled, those assigned to it and how many of these are labelled."""
    mine, own = F.coalesce(F.array_contains("authors", user), F.lit(False)), F.coalesce(F.col("assignee") == user, F.lit(False))
    n = {"total": F.lit(True), "n_labeled": F.col("labeled"), "n_claimed": F.col("claimed_by").isNotNull(), "mine": mine, "n_assigned": own, "assigned_labeled": own & F.col("labeled")}
    return view.agg(*[F.count_if(c).alias(name) for name, c in n.items()])


def last_events(events: DataFrame, order: Sequence[Column], n: int = 30) -> DataFrame:
    """The last n events, newest first (a report: each task passes on n rows)."""
    return events.orderBy(*order).limit(n)
