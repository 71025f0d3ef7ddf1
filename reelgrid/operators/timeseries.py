"""Vehicle time series: summaries, range and as-of joins, segments.

Samples are one row each: uuid, t_us and values.  All window operators are partitioned by
uuid and ordered by time, so one sort serves several of them; frames are bounded or
running, so a partition is streamed, not held.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STOP_SPEED = 0.5
# fixed values: bounds of described motion, in m/s, m/s^2 and degrees
CREEP_SPEED, HARD_BRAKE, TURN, STEADY_KMH, PAUSE_S, STILL_S = 2.0, -3.0, 15.0, 5.0, 2.0, 0.5


def _by_time(*keys: str):
    return Window.partitionBy(*(keys or ("uuid",))).orderBy("t_us")


def wrapped(degrees: Column) -> Column:
    """An angle difference within -180 and 180 degrees, half turns away from zero kept as they come."""
    return degrees - 360 * F.floor((degrees + 180) / 360)


def heading(samples: DataFrame) -> DataFrame:
    """samples with turn (change since the sample before, the short way) and heading (sum of turns)."""
    step = F.coalesce(wrapped(F.col("yaw_deg") - F.lag("yaw_deg").over(_by_time())), F.lit(0.0))
    turned = samples.withColumn("turn", step)
    return turned.withColumn("heading", F.sum("turn").over(_by_time().rowsBetween(Window.unboundedPreceding, 0)))


def half_gaps(samples: DataFrame) -> DataFrame:
    """samples with weight_s, half of the time to either neighbour."""
    w = _by_time()
    gap = lambda a, b: F.coalesce((a - b) / 2e6, F.lit(0.0))
    return samples.withColumn("weight_s", gap(F.col("t_us"), F.lag("t_us").over(w)) + gap(F.lead("t_us").over(w), F.col("t_us")))


def summary(samples: DataFrame) -> DataFrame:
    """One row for each uuid: span, speeds (km/h) at start, end, least and greatest, accelerations,
    when the least ones were (first on ties), stopped time and heading change."""
    s = half_gaps(heading(samples))
    at = F.struct("t_us")
    kmh = lambda c: c * 3.6
    out = s.groupBy("uuid").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_us").alias("t0"), ((F.max("t_us") - F.min("t_us")) / 1e6).alias("span_s"),
        kmh(F.min_by("speed", at)).alias("speed_start"), kmh(F.max_by("speed", at)).alias("speed_end"), kmh(F.min("speed")).alias("speed_min"), kmh(F.max("speed")).alias("speed_max"),
        F.min("ax").alias("min_ax"), F.max("ax").alias("max_ax"), F.min_by("t_us", F.struct("ax", "t_us")).alias("t_min_ax"), F.min_by("t_us", F.struct("speed", "t_us")).alias("t_speed_min"),
        F.sum(F.when(F.col("speed") < STOP_SPEED, F.col("weight_s")).otherwise(0.0)).alias("stopped_s"), F.sum("turn").alias("heading_delta"),
    )
    return out.withColumns({"t_min_ax": (F.col("t_min_ax") - F.col("t0")) / 1e6, "t_speed_min": (F.col("t_speed_min") - F.col("t0")) / 1e6}).drop("t0")


def within_windows(samples: DataFrame, windows: DataFrame, min_s: float = 1.0, min_n: int = 2) -> DataFrame:
    """windows (uuid, beg, end) clamped to each uuid's samples, with n and mean speed of the samples inside.

    Windows disjoint from the samples, shorter than min_s after clamping, or with fewer
    than min_n samples give no row; a window given twice counts its samples twice.  Ends of
    windows stand in one line with the samples, and what lies inside is the difference of
    running sums, so windows and samples aren't paired.
    """
    reach = samples.groupBy("uuid").agg(F.min("t_us").alias("first"), F.max("t_us").alias("last"))
    given = windows.groupBy("uuid", "beg", "end").agg(F.count(F.lit(1)).alias("k"))
    clamped = given.join(reach, "uuid").select("uuid", "k", F.struct("beg", "end", F.greatest("beg", "first").alias("lo"), F.least("end", "last").alias("hi")).alias("w")).where((F.col("w.hi") - F.col("w.lo")) / 1e6 >= min_s)
    # at one time windows that begin come before the samples, windows that end after them
    ends = clamped.select("uuid", "k", "w", F.explode(F.array(F.struct(F.col("w.lo").alias("t"), F.lit(-1).alias("side")), F.struct(F.col("w.hi").alias("t"), F.lit(1).alias("side")))).alias("e"))
    line = samples.select("uuid", F.col("t_us").alias("t"), F.lit(0).alias("side"), "speed").unionByName(ends.select("uuid", "e.t", "e.side", "k", "w"), allowMissingColumns=True)
    so_far = Window.partitionBy("uuid").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda x: F.sum(F.when(F.col("side") == 0, x)).over(so_far)
    sums = line.select("uuid", "side", "k", "w", total(F.lit(1)).alias("n"), total(F.col("speed").isNotNull().cast("int")).alias("m"), total(F.col("speed")).alias("v")).where("side <> 0")
    inside = lambda c: F.sum(F.col("side") * F.coalesce(c, F.lit(0)))
    out = sums.groupBy("uuid", "w", "k").agg(inside("n").alias("n"), F.try_divide(inside("v"), inside("m")).alias("speed"))
    return out.select("uuid", "w.*", (F.col("n") * F.col("k")).alias("n"), "speed").where(F.col("n") >= min_n)


def asof(left: DataFrame, right: DataFrame, values: Sequence[str], forward: bool = False) -> DataFrame:
    """left (uuid, t_us, id) with the values of right's nearest row at or before t_us (forward: at or after).

    Both sides are put into one sequence and filled along it: one shuffle and one sort,
    no pairs.  Rows without a match keep nulls; of right rows at one time the last by the
    order of values counts (forward: the first).
    """
    cols = [*values, "at_us"]
    row = F.struct(F.col("t_us").alias("at_us"), *values)
    a = left.select("uuid", "t_us", "id", F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("r"), F.lit(0 if forward else 1).alias("side"))
    b = right.select("uuid", "t_us", F.lit(None).cast(left.schema["id"].dataType).alias("id"), row.alias("r"), F.lit(1 if forward else 0).alias("side"))
    turn = F.desc if forward else F.asc  # forward is backward in reversed time, as only a frame that runs is linear
    frame = Window.partitionBy("uuid").orderBy(turn("t_us"), turn("side"), turn("r")).rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn("m", F.last("r", ignorenulls=True).over(frame))
    return filled.where("id IS NOT NULL").select("uuid", "t_us", "id", *[F.col("m")[c].alias(c) for c in cols])


def horizon(samples: DataFrame, seconds: float) -> DataFrame:
    """uuid, t_us, n, last_us and travelled: the samples from each one up to so many seconds later, where there are two or more."""
    w = _by_time().rangeBetween(0, int(seconds * 1e6))
    out = samples.select("uuid", "t_us", F.count(F.lit(1)).over(w).alias("n"), F.last("t_us").over(w).alias("last_us"), (F.last("x").over(w) - F.first("x").over(w)).alias("travelled"))
    return out.where(F.col("n") >= 2)


def segments(points: DataFrame, valid: Column) -> DataFrame:
    """uuid, segment (from 0), n, from_us, to_us of runs of valid points without an invalid one between."""
    w = _by_time()
    marked = points.withColumn("_ok", F.coalesce(valid, F.lit(False))).withColumn("_no", F.row_number().over(w) - F.sum(F.col("_ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("_ok").groupBy("uuid", "_no").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("from_us"), F.max("t_us").alias("to_us"))
    return runs.select("uuid", (F.row_number().over(Window.partitionBy("uuid").orderBy("_no")) - 1).alias("segment"), "n", "from_us", "to_us")


def gradient(samples: DataFrame, value: str) -> DataFrame:
    """uuid, t_us, slope: central difference by position, one-sided at the ends; null for a single sample."""
    w = _by_time()
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    slope = F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).otherwise(F.coalesce(after - here, here - before))
    return samples.select("uuid", "t_us", slope.alias("slope"))


def yaw_degrees(qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    """Yaw of a quaternion."""
    return F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz)) * (180 / pi)


def into_camera(point: Sequence[Column], quaternion: Sequence[Column], place: Sequence[Column]) -> list[Column]:
    """x, y, z of a vehicle's point as a camera sees it, that stands at place and is turned by the quaternion (x, y, z, w; of any length)."""
    n = F.sqrt(sum((q * q for q in quaternion[1:]), quaternion[0] * quaternion[0]))
    x, y, z, w = (q / n for q in quaternion)
    d = [p - t for p, t in zip(point, place, strict=True)]
    axes = [
        (1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w)),
        (2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w)),
        (2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y)),
    ]  # the camera's axes in the vehicle's system
    return [a * d[0] + b * d[1] + c * d[2] for a, b, c in axes]


def polynomial(coefficients: Column, x: Column) -> Column:
    """A polynomial by Horner's rule, lowest power first."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)


def fisheye(x: Column, y: Column, z: Column, poly: Column, cx: Column, cy: Column, max_angle: Column) -> Column:
    """struct<u, v, visible> of a camera point (z ahead): the image radius is a polynomial of the angle to the axis."""
    flat = F.hypot(x, y)
    theta = F.atan2(flat, z)
    r = polynomial(poly, theta)
    scale = F.when(flat > 0, r / flat).otherwise(F.lit(0.0))
    return F.struct((cx + x * scale).alias("u"), (cy + y * scale).alias("v"), ((theta <= max_angle) & (z > 0)).alias("visible"))


# fixed values: the phrases that describe motion
PHRASES = {
    "span": "Over these {span_s} seconds ",
    "stopped": "the ego-vehicle slowed from {speed_start} km/h and came to a stop",
    "left": "the ego-vehicle pulled away from a stop to {speed_end} km/h",
    "steady": "the ego-vehicle held a steady {speed_max} km/h",
    "range": "the ego-vehicle went from {speed_start} to {speed_end} km/h (range {speed_min}-{speed_max} km/h)",
    "braked": ", with a peak deceleration of {deceleration} m/s^2 about {t_min_ax} s in",
    "turned": ", and turned {side} by {heading_delta} degrees",
    "stood": " It was stationary for about {stopped_s} s of that.",
}


def _phrase(name: str, values: Mapping[str, Column]) -> Column:
    """A phrase with values in it."""
    parts = re.split(r"\{(\w+)\}", PHRASES[name])
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def described(summaries: DataFrame) -> DataFrame:
    """uuid, behaviour, speed_range and motion in words, of what summary gives.

    behaviour says, in this order of choice, that the vehicle stopped, set off, kept its
    speed, or between which speeds it went; then how it braked and turned, and how long it
    stood if it didn't stop for good.  Numbers are whole, halves go to the even one.
    """
    c, none = F.col, F.lit("")
    whole = {n: F.bround(F.abs(n), 0).cast("bigint").cast("string") for n in ("span_s", "speed_start", "speed_end", "speed_min", "speed_max", "t_min_ax", "heading_delta", "stopped_s")}
    values = whole | {"deceleration": F.format_string("%.1f", F.bround(F.abs("min_ax") * 10, 0) / 10), "side": F.when(c("heading_delta") > 0, "left").otherwise("right")}
    say = lambda name: _phrase(name, values)
    stop, creep = STOP_SPEED * 3.6, CREEP_SPEED * 3.6
    stopped, left = (c("speed_start") >= creep) & (c("speed_end") < stop), (c("speed_start") < stop) & (c("speed_end") >= creep)
    core = F.when(stopped, say("stopped")).when(left, say("left")).when(c("speed_max") - c("speed_min") < STEADY_KMH, say("steady")).otherwise(say("range"))
    braked = F.when(c("min_ax") < HARD_BRAKE, say("braked")).otherwise(none)
    turned = F.when(F.abs("heading_delta") >= TURN, say("turned")).otherwise(none)
    stood = F.when((c("stopped_s") >= PAUSE_S) & ~stopped, say("stood")).otherwise(none)
    motion = F.when(c("stopped_s") >= c("span_s") - STILL_S, "stopped").otherwise("moving")
    return summaries.select("uuid", F.concat(say("span"), core, braked, turned, F.lit("."), stood).alias("behaviour"), F.concat_ws("-", values["speed_min"], values["speed_max"]).alias("speed_range"), motion.alias("motion"))


def coverage(clips: DataFrame, **sources: DataFrame) -> DataFrame:
    """One row: n clips, and for each source (uuid) how many it knows and their per cent."""
    rows = clips.select("uuid").distinct()
    for name, source in sources.items():
        rows = rows.join(source.select("uuid", F.lit(True).alias(f"_{name}")).distinct(), "uuid", "left")
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), *[x for name in sources for x in (F.count(f"_{name}").alias(f"with_{name}"), F.try_divide(100 * F.count(f"_{name}"), n).alias(f"percent_{name}"))])
