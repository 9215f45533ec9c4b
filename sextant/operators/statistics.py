"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.storage import stored

#: Cuts of a sketch and its accuracy, rows that one task may sort, and groups whose ranges are broadcast.
CUTS, ACCURACY, FEW, GROUPS = 256, 2048, 50_000, 10_000


def percentiles(df: DataFrame, keys: list[str], value: str, p: float, few: int = FEW) -> DataFrame:
    """(keys, p): the exact percentile of each group's values, interpolated between its two neighbours as `percentile` does.

    A mergeable sketch of the group gives two values between which the rank should lie; then the rows below, at, between and
    above them are counted, which tells exactly where it lies: at one of the two, which is the answer, or in one of the three
    open ranges, which is narrowed in the same way until it has at most `few` rows, and those are sorted. A round leaves about
    one row of CUTS, whatever the distribution, and always fewer than before. Sketches and counts are summed up in the map
    stage, so no task holds more of a group than a sketch or `few` rows. Groups of up to `few` rows take no round.

    Nulls and NaN aren't counted; a group without values has null; without keys there is one row, also for an empty table."""
    v = F.col(value).cast("double")
    rows = df.select(*keys, F.nanvl(v, F.lit(None).cast("double")).alias("v"))
    groups = rows.groupBy(*keys).agg(F.count("v").alias("n"))
    at = F.greatest(F.col("n") - 1, F.lit(0)) * F.lit(float(p))
    none = F.lit(None).cast("double")
    ranks = groups.select(*keys, at.alias("at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"), F.lit(0).cast("bigint").alias("below"), "n", none.alias("lo"), none.alias("hi"), none.alias("found"))
    ranks = stored(ranks, "percentiles")
    open_ = F.col("found").isNull() & (F.col("n") > few)
    settled = [ranks.where(~open_)]
    while not (left := ranks.where(open_)).isEmpty():
        ranks = stored(_narrowed(rows, left, keys), "percentiles")
        settled.append(ranks.where(~open_))
    all_ = settled[0]
    for s in settled[1:]:
        all_ = all_.unionByName(s)
    known = all_.where("found IS NOT NULL OR n = 0").select(*keys, "at", "rank", F.col("found").alias("v"))
    short = _inside(rows, all_.where("found IS NULL AND n > 0"), keys).groupBy(*keys, "at", "rank", "below").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    sorted_ = short.select(*keys, "at", "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
    two = known.unionByName(sorted_).groupBy(*keys, "at").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    share = F.col("at") - F.floor("at")
    return two.select(*keys, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - share) + F.col("b") * share).alias("p"))


def _same(keys: list[str]) -> Column:
    return F.expr(" AND ".join(["true", *[f"l.`{k}` <=> r.`{k}`" for k in keys]]))


def _inside(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The values in each open range, beside it. Ranges, two a group at most, are broadcast up to GROUPS groups."""
    few = ranges.limit(2 * GROUPS + 1).count() <= 2 * GROUPS
    within = F.expr("l.v IS NOT NULL AND (r.lo IS NULL OR l.v > r.lo) AND (r.hi IS NULL OR l.v < r.hi)")
    joined = rows.alias("l").join((F.broadcast(ranges) if few else ranges).alias("r"), _same(keys) & within)
    return joined.select(*[F.col(f"r.`{c}`").alias(c) for c in ranges.columns], F.col("l.v").alias("v"))


def _narrowed(rows: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """Each range, narrowed around its rank."""
    named = [*keys, "at", "rank", "below", "n", "lo", "hi"]
    left = left.select(*named)
    sketch = F.percentile_approx("v", [i / CUTS for i in range(CUTS + 1)], ACCURACY)
    sketches = _inside(rows, left, keys).groupBy(*named).agg(sketch.alias("cuts"))
    place = (F.col("rank") - F.col("below")) / F.col("n") * CUTS
    a = F.get("cuts", F.greatest(F.floor(place) - 1, F.lit(0)).cast("int"))
    b = F.get("cuts", F.least(F.ceil(place) + 1, F.lit(CUTS)).cast("int"))
    cut = stored(sketches.select(*named, a.alias("a"), b.alias("b")), "percentiles")
    count = lambda s: F.count_if(F.expr(s))
    parts = [count("v < a").alias("n0"), count("v = a").alias("n1"), count("v > a AND v < b").alias("n2"), count("v = b AND b > a").alias("n3"), count("v > b").alias("n4")]
    counted = _inside(rows, cut, keys).groupBy(*named, "a", "b").agg(*parts)
    # The five parts in order, each with what is below it; the rank lies in the last one that begins at it or before.
    bounds = [("lo", "a", None), (None, None, "a"), ("a", "b", None), (None, None, "b"), ("b", "hi", None)]
    value = lambda c: (F.col(c) if c else F.lit(None)).cast("double")
    out, before = [], F.col("below")
    for i, (lo, hi, found) in enumerate(bounds):
        out.append(F.struct(before.alias("below"), F.col(f"n{i}").alias("n"), value(lo).alias("lo"), value(hi).alias("hi"), value(found).alias("found")))
        before = before + F.col(f"n{i}")
    held = F.filter(F.array(*out), lambda s: (s["n"] > 0) & (F.col("rank") >= s["below"]) & (F.col("rank") < s["below"] + s["n"]))
    return counted.select(*keys, "at", "rank", F.get(held, F.lit(0)).alias("h")).select(*keys, "at", "rank", "h.*")
