"""Hard negatives by k-means inverted lists with stored radii.

Rows: (vec_id, label, embedding). A row's score for an anchor is their inner product after each component x became floor(SCALE * x).
An anchor's positives are its POSITIVES best other rows of its label. Its hard negatives for a positive are the NEGATIVES best rows
of other labels whose scores are at least LOW percent of the positive's score and not above it. Higher scores come first, ties go by the
smaller vec_id.

Index: rows of one label and vector are one entry with their least ids (one more than a search returns, as the anchor
itself may be among them; no other row of the entry can be returned), so any number of copies counts once. Lists are those
of k-means centroids, fitted on at most SAMPLE entries; every entry is in the list of its nearest centroid, and each list
stores its radius. Lists are cut into blocks of about ROWS entries.

Search: a row of list C scores q.c + |q| r at most and q.c - |q| r at least, by Cauchy-Schwarz. An anchor first visits its FIRST
lists by the upper bound, of those that reach into its window; then, as it knows its kth score, all others whose upper bound
isn't strictly below it. That is exact. Anchors travel to the blocks of their lists in packs, and what leaves a block is the
best few of each anchor, so no pair of rows is ever a row of a table. What is held on the driver or sent to all tasks is the
sample and at most LISTS centroids, radii and counts.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part. Of several rows of one vec_id the
one of the least label, then vector, takes part. Of vectors of different lengths the missing components count as zero; the product of
the largest norms must be below 2^62, else an error is raised. Anchors without positives, and positives without negatives in
their window, give no rows. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, dropped, partitions, stored

SCALE, POSITIVES, NEGATIVES, LOW, EVERY = 256, 5, 5, 80, 100
#: Entries that k-means is fitted on, rounds of it, most lists, entries of a block of a list, lists of the first visit.
SAMPLE, ROUNDS, LISTS, ROWS, FIRST = 20_000, 8, 1024, 2048, 8
#: Shares into which the rows of one label and vector are dealt before the least ids are taken.
SALT = 16
_FAR = 1 << 62
_NO_ID = np.iinfo(np.int64).max


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, one for each vec_id, with whole components."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")))
    given = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    return given.select("vec_id", F.col("label").cast("int").alias("label"), v.alias("v")).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def shifted(rows: DataFrame, by: int = 7, labels: int = 10) -> DataFrame:
    """rows whose label is one more, modulo `labels`, where vec_id is divisible by `by`."""
    return rows.withColumn("label", F.when(F.col("vec_id") % by == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def entries(rows: DataFrame, ids: int) -> DataFrame:
    """(entry, label, v, ids): one row for each label and vector, with its least ids in order; the first of them names it."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALT))
    least = rows.withColumn("nth", F.row_number().over(Window.partitionBy("label", "v", salt).orderBy("vec_id"))).where(F.col("nth") <= ids)
    found = least.groupBy("label", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, ids).alias("ids"))
    return found.select(F.element_at("ids", 1).alias("entry"), "label", "v", "ids")


def _matrix(vectors: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def fit(vectors: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from k vectors spread over the sample."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(vectors, centroids)
        n = np.bincount(nearest, minlength=k)
        order = np.argsort(nearest, kind="stable")
        some = np.flatnonzero(n)
        centroids[some] = np.add.reduceat(vectors[order], np.r_[0, np.cumsum(n[some])[:-1]], axis=0) / n[some, None]
    return centroids


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, dtype=int), *((vectors[i : i + 4096] @ centroids.T - half).argmax(axis=1) for i in range(0, len(vectors), 4096))])


class Index:
    """The stored lists, and what is known about each of them."""

    def __init__(self, found: DataFrame) -> None:
        spark = found.sparkSession
        n, size, norm = found.agg(F.count("*"), F.max(F.size("v")), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * double(x))"))).first()
        self.n, self.size = n, size or 0
        if (norm or 0) >= _FAR:
            raise ValueError("inner products of these vectors may not fit into 64 bits")
        self.whole = "f8" if (norm or 0) < 1 << 53 else "i8"  # sums of doubles are exact below 2^53
        if not n:
            return
        sample = found.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("v").toPandas()["v"]
        self.centroids = fit(_matrix(sample, self.size), max(1, min(LISTS, len(sample), round(n**0.5))))
        centroids, width = self.centroids, self.size

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = _matrix(pdf["v"], width)
                nearest = _nearest(x, centroids)
                yield pdf.assign(list=nearest.astype(np.int32), apart=np.sqrt(((x - centroids[nearest]) ** 2).sum(axis=1)))

        assigned = stored(found.mapInPandas(assign, "entry long, label int, v array<long>, ids array<long>, list int, apart double"), "assigned")
        known = assigned.groupBy("list").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).toPandas().set_index("list").reindex(range(len(centroids)))
        self.radius, self.blocks = known["radius"].fillna(0).to_numpy(), np.ceil(known["n"].fillna(0) / ROWS).astype(int).to_numpy()
        blocks = F.create_map(*(F.lit(int(x)) for i, b in enumerate(self.blocks) if b > 1 for x in (i, b))) if (self.blocks > 1).any() else None
        block = F.pmod(F.xxhash64("entry"), F.coalesce(blocks[F.col("list")], F.lit(1))).cast("int") if blocks is not None else F.lit(0)
        dealt = assigned.withColumn("block", block).repartition(partitions(spark), "list", "block").sortWithinPartitions("list", "block")
        self.lists = stored(dealt.mapInPandas(_pack(width, self.whole), "list int, block int, labels binary, ids binary, vectors binary"), "lists")
        dropped(assigned)

    def drop(self) -> None:
        if self.n:
            dropped(self.lists)


def _pack(width: int, kind: str):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of one list and block, which come together, into one."""
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            g = pd.concat(held)
            ids = np.full((len(g), POSITIVES + 1), _NO_ID)
            for i, x in enumerate(g["ids"]):
                ids[i, : len(x)] = x
            return pd.DataFrame({"list": g["list"].iloc[:1], "block": g["block"].iloc[:1], "labels": [g["label"].to_numpy("i4").tobytes()], "ids": [ids.tobytes()], "vectors": [_matrix(g["v"], width).astype(kind).tobytes()]})

        for pdf in batches:
            for key, g in pdf.groupby(["list", "block"], sort=False):
                if held and key != (held[0]["list"].iloc[0], held[0]["block"].iloc[0]):
                    yield done()
                    held = []
                held.append(g)
        if held:
            yield done()

    return pack


def _bounds(index: Index):
    centroids, radius, size = index.centroids, index.radius, index.size
    length = np.sqrt((centroids**2).sum(axis=1))

    def bounds(v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each anchor's rows in each list can have, with room for rounding."""
        q = _matrix(v, size)
        norm = np.sqrt((q**2).sum(axis=1))[:, None]
        mid, reach = q @ centroids.T, norm * radius
        reach += 1e-9 * (norm * length + reach) + 1e-6
        return mid - reach, mid + reach

    return bounds


_QUERY = "anchor long, label int, v array<long>, low array<long>, high array<long>, floor array<long>"


def _first_visits(index: Index):
    bounds, some = _bounds(index), index.blocks > 0

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                least, most = bounds(pdf["v"])
                visits = []
                for lo, hi, low, high in zip(least, most, pdf["low"], pdf["high"]):
                    reach = some & (hi >= min(low)) & (lo <= max(high))
                    at = np.flatnonzero(reach)
                    visits.append(at[np.argsort(-hi[at], kind="stable")[:FIRST]].astype(np.int32))
                yield pdf.assign(first=visits)

    return first


def _packed(index: Index, again: bool):
    bounds, blocks = _bounds(index), index.blocks

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each list, the anchors of a batch that visit it: first those of `first`; again, all others that aren't excluded."""
        for pdf in batches:
            if not len(pdf):
                continue
            visit = np.zeros((len(pdf), len(blocks)), dtype=bool)
            if again:
                least, most = bounds(pdf["v"])
                for low, high, floor, lo, hi, out in zip(pdf["low"], pdf["high"], pdf["floor"], least, most, visit):
                    for a, b, c in zip(low, high, floor):
                        out |= (hi >= max(a, c)) & (lo <= b)
                visit &= blocks > 0
            for first, out in zip(pdf["first"], visit):
                out[first] = not again
            for i in np.flatnonzero(visit.any(axis=0)).tolist():
                own = pdf[visit[:, i]]
                yield pd.DataFrame({"list": np.int32(i), "block": np.arange(blocks[i], dtype=np.int32)}).assign(**{c: [own[c].tolist()] * blocks[i] for c in ("anchor", "label", "v", "low", "high", "floor")})

    return pack


def _scores(index: Index, same: bool, k: int):
    size, kind = index.size, index.whole

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k best of a block for each anchor and window of a pack."""
        for pdf in batches:
            for row in pdf.itertuples():
                labels, ids = np.frombuffer(row.labels, "i4"), np.frombuffer(row.ids, "i8").reshape(-1, POSITIVES + 1)
                x = np.frombuffer(row.vectors, kind).reshape(-1, size)
                scores = (_matrix(row.v, size).astype(kind) @ x.T).astype(np.int64)
                out = []
                for anchor, label, lows, highs, floors, s in zip(row.anchor, row.label, row.low, row.high, row.floor, scores):
                    own = np.flatnonzero((labels == label) == same)
                    s = s[own]
                    for nth, (low, high, floor) in enumerate(zip(lows, highs, floors)):
                        at = np.flatnonzero((s >= max(low, floor)) & (s <= high))
                        if len(at) > k + 1:  # the anchor may be an entry of its own
                            at = at[s[at] >= np.partition(s[at], len(at) - k - 1)[len(at) - k - 1]]
                        found = ids[own[at]]
                        score = np.repeat(s[at], found.shape[1])
                        found = found.ravel()
                        keep = (found != _NO_ID) & (found != anchor)
                        found, score = found[keep], score[keep]
                        best = np.lexsort((found, -score))[:k]
                        out.append(pd.DataFrame({"anchor": anchor, "nth": np.int32(nth), "id": found[best], "score": score[best]}))
                if out:
                    yield pd.concat(out)

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """(anchor, nth, id, score, rank): for the nth window [low, high] of each query (anchor, label, v, low, high) the k best rows of
    the same label, or of other labels, without the anchor itself. Exact."""
    spark = queries.sparkSession
    start = queries.withColumn("floor", F.col("low"))
    planned = stored(start.mapInPandas(_first_visits(index), _QUERY + ", first array<int>"), "planned")
    packs = "list int, block int, anchor array<long>, label array<int>, v array<array<long>>, low array<array<long>>, high array<array<long>>, floor array<array<long>>"

    def visit(given: DataFrame, again: bool) -> DataFrame:
        sent = given.mapInPandas(_packed(index, again), packs)
        # Packs grow with the anchors and their table's size on disk says little about them: never a broadcast.
        met = sent.hint("merge").join(index.lists, ["list", "block"])
        return _best(met.mapInPandas(_scores(index, same, k), "anchor long, nth int, id long, score long"), k)

    once = stored(visit(planned, False), "once")
    # Anchors with fewer than k rows so far keep their lower bound.
    kth = once.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("nth", "score"))).alias("kth"))
    floor = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.col("kth")[i.cast("int")], x)))
    rest = visit(planned.join(kth, "anchor", "left").withColumn("floor", floor).drop("kth"), True)
    out = stored(_best(once.drop("rank").unionByName(rest.drop("rank")), k), "found")
    dropped(planned)
    dropped(once)
    return out


def hard_negatives(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, whose vec_id is divisible by `every`."""
    bounded_batches(rows.sparkSession)
    given = stored(prepared(rows), "vectors")
    index = Index(entries(given, POSITIVES + 1))
    if not index.n:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    one = lambda x: F.array(F.lit(x))
    anchors = given.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor"), "label", "v")
    anchors = anchors.repartition(partitions(rows.sparkSession))
    positives = search(anchors.withColumns({"low": one(-_FAR), "high": one(_FAR)}), index, True, POSITIVES)
    # Positives of one score have the same window. Where LOW percent of the score lies above it, nothing can be in the window.
    windows = positives.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("high"))
    low = F.expr(f"transform(high, s -> s div 100 * {LOW} + (s % 100 * {LOW} + 99) div 100)")
    negatives = search(anchors.join(windows.withColumn("low", low), "anchor").select("anchor", "label", "v", "low", "high"), index, False, NEGATIVES)
    scored = negatives.join(windows, "anchor").select("anchor", F.element_at("high", F.col("nth") + 1).alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = positives.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    index.drop()
    dropped(given)
    return of.join(scored, ["anchor", "positive_score"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same rows in DuckDB, by comparing each anchor with every row.
ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
