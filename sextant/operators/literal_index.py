"""A stored index for literal search: which texts hold a line with a text, without reading the others.

Texts are stored as they are, RANGE of them in a row as a block. Each block's distinct runs of three folded characters (shorter ones at
the ends of lines) are taken where it lies, and postings are lists of blocks for each run and range of blocks, so that they are small
beside the texts and a run that every block has is many lists of a bounded size. A text of three characters or more can only
stand in blocks that have all of its runs: the lists of a range are intersected, and the lines of what is left are compared. A shorter text stands
where a run begins with it.

Case is smart: a text with a capital must match as it is, others match in any case. Defined results: null texts have no
lines, rows without an id aren't indexed, empty texts match nothing, and a text that holds a line break matches nothing. Rows of one id have
their own lines each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.operators import ranking
from sextant.operators.search_index import known
from sextant.storage import shared_folder, stored

RUN = 3
#: Texts of a block; blocks up to which their numbers are pushed to the scan; blocks of a range.
RANGE, FEW, BLOCKS = 256, 1000, 4096


def _folded(text: Column) -> Column:
    """Lower case in which a text within another stays within it: only the sigma depends on what stands beside it."""
    return F.translate(F.lower(text), "ς", "σ")


def _keys(text: str) -> np.ndarray:
    """The runs of a text's lines, each as a number: three code points of 21 bits, one more than they are, and zero beyond a line's end."""
    points = np.frombuffer((text + "\n\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) + 1
    a, b, c = points[:-2], points[1:-1], points[2:]
    b = np.where(b == 11, 0, b)
    keys = (a << 42) | (b << 21) | np.where((b == 0) | (c == 11), 0, c)
    return keys[a != 11]


def _block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, block): the distinct runs of each block of a batch."""
    for batch in batches:
        blocks, texts = batch.column("block").to_numpy(), batch.column("folded")
        for block in np.unique(blocks):
            at = np.flatnonzero(blocks == block)
            runs = np.unique(_keys("\n".join(texts.take(pa.array(at)).to_pylist())))
            yield pa.RecordBatch.from_pydict({"run": pa.array(runs), "block": pa.array(np.full(len(runs), block))})


def _term_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, need, run): the whole runs of each term and their number; of one with less than a run its start, and its length below zero."""
    for batch in batches:
        for term, folded in zip(batch.column("term").to_pylist(), batch.column("folded").to_pylist()):
            keys = _keys(folded)
            if len(folded) < RUN:
                start = keys[:1] >> (21 * (RUN - len(folded)))
                yield pa.RecordBatch.from_pydict({"term": pa.array([term] * len(start), pa.string()), "need": pa.array([-len(folded)] * len(start), pa.int32()), "run": pa.array(start)})
                continue
            keys = np.unique(keys[keys & 0x1FFFFF > 0])
            yield pa.RecordBatch.from_pydict({"term": pa.array([term] * len(keys), pa.string()), "need": pa.array([len(keys)] * len(keys), pa.int32()), "run": pa.array(keys)})


def _query_hits(asked: dict[str, list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """asked: the queries of each term, by number."""
    masks = {t: sum(1 << q for q in set(qs)) for t, qs in asked.items() if t and "\n" not in t}
    exact, folded = ({t: m for t, m in masks.items() if (t != t.lower()) == big} for big in (True, False))

    def matcher(terms: dict[str, int]) -> Callable[[str], int]:
        """The queries of the terms that a line holds: terms without white space are looked up by the words that hold them."""
        single = {t: m for t, m in terms.items() if t.split() == [t]}
        spaced = [(t, m) for t, m in terms.items() if t not in single]
        lengths, seen = sorted({len(t) for t in single}), {}

        def word(w: str) -> int:
            found = 0
            for n in lengths:
                for i in range(len(w) - n + 1):
                    found |= single.get(w[i : i + n], 0)
            if len(seen) > 200_000:
                seen.clear()
            seen[w] = found
            return found

        def line(x: str) -> int:
            found = 0
            for w in x.split() if single else ():
                m = seen.get(w)
                found |= word(w) if m is None else m
            for t, m in spaced:
                if t in x:
                    found |= m
            return found

        return line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query, item_id, lines): the numbers of an item's lines with a term of each query."""
        as_is, any_case = matcher(exact), matcher(folded)
        for batch in batches:
            at, queries, sizes, flat = [], [], [], []

            def rows() -> pa.RecordBatch:
                lines = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat, pa.int32()))
                return pa.RecordBatch.from_pydict({"query": pa.array(queries, pa.int64()), "item_id": batch.column("item_id").take(pa.array(at, pa.int64())), "lines": lines})  # noqa: B023

            for i, (text, low) in enumerate(zip(batch.column("text").to_pylist(), batch.column("low").to_pylist())):
                found: dict[int, list[int]] = {}
                for n, (x, y) in enumerate(zip(text.split("\n"), low.split("\n")), start=1):
                    m = any_case(y) | (as_is(x) if exact else 0)
                    if m:
                        found.setdefault(m, []).append(n)
                own: dict[int, list[int]] = {}
                for m, numbers in found.items():
                    while m:
                        bit = m & -m
                        own.setdefault(bit.bit_length() - 1, []).extend(numbers)
                        m ^= bit
                for q, numbers in own.items():
                    at.append(i)
                    queries.append(q)
                    sizes.append(len(numbers))
                    flat += numbers
                if len(flat) > 500_000:
                    yield rows()
                    at, queries, sizes, flat = [], [], [], []
            yield rows()

    return run


class LiteralIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.texts, self.blocks = spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/blocks")

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> LiteralIndex:
        spark = docs.sparkSession
        given = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("item_id"), F.col(text).alias("text"))
        numbered = given.withColumn("number", F.monotonically_increasing_id())
        numbered.select("item_id", "text", F.floor(F.col("number") / RANGE).cast("long").alias("block")).write.parquet(f"{path}/texts")
        texts = spark.read.parquet(f"{path}/texts")
        ranges = max(1, -(-texts.count() // (RANGE * BLOCKS)))
        each = texts.select("block", _folded(F.col("text")).alias("folded")).mapInArrow(_block_runs, "run bigint, block bigint")
        each = each.select("run", "block", F.pmod(F.xxhash64("block"), F.lit(ranges)).alias("range"))
        # A block that two tasks read in parts is listed once.
        each.groupBy("run", "range").agg(F.collect_set("block").alias("numbers")).sortWithinPartitions("run").write.parquet(f"{path}/blocks")
        return cls(spark, path)

    def _met(self, texts: DataFrame) -> DataFrame:
        """(block): the blocks that can hold one of texts (term)."""
        asked = texts.select("term").where(F.length("term") > 0).distinct().withColumn("folded", _folded(F.col("term")))
        runs = asked.mapInArrow(_term_runs, "term string, need int, run bigint")
        met = runs.where("need > 0").join(self.blocks, "run").groupBy("term", "range").agg(F.max("need").alias("need"), F.array_sort(F.collect_list(F.struct(F.size("numbers").alias("n"), "numbers"))).alias("lists"))
        all_ = met.where(F.size("lists") == F.col("need"))
        both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0]["numbers"], lambda a, b: F.array_intersect(a, b["numbers"]))
        found = all_.select(F.explode(both).alias("block"))
        for n in range(1, RUN):
            short = runs.where(F.col("need") == -n).select(F.col("run").alias("start"))
            begins = self.blocks.select("numbers", F.shiftright("run", 21 * (RUN - n)).alias("start"))
            found = found.unionByName(begins.join(F.broadcast(short), "start", "left_semi").select(F.explode("numbers").alias("block")))
        return found.distinct()

    def _read(self, texts: DataFrame) -> DataFrame:
        """The stored texts of the blocks that can hold one of texts (term)."""
        met = stored(self._met(texts), "met")
        few = [r.block for r in met.limit(FEW + 1).collect()]
        return self.texts.where(F.col("block").isin(few)) if len(few) <= FEW else self.texts.join(ranking.small(met), "block", "left_semi")

    def candidates(self, texts: DataFrame) -> DataFrame:
        """(term, item_id, line_no, line): the lines of those blocks that hold one of texts (term), in any case."""
        lines = self._read(texts).select("item_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        asked = texts.select("term").where(F.length("term") > 0).distinct()
        return lines.join(F.broadcast(asked), F.contains(_folded(F.col("line")), _folded(F.col("term")))).select("term", "item_id", (F.col("at") + 1).alias("line_no"), "line")

    def search(self, texts: DataFrame) -> DataFrame:
        """(term, item_id, line_no, line) for all lines that hold one of texts (term)."""
        same = F.when(F.col("term") == F.lower("term"), F.contains(F.lower("line"), F.col("term"))).otherwise(F.contains("line", F.col("term")))
        return self.candidates(texts).where(same)

    def hits(self, wanted: DataFrame) -> DataFrame:
        """(query_id, item_id, lines): the numbers of the lines that hold one of a query's texts, for wanted (query_id, term). A row of the
        index is read once for all queries, and no line leaves its task. The texts asked for are held by each task."""
        asked, queries = {}, {}
        for r in wanted.select("query_id", "term").distinct().collect():
            asked.setdefault(r.term, []).append(queries.setdefault(r.query_id, len(queries)))
        asked.pop(None, None)
        kind = self.texts.schema["item_id"].dataType.simpleString()
        rows = self._read(wanted).select("item_id", "text", F.lower("text").alias("low"))
        found = rows.mapInArrow(_query_hits(asked), f"query bigint, item_id {kind}, lines array<int>")
        names = self.texts.sparkSession.createDataFrame([(n, q) for q, n in queries.items()], f"query bigint, query_id {wanted.schema['query_id'].dataType.simpleString()}")
        return found.join(F.broadcast(names), "query").select("query_id", "item_id", "lines")

    def grep(self, words: list[str], key: str = "doc_id", per_item: int = 40) -> DataFrame:
        """What `ranking.grep` returns, for items of distinct ids."""
        hits = self.search(self.texts.sparkSession.createDataFrame([(w,) for w in words], "term string")).select("item_id", "line_no", "line").distinct()
        nth = F.row_number().over(Window.partitionBy("item_id").orderBy("line_no"))
        return hits.withColumn("nth", nth).where(F.col("nth") <= per_item).select(F.col("item_id").alias(key), "line_no", "line")


def literal_index_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> LiteralIndex:
    """The index of a table in files, built at the first call of the session."""
    return known(docs, ("literal", key, text), lambda: LiteralIndex.build(docs, f"{shared_folder(docs.sparkSession)}/literal-{uuid.uuid4().hex}", key, text))
