"""A stored index for ranked search that is built once, grows and shrinks, and answers any number of query tables without the documents.

Layout, in a folder that all executors see: each segment is a table of blocks, one for each term and range of items, with
the postings (item, count, length) and what bounds them: the largest count, the least length, the largest count over the
item's vector length. A range holds some RANGE items of like length, so that bounds are tight. Each version has a table of terms with
their document frequencies, one of items, and a manifest, written last: a job that dies before leaves the version before it
as it was. Old versions stay readable; `vacuum` deletes what the last one doesn't use.

Search: for each query the blocks of its terms give a bound for each range, without reading postings. The FIRST ranges by
bound are scored whole; the kth score found there excludes every range whose bound is below it, and the rest is scored. So
the result is that of scoring everything. Scores are those of `ranking.bm25` and `ranking.tfidf`.

Defined results: null and empty texts are items without terms. Rows of one item id are one item whose counts and lengths
add up; rows without an id aren't indexed. An item that is appended again without being deleted is an error of the caller: its counts
add up, too. Queries without a known term have no rows. Ties go to the smaller item.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions.text import tokens
from sextant.operators import ranking
from sextant.storage import dropped, shared_folder, stored

#: Items of a range; ranges that a query scores before it knows a bound; distinct query terms up to which they are pushed to the scan.
RANGE, FIRST, FEW = 512, 4, 1000
#: Sums in another order may differ by so much.
SLACK = 1e-7
#: What takes a text's terms, by the name that the manifest keeps.
ANALYSERS: dict[str, Callable[[Column], Column]] = {"words": tokens, "words_of_two": ranking.words_of_two}


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _counted(words: DataFrame, repeated: DataFrame) -> DataFrame:
    """words (item_id, ts) as (item_id, dl, size, length, counts): the distinct terms of each item with their counts, and the length of
    its vector of counts. A row's terms are sorted and counted where they are; only rows of repeated ids are brought together."""
    few = [r.item_id for r in repeated.limit(FEW + 1).collect()]
    if few:
        own = lambda how: words.where(F.col("item_id").isin(few) if how == "left_semi" else ~F.col("item_id").isin(few)) if len(few) <= FEW else words.join(repeated, "item_id", how)
        merged = own("left_semi").groupBy("item_id").agg(F.flatten(F.collect_list("ts")).alias("ts"))
        words = own("left_anti").unionByName(merged)
    line = words.select("item_id", F.size("ts").cast("long").alias("dl"), F.array_sort("ts").alias("ts"))
    begins = F.filter(F.transform("ts", lambda t, i: F.when((i == 0) | (t != F.get("ts", i - 1)), i)), lambda i: i.isNotNull())
    line = line.withColumn("begins", begins)
    counts = F.transform("begins", lambda b, j: F.struct(F.get("ts", b).alias("term"), (F.coalesce(F.get("begins", j + 1), F.col("dl")) - b).cast("long").alias("tf")))
    size = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda s, c: s + c["tf"] * c["tf"]))
    line = line.withColumn("counts", counts).withColumn("size", size)
    return line.select("item_id", "dl", "size", F.floor(F.log2(F.col("dl") + 1)).cast("long").alias("length"), "counts")


class SearchIndex:
    """One version of an index. `build` makes the first one, `open` finds the last one; `append` and `delete` return the next."""

    def __init__(self, spark: SparkSession, path: str, state: dict) -> None:
        self.spark, self.path, self.state = spark, path, state

    @classmethod
    def build(cls, docs: DataFrame, path: str, analyser: str = "words", key: str = "doc_id", text: str = "text") -> SearchIndex:
        start = cls(docs.sparkSession, path, {"version": 0, "analyser": analyser, "segments": [], "gone": None, "terms": None, "items": None, "n": 0, "total": 0})
        return start.append(docs, key, text)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SearchIndex:
        fs, at = _fs(spark, f"{path}/manifest")
        whole = [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(_fs(spark, f"{path}/manifest/{s.getPath().getName()}/_SUCCESS")[1])]
        return cls(spark, path, spark.read.parquet(f"{path}/manifest/{max(whole)}").first().asDict())

    def _write(self, df: DataFrame, name: str) -> str:
        at = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return at

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.state[name])

    def append(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> SearchIndex:
        """The version with the rows of docs added, which are read once."""
        given = docs.where(F.col(key).isNotNull())
        words = given.select(F.col(key).alias("item_id"), ANALYSERS[self.state["analyser"]](F.col(text)).alias("ts"))
        counts = stored(_counted(words, given.groupBy(F.col(key).alias("item_id")).count().where("count > 1").select("item_id")), "counts")
        # One row for each class of lengths, of which there are 64 at most.
        shares = F.broadcast(counts.groupBy("length").agg(F.ceil(F.count("*") / RANGE).alias("shares")))
        segment = len(self.state["segments"])
        place = F.lit(segment << 48) + F.col("length") * (1 << 40) + F.pmod(F.xxhash64("item_id"), F.col("shares"))
        each = counts.join(shares, "length").select("item_id", "dl", "size", place.alias("range"), F.explode("counts").alias("c"))
        # Dealt out as rows: lists that are gathered before the shuffle have one posting each, and take twice the room.
        each = each.select("item_id", "dl", "size", "range", "c.term", "c.tf").repartition("term", "range")
        blocks = each.groupBy("term", "range").agg(
            F.max("tf").alias("top_tf"), F.min("dl").alias("least_dl"), F.max(F.col("tf") / F.col("size")).alias("top_weight"), F.collect_list(F.struct("item_id", "tf", "dl")).alias("postings")
        )
        at = self._write(blocks.sortWithinPartitions("term", "range"), "segment")
        items = stored(counts.select("item_id", "dl"), "lengths")
        dropped(counts)
        more = items
        if self.state["items"]:
            more = more.unionByName(self._read("items").select("item_id", "dl"))
        out = self._next(more, {"segments": [*self.state["segments"], at]})
        dropped(items)
        return out

    def delete(self, items: DataFrame, key: str = "item_id") -> SearchIndex:
        """The version without these items. Their postings stay in their blocks and are passed over."""
        more = items.select(F.col(key).alias("item_id")).where("item_id is not null").distinct()
        if self.state["gone"]:
            more = more.unionByName(self._read("gone")).distinct()
        gone = self._write(more, "gone")
        left = self._read("items").select("item_id", "dl").join(self.spark.read.parquet(gone), "item_id", "left_anti")
        return self._next(left, {"gone": gone})

    def _next(self, items: DataFrame, change: dict) -> SearchIndex:
        """Writes what depends on all segments, then the manifest."""
        new = SearchIndex(self.spark, self.path, self.state | change | {"version": self.state["version"] + 1})
        if new.state["gone"]:
            df = new._postings(new._blocks()).groupBy("term").agg(F.count("*").alias("df"))
        else:
            df = new._blocks().groupBy("term").agg(F.sum(F.size("postings")).cast("long").alias("df"))
        new.state["terms"] = new._write(df, "terms")
        n, total = items.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        new.state |= {"n": n, "total": total}
        # A block has its term once, so a frequent term meets its weight in as many rows as it has blocks.
        weighed = new._blocks().join(new._read("terms").select("term", new._idf().alias("idf")), "term")
        norms = new._postings(weighed, "idf").groupBy("item_id").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
        new.state["items"] = new._write(items.join(norms, "item_id", "left"), "items")
        schema = "version int, analyser string, segments array<string>, gone string, terms string, items string, n long, total long"
        names = [c.split()[0] for c in schema.split(", ")]
        self.spark.createDataFrame([tuple(new.state[c] for c in names)], schema).coalesce(1).write.parquet(f"{self.path}/manifest/{new.state['version']:08d}")
        return new

    def vacuum(self) -> None:
        """Deletes the tables that this version doesn't use. No other version can be read afterwards."""
        used = {x.rstrip("/").rpartition("/")[2] for x in [*self.state["segments"], self.state["gone"], self.state["terms"], self.state["items"]] if x} | {"manifest"}
        for folder, keep in ((self.path, used), (f"{self.path}/manifest", {f"{self.state['version']:08d}"})):
            fs, at = _fs(self.spark, folder)
            for status in fs.listStatus(at):
                if status.getPath().getName() not in keep:
                    fs.delete(status.getPath(), True)

    def _idf(self) -> Column:
        return F.log((1 + F.lit(self.state["n"])) / (1 + F.col("df"))) + 1

    def _blocks(self) -> DataFrame:
        return self.spark.read.parquet(*self.state["segments"])

    def _postings(self, blocks: DataFrame, *columns: str) -> DataFrame:
        """(term, columns, item_id, tf, dl) of the items that aren't deleted."""
        each = blocks.select("term", *columns, F.explode("postings").alias("p")).select("term", *columns, "p.*")
        return each.join(self._read("gone"), "item_id", "left_anti") if self.state["gone"] else each

    def _search(self, asked: DataFrame, bound: Column, part: Column, k: int, finish: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
        """asked (query_id, term, w); bound and part: what a block can give to a score at most, and what a posting gives."""
        asked = stored(asked, "asked")
        blocks = self._blocks()
        few = [r.term for r in asked.select("term").distinct().limit(FEW + 1).collect()]
        if len(few) <= FEW:
            blocks = blocks.where(F.col("term").isin(few))
        met = asked.join(blocks.select("term", "range", "top_tf", "least_dl", "top_weight"), "term")
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
        bounds = stored(met.groupBy("query_id", "range").agg(F.sum(bound).alias("bound")).withColumn("nth", F.row_number().over(best)), "bounds")

        def scored(ranges: DataFrame) -> DataFrame:
            wanted = ranges.select("query_id", "range").join(asked, "query_id")
            found = self._postings(wanted.join(blocks.select("term", "range", "postings"), ["term", "range"]), "query_id", "w")
            return finish(found.groupBy("query_id", "item_id").agg(F.sum(part).alias("score"))).select("query_id", "item_id", "score")

        once = stored(ranking.top_k(scored(bounds.where(F.col("nth") <= FIRST)), k), "once")
        kth = once.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        rest = bounds.where(F.col("nth") > FIRST).join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK))
        out = stored(ranking.top_k(once.select("query_id", "item_id", "score").unionByName(scored(rest)), k), "ranked")
        for table in (asked, bounds, once):
            dropped(table)
        return out

    def bm25(self, queries: DataFrame, k: int, key: str = "item_id", text: str = "text") -> DataFrame:
        """The k best items of each query by BM25, as `ranking.bm25` scores them."""
        n, mean = self.state["n"], self.state["total"] / max(self.state["n"], 1) or 1.0
        q = ranking.query_terms(queries, key, ANALYSERS[self.state["analyser"]](F.col(text)))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = q.join(self._read("terms"), "term").select("query_id", "term", (F.col("qn") * idf).alias("w"))
        gives = lambda tf, dl: F.col("w") * F.col(tf) * (ranking.K1 + 1) / (F.col(tf) + ranking.K1 * (1 - ranking.B + ranking.B * F.col(dl) / mean))
        return self._search(asked, gives("top_tf", "least_dl"), gives("tf", "dl"), k)

    def tfidf(self, queries: DataFrame, k: int, key: str = "item_id", text: str = "text") -> DataFrame:
        """The k best items of each query by cosine, as `ranking.tfidf` scores them. As no idf is below 1, an item's norm is at
        least the length of its vector of counts, and a block's largest count over that length bounds what it gives."""
        q = ranking.query_terms(queries, key, ANALYSERS[self.state["analyser"]](F.col(text)))
        weighed = q.join(self._read("terms").select("term", self._idf().alias("idf")), "term").withColumn("qw", F.col("qn") * F.col("idf"))
        length = F.sqrt(F.sum(F.col("qw") ** 2).over(Window.partitionBy("query_id")))
        asked = weighed.select("query_id", "term", (F.col("idf") * F.col("qw") / length).alias("w"))
        norms = self._read("items").select("item_id", "norm")
        return self._search(asked, F.col("w") * F.col("top_weight"), F.col("w") * F.col("tf"), k, lambda x: x.join(norms, "item_id").withColumn("score", F.col("score") / F.col("norm")))


_KNOWN: dict[tuple, object] = {}


def known(docs: DataFrame, kind: tuple, build: Callable[[], object]):
    """What `build` made of a table in files at the first call of the session; it is made anew once the files differ in name, length
    or time."""
    spark = docs.sparkSession
    files = []
    for name in docs.inputFiles():
        fs, at = _fs(spark, name)
        status = fs.getFileStatus(at)
        files.append((name, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, tuple(files), docs.semanticHash(), *kind)
    if key not in _KNOWN:
        _KNOWN[key] = build()
    return _KNOWN[key]


def index_of(docs: DataFrame, analyser: str, key: str = "doc_id", text: str = "text") -> SearchIndex:
    """The index of a table in files, built at the first call of the session."""
    return known(docs, ("ranked", analyser, key, text), lambda: SearchIndex.build(docs, f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}", analyser, key, text))
