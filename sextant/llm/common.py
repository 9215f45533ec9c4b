"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.storage import dropped, shared_folder, stored

__all__ = ["dropped", "shared_folder", "stored"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Documents up to this length are learned from first, and it bounds what a sample holds in all. All are scored whole.
LEARN_CHARS = 20_000

#: Arrow batches are bounded by rows and by bytes, so that a run of long texts never fills a worker.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds: the held-out rule."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """At most `bound` rows, one for each labelled document outside the held-out fold, as (doc_id, text, y); y is 0 or 1. Only
    documents that are there count towards the bound. They are taken in the order of a hash of doc_id, so that the choice
    depends on nothing else, those of up to LEARN_CHARS characters before longer ones, as far as the texts have no more than
    `bound` times LEARN_CHARS characters together: long texts are learned from, whole, where there aren't enough others. Of
    several labels of one document the largest counts, of several texts of one doc_id a shorter one, then that with the smallest
    hash; null labels and labels without a document are ignored. What is broadcast has `bound` rows at most."""
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    text = F.coalesce("text", F.lit(""))
    n, h = F.length(text), F.xxhash64(text)
    one = docs.groupBy("doc_id").agg(F.min(F.struct((n > LEARN_CHARS).alias("long"), h.alias("h"), n.alias("n"))).alias("one"))
    order = ["long", F.xxhash64("doc_id"), "doc_id"]
    first = one.join(known, "doc_id").select("doc_id", "y", "one.*").orderBy(*order).limit(bound)
    chars = F.sum(F.col("n").cast("bigint")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    keep = first.withColumn("chars", chars).where(F.col("chars") <= bound * LEARN_CHARS).select("doc_id", "y", "h")
    found = docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text")).join(F.broadcast(keep), ["doc_id", "h"])
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def sample_of(docs: DataFrame, keep: Column, group: Column, each: int, buckets: int = 4096) -> DataFrame:
    """(doc_id, g, nth): for each value of `group` at most `each` ids of rows with `keep`, known by nth from 1. Ids are dealt to
    buckets by a hash, each bucket keeps its smallest, and those are taken in the order of the hash: partial sums of a bounded
    size, however many rows an id or a group has."""
    h = F.xxhash64("doc_id")
    least = docs.where(keep & F.col("doc_id").isNotNull()).select("doc_id", group.alias("g"), h.alias("h")).groupBy("g", F.pmod("h", F.lit(buckets)).alias("b")).agg(F.min(F.struct("h", "doc_id")).alias("one"))
    nth = F.row_number().over(Window.partitionBy("g").orderBy("one.h", "one.doc_id"))
    return least.select("one.doc_id", "g", nth.alias("nth")).where(F.col("nth") <= each)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have yet."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
