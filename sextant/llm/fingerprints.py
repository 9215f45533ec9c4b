"""Document fingerprints from prefix polynomial hashes.

For the code points c_0..c_{n-1} of a text and a base b, the prefix array S[i] = sum of (c_j + 1) b^j over j < i, modulo
the prime 2^31 - 1, answers the hash of any span as (S[j] - S[i]) b^-i: two subtractions and a product. Two bases give 62
bits. From one array come the hash of the whole text, the equality of any two spans, the longest common extension of two
positions (binary search) and the hashes of all spans of SPAN code points, whose SKETCH smallest (mixed) values are the
likeness part of a fingerprint.

A fingerprint is "length.hash.sketch" in hex. Equal texts have equal fingerprints; `likeness` of two fingerprints is 1 for
equal ones, else the Dice coefficient that the two bottom-k sketches estimate.

Defined results: a null text counts as empty. An empty text is like another empty text (1) and like nothing else (0). A
text shorter than SPAN is one span. Repeated rows and ties of doc_id are ordered by their text; rows of one id lie in one
task, which holds two of them at a time. Null ids come last and stay null; ids are whole at any size. Texts of any length
are taken whole, in memory of some 60 bytes for each code point. An empty table gives no rows. Extra columns are ignored by
`fingerprint_edits` and kept by `with_fingerprint`, whose own column takes a free name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, fresh, partitions

PRIME = (1 << 31) - 1
BASES = (1_000_003, 914_067_379)
SPAN, SKETCH = 24, 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_P, _31 = np.uint64(PRIME), np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime, for x < 2^62, without a division."""
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    x[x >= _P] -= _P
    return x


class _Powers:
    """Powers of a base and of its inverse, grown on demand by doubling."""

    def __init__(self, base: int) -> None:
        self.up, self.down = (self._start(b) for b in (base, pow(base, -1, PRIME)))
        self.of = (base, pow(base, -1, PRIME))

    @staticmethod
    def _start(b: int) -> np.ndarray:
        return np.array([1, b], dtype=np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) <= n:
            m = len(self.up)
            self.up, self.down = (np.concatenate([a, _mod(a * np.uint64(pow(b, m, PRIME)))]) for a, b in zip((self.up, self.down), self.of))


_POWERS = tuple(_Powers(b) for b in BASES)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, codes: np.ndarray, head: tuple[PrefixHash, int] | None = None) -> None:
        """head: another text's arrays and how many of its code points this text begins with."""
        self.n = len(codes)
        first = head[1] if head else 0
        plus = codes[first:].astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, p in enumerate(_POWERS):
            p.reach(self.n)
            old = head[0].sums[k][: first + 1] if head else np.zeros(1, dtype=np.uint64)
            self.sums.append(np.concatenate([old, _mod(np.cumsum(_mod(plus * p.up[first : self.n])) + old[-1])]))
        self.head = head

    def span(self, i: int, j: int) -> int:
        """Hash of code points i to j-1."""
        out = 0
        for s, p in zip(self.sums, _POWERS):
            out = out << 31 | (int(s[j]) - int(s[i])) % PRIME * int(p.down[i]) % PRIME
        return out

    def whole(self) -> int:
        return self.span(0, self.n)

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """The longest length at which the spans from i here and from j there are equal: binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def spans(self) -> np.ndarray:
        """Mixed 64-bit hashes of all spans of SPAN code points; of the whole text if it is shorter."""
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        w = min(SPAN, self.n)
        first = max(0, self.head[1] - w + 1) if self.head and min(SPAN, self.head[0].n) == w else 0
        out = np.zeros(self.n - w + 1 - first, dtype=np.uint64)
        for s, p in zip(self.sums, _POWERS):
            out = out << _31 | _mod(_mod(s[first + w :] + _P - s[first : self.n + 1 - w]) * p.down[first : first + len(out)])
        out *= _MIX[0]
        out ^= out >> np.uint64(32)
        out *= _MIX[1]
        out ^= out >> np.uint64(29)
        return np.concatenate([self.head[0].hashes[:first], out]) if first else out

    @property
    def hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            self._hashes = self.spans()
        return self._hashes

    def sketch(self) -> np.ndarray:
        """The SKETCH smallest distinct span hashes, their upper 32 bits, ascending."""
        h, share = self.hashes, 6 * SKETCH
        while True:
            some = h if len(h) <= share else h[h < np.uint64(min((1 << 64) - 1, (share << 64) // len(h)))]
            low = np.unique((some >> np.uint64(32)).astype(np.uint32))
            if len(low) >= SKETCH or len(some) == len(h):
                return low[:SKETCH]
            share *= 8


def render(h: PrefixHash) -> str:
    return f"{h.n:x}.{h.whole():016x}.{h.sketch().astype('>u4').tobytes().hex()}"


def _dice(a: np.ndarray, b: np.ndarray) -> float:
    both = np.union1d(a, b)[:SKETCH]
    if not len(a) or not len(b):
        return 0.0
    j = np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).size / both.size
    return 2 * j / (1 + j)


def likeness(a: str, b: str) -> float:
    """0 to 1: how much of two texts is shared, from their fingerprints alone."""
    if a == b:
        return 1.0
    return _dice(*(np.frombuffer(bytes.fromhex(x.rpartition(".")[2]), dtype=">u4").astype(np.uint32) for x in (a, b)))


def fingerprint(text: str | None) -> str:
    return render(PrefixHash(codes_of(text or "")))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of a text column, for any DataFrame."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(fingerprint, na_action=None)

    return of(F.coalesce(text, F.lit("")))


def _buckets(key: Column, bounds: list[int]) -> Column:
    """How many bounds exceed the key, found in two steps of a root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    # One literal each, however many bounds there are.
    all_, coarse = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in (bounds, bounds[step - 1 :: step]))
    first = F.size(F.filter(coarse, lambda b: b > key)) * step
    return (first + F.size(F.filter(F.slice(all_, first + 1, F.lit(step)), lambda b: b > key))).cast("int")


def in_descending_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Deals rows into ranges of the key, sorted within each partition, as (bucket, halo, key, text). The first row of each
    range comes again (halo) at the end of the range before, and the very first after the very last, so that every row has
    its successor beside it without a window over the whole table. Ranges come from approximate quantiles, four for each
    shuffle partition; the driver sees those and one id for each range."""
    spark = docs.sparkSession
    parts = partitions(spark)
    low = -(1 << 63)
    # The id goes on as text: a column of integers with nulls would be one of doubles in pandas.
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(low)).alias("k"), F.col(key).cast("bigint").cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cuts = [i / (4 * parts) for i in range(1, 4 * parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("k", cuts, 40 * parts + 10_000)).first()[0] or []), reverse=True)
    rows = rows.select(_buckets(F.col("k"), bounds).alias("b"), "k", "id", "t") if bounds else rows.select(F.lit(0).alias("b"), "k", "id", "t")
    heads = sorted((r.b, r.k) for r in rows.groupBy("b").agg(F.max("k").alias("k")).collect())
    before = [(heads[i - 1][0], k) for i, (_, k) in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(before, "target int, k bigint"))
    return (
        rows.join(table, "k", "left")
        .select("id", "t", "k", F.explode(F.array_compact(F.array(F.struct(F.col("b"), F.lit(False).alias("halo")), F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("b"), F.lit(True).alias("halo")))))).alias("at"))
        .select("at.b", "at.halo", "k", "id", "t")
        .repartition(parts, "b")
        .sortWithinPartitions("b", "halo", F.desc("k"), "t")
        .select("b", "halo", "id", "t")
    )


SCHEMA = "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_prefix bigint"


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None
    for pdf in batches:
        out = []
        for bucket, halo, doc_id, text in zip(pdf["b"], pdf["halo"], pdf["id"], pdf["t"]):
            codes = codes_of(text)
            now = (bucket, halo, doc_id, text, codes, h := PrefixHash(codes), render(h))
            if last and last[0] == bucket and not last[1]:
                out.append(_row(last, now))
            last = now
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_prefix"])


def _row(this: tuple, following: tuple) -> tuple:
    _, _, doc_id, text, codes, h, mark = this
    n, change = h.n, h.n // 2
    edited = text[: n - change] + following[3][:change]
    e = PrefixHash(np.concatenate([codes[: n - change], following[4][:change]]), (h, n - change))
    return (doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, edit_mark := render(e), likeness(mark, edit_mark), likeness(mark, following[6]), h.common_extension(0, e, 0))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (its last half replaced from the next document in descending order of
    the key) and their likeness; see SCHEMA, with doc_id as bigint. kept_prefix is the longest common extension of both texts from their start."""
    bounded_batches(docs.sparkSession)
    ordered = in_descending_order(docs, key, text)
    return ordered.mapInPandas(_pairs, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs and a fingerprint (under a free name)."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs, "fingerprint")[0], fingerprint_column(F.col(text)))
