"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprint: words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, shingles of SHINGLE consecutive words, repeats
included, joined by a space (fewer words: the whole sequence; none: fingerprint 0). A bit is set if it is set in over half
of the shingles' XXH64 hashes (seed 42). Fingerprints link at RADIUS or fewer differing bits; a component is what links reach.

Search: distinct fingerprints only, so that any number of exact copies counts once. Two fingerprints that differ in 3 bits
agree in two of 5 blocks of 13 (12) bits, so each fingerprint is dealt to 10 buckets, one for each pair of blocks: of 10^10
fingerprints one bucket holds some 300. Within a bucket fingerprints are sorted by
Gray rank, by which neighbours differ little. Every FANOUT neighbours make a node, which keeps the bits that all members
share (mask and pattern); nodes make nodes up to a root. The self-join walks pairs of nodes from the root: differences
accumulate in the bits that both sides share, and a pair of nodes with more than RADIUS of them is dropped with all its
members. Pairs of nodes that are known to be in one component already are dropped too, so a dense group of near copies
takes about as many comparisons as a spanning tree needs. A bucket gives at most one link for each member.

Components: links are contracted by alternating large-star and small-star steps until nothing changes, with a table in the
shared folder for each step. Nothing about all documents comes to the driver but counts. Fingerprints that very many rows
share (empty texts, large groups of copies) go back to their rows by a broadcast of those few, all others by a shuffle.

Near copies by likeness: `keep_one(likeness=True)` also links texts whose sets of LIKE_SHINGLE-word shingles have a Jaccard
similarity of LIKE or more, most of which are farther than RADIUS apart (some 10 bits at 0.8). Blocks of bits can't deal so
wide a radius to small buckets; shared minima do: of SKETCH minima of the hashed shingles, each BAND make a band, and a band is
a bucket. A pair with similarity 0.8 shares one of BANDS bands in 98% of cases, 0.85 in 99.7%. Buckets of one component
only are left out, and of a component two members, others for each band, stand in a bucket, so that large groups of copies
stay small. A bucket of more than SPLIT components (texts with a passage in common, say) is split by the minima that no band
uses: PARTS parts of PART_BAND minima each, and again only parts of several components are kept. Two texts of similarity 0.8
in such a bucket share a part in 99.995% of cases, two of 0.3 in 14%. Within a bucket or part the same index is searched at WIDE bits. Of the pairs that it finds, those whose minima agree in
too small a share (LIKE less three standard errors) go; the others link if their LEAST least shingles give a similarity of
LIKE or more. For two texts of LEAST distinct shingles together that is the exact similarity, for longer ones an estimate with a
standard error of 0.0125.

Defined results: null texts count as empty, empty texts have fingerprint 0 and link like any other. Repeated rows and ids
each get a row. Rows with a null id get a fingerprint and their component's smallest non-null id, or null if there is none.
Texts of any length are taken whole. An empty table gives no rows. Extra columns are ignored; `keep_one` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, dropped, fresh, partitions, stored

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Blocks that a fingerprint is cut into, as (lowest bit, bits): of five, three differing bits leave two alike.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BLOCK_BITS = 13
#: A fingerprint of more rows than this share of all is joined to them by a broadcast: there are 1/SHARE of them at most.
SHARE = 1e-4
FANOUT = 8
#: Pairs of nodes that one step of the walk expands; and fingerprints that a task holds before it works them off.
STEP, HOLD = 8_000, 200_000
#: Shares into which rows of one root are dealt.
SALT = 16
#: Likeness: words of a shingle, least similarity, minima of a sketch, minima of a band, bands, bits apart at most, and how many
#: of a text's least shingles are compared.
LIKE_SHINGLE, LIKE, SKETCH, BAND, BANDS, WIDE, LEAST = 5, 0.8, 128, 5, 10, 16, 1024
#: Components of a bucket beyond which it is split, the parts that each member then has, and minima of a part.
SPLIT, PARTS, PART_BAND = 64, 19, 4
#: The standard error of a similarity of LIKE that is estimated from SKETCH minima.
LIKE_ERROR = (LIKE * (1 - LIKE) / SKETCH) ** 0.5
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    line, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    digest, n = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])), dtype=np.uint64, count=n)


def majority(h: np.ndarray) -> int:
    """The fingerprint: bits that are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, len(h), 65_536):
        counts += np.unpackbits(h[low : low + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def simhash(text: str | None) -> int:
    return majority(shingle_hashes(text))


def long_shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the LIKE_SHINGLE-word shingles, none for fewer words. Two shingles of SHINGLE words that start LIKE_SHINGLE -
    SHINGLE words apart name the shingle that they span."""
    apart = LIKE_SHINGLE - SHINGLE
    h = h[:-apart] * np.uint64(0x9E3779B97F4A7C15) + (h[apart:] ^ (h[apart:] >> np.uint64(29)))
    return h ^ (h >> np.uint64(32))


def minima(h: np.ndarray) -> np.ndarray:
    """The least of h under each of SKETCH multipliers."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(h), 2048):
        np.minimum(out, (h[low : low + 2048, None] * MULTIPLIERS).min(axis=0), out=out)
    return out


def least_of(h: np.ndarray) -> np.ndarray:
    """The LEAST least distinct values of h, by their upper half."""
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:LEAST]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two texts by their least shingles."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    again = both[1:] == both[:-1]
    n = len(both) - int(again.sum())
    if n > LEAST:
        cut = both[np.r_[True, ~again]][LEAST - 1]
        return int((again & (both[1:] <= cut)).sum()) / LEAST
    return int(again.sum()) / max(1, n)


def bands(least: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(least[k * BAND : (k + 1) * BAND].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def parts(least: np.ndarray) -> list[int]:
    """What splits a large bucket: hashes of the minima after those of the bands."""
    rest = least[BANDS * BAND :]
    return [xxhash.xxh64_intdigest(rest[k * PART_BAND : (k + 1) * PART_BAND].tobytes(), k) - (1 << 63) for k in range(PARTS)]


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with the fingerprint as a (signed) bigint."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def fingerprints(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t) for t in s], dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, fingerprints(F.coalesce(text, F.lit(""))))


def with_sketch(docs: DataFrame, text: str) -> DataFrame:
    """docs with `like`: the fingerprint, a byte of each minimum, the least shingles, the bands and the parts (none for fewer words)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("fp bigint, sketch binary, least binary, bands array<bigint>, parts array<bigint>")
    def sketches(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            h = shingle_hashes(t)
            fp, h = np.uint64(majority(h)).view(np.int64), long_shingles(h)
            m = minima(h)
            out.append((fp, (m >> np.uint64(16)).astype(np.uint8).tobytes(), least_of(h).tobytes(), bands(m), parts(m)) if len(h) else (fp, b"", b"", [], []))
        return pd.DataFrame(out, columns=["fp", "sketch", "least", "bands", "parts"])

    return docs.withColumn("like", sketches(F.coalesce(text, F.lit(""))))


class Likeness:
    """Which pairs of rows are alike, by their sketches and then by their least shingles."""

    def __init__(self, sketch: pd.Series, least: pd.Series) -> None:
        self.sketch = np.frombuffer(b"".join(sketch), dtype=np.uint8).reshape(-1, SKETCH)
        self.least = least.tolist()

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # One in 256 bytes agrees by chance.
        share = [(self.sketch[a[i : i + STEP]] == self.sketch[b[i : i + STEP]]).mean(axis=1) for i in range(0, len(a), STEP)]
        out = np.concatenate([np.zeros(0), *share]) >= (LIKE - 3 * LIKE_ERROR) * 255 / 256 + 1 / 256
        of = lambda i: np.frombuffer(self.least[i], dtype=np.uint32)
        for i in np.flatnonzero(out).tolist():
            out[i] = similarity(of(a[i]), of(b[i])) >= LIKE
        return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of x in the Gray sequence: the prefix XOR of its bits."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class _Level:
    """Nodes of one level: the first and last + 1 of their children, and the bits that all members have set or unset."""

    def __init__(self, low: np.ndarray, high: np.ndarray, group: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        self.low, self.high, self.group, self.ones, self.shared = low, high, group, ones, ones | zeros
        self.zeros = zeros


def _above(below: _Level) -> _Level:
    """Groups every FANOUT neighbours of a group into a node."""
    n = len(below.group)
    first = np.flatnonzero(np.r_[True, below.group[1:] != below.group[:-1]])
    within = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    low = np.flatnonzero(within % FANOUT == 0)
    return _Level(low, np.r_[low[1:], n], below.group[low], np.bitwise_and.reduceat(below.ones, low), np.bitwise_and.reduceat(below.zeros, low))


class GrayIndex:
    """Hierarchical index over fingerprints in groups; fps must be sorted by (group, Gray rank)."""

    def __init__(self, fps: np.ndarray, group: np.ndarray) -> None:
        n = np.arange(len(fps))
        self.fps = fps
        self.levels = [_Level(n, n + 1, group, fps, ~fps)]
        while len(self.levels[-1].group) and (len(self.levels) == 1 or (self.levels[-1].group[1:] == self.levels[-1].group[:-1]).any()):
            self.levels.append(_above(self.levels[-1]))
        self.compared = 0

    def _components(self) -> None:
        """The smallest and largest component of each node, for all levels."""
        self.least, self.most = [self.root], [self.root]
        for level in self.levels[1:]:
            self.least.append(np.minimum.reduceat(self.least[-1], level.low))
            self.most.append(np.maximum.reduceat(self.most[-1], level.low))

    def _merge(self, a: np.ndarray, b: np.ndarray) -> None:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        pairs = np.unique(np.stack([self.root[a], self.root[b]]), axis=1)
        for x, y in pairs[:, pairs[0] != pairs[1]].T.tolist():
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if parent:
            old = np.array(sorted(parent))
            new = np.array([find(x) for x in old.tolist()])
            at = np.searchsorted(old, self.root).clip(max=len(old) - 1)
            self.root = np.where(old[at] == self.root, new[at], self.root)
            self._components()

    def components(self, radius: int = RADIUS, check: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """For each fingerprint the position of the first one of its component within its group. check: which of the pairs
        within the radius link."""
        self.root = np.arange(len(self.fps))
        if len(self.fps) < 2:
            return self.root
        self._components()
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top].group))
        stack = [(top, roots[i : i + STEP], roots[i : i + STEP]) for i in range(0, len(roots), STEP)]
        while stack:
            k, a, b = stack.pop()
            keep = ~((self.least[k][a] == self.most[k][a]) & (self.least[k][b] == self.most[k][b]) & (self.least[k][a] == self.least[k][b]))
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            level, below = self.levels[k], self.levels[k - 1]
            na, nb = level.high[a] - level.low[a], level.high[b] - level.low[b]
            each = na * nb
            row = np.repeat(np.arange(len(a)), each)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            ca, cb = level.low[a][row] + nth // nb[row], level.low[b][row] + nth % nb[row]
            # A pair of a node with itself goes once over its pairs of children; of elements, without those with themselves.
            some = ca < cb if k == 1 else (ca <= cb)
            ca, cb = ca[some], cb[some]
            self.compared += len(ca)
            apart = np.bitwise_count((below.ones[ca] ^ below.ones[cb]) & below.shared[ca] & below.shared[cb])
            near = apart <= radius
            ca, cb = ca[near], cb[near]
            if k == 1:
                linked = check(ca, cb) if check else slice(None)
                self._merge(ca[linked], cb[linked])
            else:
                stack += [(k - 1, ca[i : i + STEP], cb[i : i + STEP]) for i in range(0, len(ca), STEP)][::-1]
        return self.root


def _sorted_by_rank(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[np.lexsort((gray_rank(pdf["fp"].to_numpy().view(np.uint64)), pdf["bucket"]))]


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _sorted_by_rank(pdf)
    fps = pdf["fp"].to_numpy().view(np.uint64)
    root = GrayIndex(fps, pdf["bucket"].to_numpy()).components()
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"u": fps[linked].view(np.int64), "v": fps[root[linked]].view(np.int64)})


def _like_links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _sorted_by_rank(pdf)
    index = GrayIndex(pdf["fp"].to_numpy().view(np.uint64), pdf["bucket"].to_numpy())
    first = index.components(WIDE, Likeness(pdf["sketch"], pdf["least"]))
    linked, root = np.flatnonzero(first != np.arange(len(first))), pdf["root"].to_numpy()
    return pd.DataFrame({"u": root[linked], "v": root[first[linked]]})


def _whole_buckets(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches are sorted by bucket; whole buckets are worked off together."""
        kept: list[pd.DataFrame] = []
        n = 0
        for pdf in batches:
            kept.append(pdf)
            n += len(pdf)
            if n >= HOLD and len(pdf) and kept[0]["bucket"].iloc[0] != pdf["bucket"].iloc[-1]:
                whole = pd.concat(kept)
                last = whole["bucket"] == whole["bucket"].iloc[-1]
                yield work(whole.loc[~last])
                kept, n = [whole[last]], int(last.sum())
        if n:
            yield work(pd.concat(kept))

    return search


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links among the distinct fingerprints in column fp, enough to connect all that are within RADIUS."""
    block = [F.shiftrightunsigned("fp", low).bitwiseAND((1 << bits) - 1) for low, bits in BLOCKS]
    pairs = [(i, j) for i in range(len(BLOCKS)) for j in range(i)]
    block = [F.shiftleft(block[i], BLOCK_BITS) + block[j] + (k << 2 * BLOCK_BITS) for k, (i, j) in enumerate(pairs)]
    dealt = distinct.select("fp", F.explode(F.array(*block)).alias("bucket"))
    parts = partitions(distinct.sparkSession)
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").select("bucket", "fp").mapInPandas(_whole_buckets(_links), "u bigint, v bigint").where(F.col("u") != F.col("v"))


def _together(members: DataFrame) -> DataFrame:
    """Of (bucket, root, fp, a, b) two members of each root in a bucket (one, where a root has no other), for buckets of several
    roots, with their number n. The join is dealt by salts, as one bucket can hold many roots."""
    h, one = F.xxhash64("fp", "bucket"), F.struct("fp", "a", "b")
    stand = members.groupBy("bucket", "root").agg(F.min_by(one, h).alias("c"), F.max_by(one, h).alias("d"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    several = stand.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "n", salts)
    found = stand.withColumn("salt", F.pmod("root", F.lit(SALT)).cast("int")).join(several, ["bucket", "salt"])
    return found.select("bucket", "n", "root", F.explode(F.array_distinct(F.array("c", "d"))).alias("c")).select("bucket", "n", "root", "c.*")


def _split(hot: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of large buckets, dealt to the parts of their buckets."""
    each = hot.join(classes.select("fp", "parts"), "fp").select("bucket", "root", "fp", "a", "b", F.posexplode("parts").alias("k", "part"))
    return _together(each.withColumn("bucket", F.xxhash64("bucket", "k", "part")))


def like_links(dealt: DataFrame, classes: DataFrame, sketches: DataFrame) -> DataFrame:
    """(u, v): links among the roots of dealt (bucket, n, root, fp, a, b), by likeness of the members that stand there, whose
    parts are those of their fp in classes and whose sketches are the rows (a, b) of sketches."""
    one = dealt.where(F.col("n") <= SPLIT).unionByName(_split(dealt.where(F.col("n") > SPLIT), classes))
    rows = sketches.join(one.select("a", "b").distinct(), ["a", "b"], "left_semi").dropDuplicates(["a", "b"])
    found = one.join(rows, ["a", "b"]).select("bucket", "root", "fp", "sketch", "least")
    return found.repartition(partitions(classes.sparkSession), "bucket").sortWithinPartitions("bucket").mapInPandas(_whole_buckets(_like_links), "u bigint, v bigint").where(F.col("u") != F.col("v"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours are linked to its least neighbour. Small star: each node and its smaller
    neighbours are linked to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): for each node with a link, except the least of its component, that least node."""
    state = None
    edges = stored(edges.distinct(), "links")
    while True:
        seen = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == state or not seen[0]:
            return edges
        state, before = seen, edges
        edges = stored(_star(_star(edges, True), False), "links")
        dropped(before)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row."""
    prints = stored(with_fingerprint(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "text", "fp").select("doc_id", "fp"), "simhash")
    # First per fingerprint: from here on a group of exact copies is one row.
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    linked = components(links(classes.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    # Only fingerprints with links go by their root. The least ids of roots are dealt with salt, as one root can have many.
    member = linked.unionByName(linked.select(F.col("root").alias("fp"), "root").distinct()).join(classes.select("fp", "first_id"), "fp")
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    found = member.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int")).join(least.select("root", "component_id", salts), ["root", "salt"]).select("fp", "component_id")
    ids = stored(classes.join(found, "fp", "left").select("fp", "n", F.when(F.col("component_id").isNull(), F.col("first_id")).otherwise(F.least("component_id", "first_id")).alias("component_id")), "ids")
    rows = ids.agg(F.sum("n")).first()[0] or 0
    frequent = F.broadcast(ids.where(F.col("n") > SHARE * rows).select("fp", "component_id"))
    rest = prints.join(frequent.select("fp"), "fp", "left_anti").join(ids.where(F.col("n") <= SHARE * rows).select("fp", "component_id"), "fp")
    return rest.unionByName(prints.join(frequent, "fp")).select("doc_id", "fp", "component_id")


def hex_of(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")


def _kept(prints: DataFrame) -> DataFrame:
    """(a, b): the first row of each component, by fingerprints within RADIUS."""
    classes = prints.groupBy("fp").agg(F.min(_first()).alias("first"))
    linked = components(links(classes.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    kept = classes.join(linked, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return kept.select("first.a", "first.b")


def _kept_by_likeness(prints: DataFrame) -> DataFrame:
    """(a, b): the first row of each component, by fingerprints within RADIUS or by likeness. The sketch and the parts of a
    fingerprint are those of its first row."""
    classes = stored(prints.groupBy("fp").agg(F.min(F.struct(_first().alias("first"), "bands", "parts")).alias("c")).select("fp", "c.*"), "classes")
    linked = components(links(classes.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = stored(classes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    dropped(classes)
    dealt = stored(_together(rooted.select(F.explode("bands").alias("bucket"), "root", "fp", "first.a", "first.b")), "buckets")
    above = components(like_links(dealt, rooted, prints.select("a", "b", "sketch", "least")))
    dropped(dealt)
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return first.join(above.select(F.col("u").alias("root"), F.col("v").alias("top")), "root", "left").groupBy(F.coalesce("top", "root").alias("top")).agg(F.min("first").alias("first")).select("first.a", "first.b")


def keep_one(docs: DataFrame, likeness: bool = False) -> DataFrame:
    """docs with exactly one row of each component: the one with the smallest doc_id (rows without an id come last), then by
    a hash of id and text. Rows are known by two such hashes, and of rows alike in both one stays. likeness: components are
    also linked by likeness of five-word shingles."""
    a, b = keys = fresh(docs, "_a", "_b")
    marked = docs.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64(F.lit(1), "doc_id", "text")})
    each = marked.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col(a).alias("a"), F.col(b).alias("b"))
    if likeness:
        prints = stored(with_sketch(each, "text").select("doc_id", "a", "b", "like.*"), "rows")
        kept = _kept_by_likeness(prints)
    else:
        prints = stored(with_fingerprint(each, "text", "fp").select("doc_id", "a", "b", "fp"), "rows")
        kept = _kept(prints)
    counted = prints.groupBy("a", "b").agg(F.count("*").alias("n"))
    gone = counted.join(kept, ["a", "b"], "left_anti").select("a", "b")
    repeated = counted.where("n > 1").join(kept, ["a", "b"], "left_semi").select("a", "b")
    # Only repeated rows, of which one is taken, are brought together with their texts.
    name = lambda df: df.select(F.col("a").alias(a), F.col("b").alias(b))
    once = marked.join(name(gone.unionByName(repeated)), keys, "left_anti")
    return once.unionByName(marked.join(name(repeated), keys, "left_semi").dropDuplicates(keys)).select(*docs.columns)
