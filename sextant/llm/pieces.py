"""SentencePiece encoding and decoding over a relational lattice.

A text with a space before it is cut into units between any two neighbouring characters that no piece of the table holds
side by side. No piece can cross such a place, so units are encoded one by one, and every distinct unit once for the whole
corpus.

Lattice: all substrings of a unit up to the longest piece's length are exploded and equi-joined to the piece table; the
edges found are grouped by unit. A path through them is then chosen by folds with Spark's higher-order aggregate, by the
kind of model:

* Models with log probabilities (unigram): Viterbi. An aggregate over edges by their ends keeps for each end the best
  (score, edge); a second one follows the starts back. A character without a piece scores below every piece. Of paths with
  equal scores the one whose last piece starts latest is taken, and so on back.
* Models whose scores are merge ranks (BPE): the sum of ranks isn't what such a model minimises, and Viterbi gives other
  pieces than the model's own encoder. Here an aggregate starts with a node between any two characters and takes, again and
  again, the best edge (rank, then the leftmost) that spans exactly one node between two others, and drops that node.

In both, a character without a piece becomes its UTF-8 bytes' pieces.

Units of more than LONGEST characters (base64, runs of one sign) don't fit the bits of the folds. They take the same path
outside the lattice, in Python: merges with a heap over linked nodes, Viterbi by ends. No unit is cut for its length.

Documents get their ids in order: each text becomes the numbers of its units among the frequent ones, with gaps for all
others; the ids of those are joined by unit, come to their document in order and fill the gaps. Decoding looks up every id
of a document and puts the pieces' bytes together in order.

Defined results: null texts count as empty; empty texts have no pieces. A U+2581 in a text isn't a space: it becomes bytes,
so that every text is decoded to itself. Bytes that aren't UTF-8 become U+FFFD. Repeated rows each get a row. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, dropped, partitions, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: No unit in the lattice is longer, so that its nodes are the bits of a bigint.
LONGEST = 63
#: So many of the most frequent units, of so many bytes with their ids, are broadcast when documents are put together; all
#: others are joined by a shuffle.
FREQUENT, FREQUENT_BYTES = 400_000, 24 << 20


@dataclass(frozen=True)
class Pieces:
    """A piece table: (id, piece, score) and the ids of the 256 byte pieces. Its size is that of the model file."""

    rows: tuple[tuple[int, str, float], ...]
    byte_ids: tuple[int, ...]

    @property
    def longest(self) -> int:
        return max(len(p) for _, p, _ in self.rows)

    @property
    def merges(self) -> bool:
        """Whether scores are merge ranks: whole numbers, as no table of log probabilities has."""
        return all(s == int(s) for _, _, s in self.rows)

    @property
    def fallback(self) -> float:
        return min(s for _, _, s in self.rows) - 10.0

    @property
    def characters(self) -> dict[int, int]:
        """id + 1 of the pieces of one character, by its code point."""
        return {ord(p): i + 1 for i, p, _ in self.rows if len(p) == 1}

    def table(self, spark: SparkSession) -> DataFrame:
        """(id, piece, rank): the best score has rank 0, equal scores share one."""
        ranks = {s: r for r, s in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}
        return spark.createDataFrame([(i, p, ranks[s]) for i, p, s in self.rows], "id int, piece string, rank int")


@lru_cache(4)
def load_pieces(path: str = MODEL) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(m.get_piece_size())
    byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in n if m.is_byte(i)}
    plain = [i for i in n if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return Pieces(tuple((i, m.id_to_piece(i).replace("▁", " "), m.get_score(i)) for i in plain), tuple(byte_ids[b] for b in range(256)))


class Cutter:
    """Cuts texts into units, a batch at a time: between any two neighbouring characters that no piece holds side by side."""

    def __init__(self, pieces: Pieces) -> None:
        beside = {(a, b) for _, p, _ in pieces.rows for a, b in zip(p, p[1:])}
        known = sorted({ord(c) for pair in beside for c in pair})
        self.number = np.zeros(0x110000, dtype=np.uint16)
        self.number[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        joined = np.zeros((self.width, self.width), dtype=bool)
        for a, b in beside:
            joined[self.number[ord(a)], self.number[ord(b)]] = True
        self.joined = joined.ravel()

    def cut(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """(all units, units of each text) of texts without nulls."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        if low == high:
            return pa.array([], pa.string()), np.zeros(len(texts), dtype=np.int64)
        raw = texts.buffers()[2].slice(low, high - low)
        data = np.frombuffer(raw, dtype=np.uint8)
        place = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        kind = self.number[np.frombuffer(raw.to_pybytes().decode().encode("utf-32-le"), dtype=np.uint32)]
        first = np.empty(len(place), dtype=bool)
        first[0] = True
        first[1:] = ~self.joined[kind[:-1].astype(np.int32) * self.width + kind[1:]]
        begins = (offsets[:-1] - low)[offsets[:-1] < offsets[1:]]
        first[np.searchsorted(place, begins)] = True
        starts = place[first]
        ends = np.append(starts, np.int32(len(data)))
        counts = np.diff(np.searchsorted(starts, offsets - low))
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), raw), counts


@lru_cache(2)
def _cutter(pieces: Pieces) -> Cutter:
    return Cutter(pieces)


def marked(text: Column) -> Column:
    """What is cut: the text with a space before it; nothing for empty ones."""
    text = F.make_valid_utf8(F.coalesce(text, F.lit("")))
    return F.when(text == "", "").otherwise(F.concat(F.lit(" "), text))


def unit_counts(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """(unit, n) for each distinct unit of the corpus, counted within each batch before they are shuffled."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(pieces)
        for b in batches:
            found = cutter.cut(b.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["unit", "n"])

    return docs.select(marked(F.col(text)).alias("t")).mapInArrow(count, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(distinct: DataFrame, pieces: Pieces) -> DataFrame:
    """distinct (with a column unit, one row each, clustered by it) with edges: array<bigint>, sorted. An edge is what it is
    sorted by (its rank for merges, its end for Viterbi), its start, size and piece id + 1 (0 for a character without
    a piece), in 24, 7, 7 and 24 bits. Merges start from single characters, so that for them edges of one character say
    nothing: only the first one is made, which keeps units that have no other."""
    spark = distinct.sparkSession
    kept = [c for c in distinct.columns if c != "unit"]
    if pieces.merges:
        last, least = F.greatest(F.length("unit") - 2, F.lit(0)), F.when(F.col("start") == 0, 1).otherwise(2)
    else:
        last, least = F.length("unit") - 1, F.lit(1)
    cut = distinct.select("unit", *kept, F.explode(F.sequence(F.lit(0), last)).alias("start"))
    cut = cut.select("unit", *kept, "start", F.explode(F.sequence(least, F.least(F.lit(pieces.longest), F.length("unit") - F.col("start")))).alias("size"))
    cut = cut.select("unit", *kept, "start", "size", F.substr(F.col("unit"), F.col("start") + 1, F.col("size")).alias("piece"))
    # Joined by a number, not by the text, which makes the look-up some six times cheaper; then the texts are compared, in a
    # form that the planner doesn't take for another key.
    key = F.xxhash64("piece")
    table = pieces.table(spark).select(key.alias("key"), F.col("piece").alias("held"), F.length("piece").alias("m"), (F.col("id") + 1).cast("bigint").alias("code"), "rank")
    cut = cut.withColumn("key", key)
    same = (cut["key"] == table["key"]) & F.startswith(cut["piece"], table["held"]) & (table["m"] >= cut["size"])
    found = cut.join(F.broadcast(table), same, "left").where(F.col("code").isNotNull() | (F.col("size") == 1))
    start, size, zero = F.col("start").cast("bigint"), F.col("size").cast("bigint"), F.lit(0).cast("bigint")
    order = F.coalesce(F.col("rank").cast("bigint"), zero) if pieces.merges else start + size
    edge = F.shiftleft(order, 38) + F.shiftleft(start, 31) + F.shiftleft(size, 24) + F.coalesce("code", zero)
    return found.groupBy("unit", *kept).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _start(edge: Column) -> Column:
    return F.shiftright(edge, 31).bitwiseAND(127).cast("int")


def _size(edge: Column) -> Column:
    return F.shiftright(edge, 24).bitwiseAND(127).cast("int")


def _code(edge: Column) -> Column:
    return edge.bitwiseAND((1 << 24) - 1).cast("int")


def _ids(at: Column, code: Column, pieces: Pieces) -> Column:
    """The ids of one edge: its piece, or the bytes of the character at that position (from 0) of the unit."""
    spelled = F.hex(F.encode(F.substr(F.col("unit"), at + 1, F.lit(1)), "UTF-8"))
    bytes_of = F.array(*map(F.lit, pieces.byte_ids))
    as_bytes = F.transform(F.sequence(F.lit(1), F.length(spelled), F.lit(2)), lambda i: F.get(bytes_of, F.conv(F.substr(spelled, i, F.lit(2)), 16, 10).cast("int")))
    return F.when(code > 0, F.array(code - 1)).otherwise(as_bytes)


def merge(grouped: DataFrame, pieces: Pieces) -> DataFrame:
    """edges (sorted by rank and start) replaced by ids, the pieces left when no two neighbours can be merged. The fold's
    state is a bit for each node; an edge knows the bits of its two ends and those between them."""
    kept = [c for c in grouped.columns if c not in ("unit", "edges")]

    def bits(edge: Column) -> Column:
        start, power = _start(edge), F.call_function("shiftleft", F.lit(1).cast("bigint"), _size(edge))
        ends, inner = F.call_function("shiftleft", power + 1, start), F.call_function("shiftleft", power - 2, start)
        return F.struct(start.alias("start"), _code(edge).alias("code"), ends.alias("ends"), inner.alias("inner"))

    def step(acc: Column, _: Column) -> Column:
        best = F.get(F.filter(acc["open"], lambda e: F.bit_count(acc["nodes"].bitwiseAND(e["inner"])) == 1), F.lit(0))
        nodes = acc["nodes"].bitwiseAND(F.bitwise_not(F.coalesce(best["inner"], F.lit(0).cast("bigint"))))

        def on(nodes: Column) -> Column:
            # Edges whose ends are no longer nodes, or that have none left between, are out for good.
            left = F.filter(acc["open"], lambda e: (nodes.bitwiseAND(e["ends"]) == e["ends"]) & (nodes.bitwiseAND(e["inner"]) != 0))
            return F.struct(nodes.alias("nodes"), left.alias("open"))

        # An array of one binds the new nodes, so that they are worked out once a round.
        return F.when(F.size(acc["open"]) > 0, F.get(F.transform(F.array(nodes), on), F.lit(0))).otherwise(acc)

    known = grouped.select("unit", *kept, F.transform(F.filter("edges", lambda e: _size(e) > 1), bits).alias("edges"))
    n = F.length("unit")
    every = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(LONGEST) - n)
    rounds = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    first = F.struct(every.alias("nodes"), F.col("edges").alias("open"))
    left = known.select("unit", *kept, "edges", F.aggregate(rounds, first, step, lambda acc: acc["nodes"]).alias("nodes"))
    nodes = F.col("nodes")
    merged = F.transform(F.filter("edges", lambda e: (nodes.bitwiseAND(e["ends"]) == e["ends"]) & (nodes.bitwiseAND(e["inner"]) == 0)), lambda e: F.struct(e["start"].alias("start"), e["code"].alias("code")))
    codes = pieces.characters
    code_of = F.split(F.lit(",".join(str(codes.get(c, 0)) for c in range(max(codes, default=0) + 1))), ",").cast("array<int>")
    pair = F.lit(3).cast("bigint")
    alone = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("shiftright", nodes, i).bitwiseAND(pair) == pair)
    single = F.transform(alone, lambda i: F.struct(i.alias("start"), F.coalesce(F.get(code_of, F.ascii(F.substr(F.col("unit"), i + 1, F.lit(1)))), F.lit(0)).alias("code")))
    path = F.sort_array(F.concat(merged, single))
    return left.select("unit", *kept, F.flatten(F.transform(path, lambda e: _ids(e["start"], e["code"], pieces))).alias("ids"))


def viterbi(grouped: DataFrame, pieces: Pieces) -> DataFrame:
    """edges (sorted by end) replaced by ids, the pieces of the best path. The fold goes over the edges by their ends; its
    state is the best (score, edge) of each end before, the end at hand and the best so far for that."""
    kept = [c for c in grouped.columns if c not in ("unit", "edges")]
    n = F.length("unit")
    by_code = [pieces.fallback] * (max(i for i, _, _ in pieces.rows) + 2)
    for i, _, x in pieces.rows:
        by_code[i + 1] = x
    scores = F.split(F.lit(",".join(map(repr, by_code))), ",").cast("array<double>")
    origin = F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("edge"))
    first = F.struct(F.array().cast("array<struct<score:double,edge:bigint>>").alias("done"), F.lit(0).alias("end"), origin.alias("top"))

    def step(acc: Column, edge: Column) -> Column:
        end = F.shiftright(edge, 38).cast("int")

        def path(done: Column) -> Column:
            return F.struct((F.get(done, _start(edge))["score"] + F.get(scores, _code(edge))).alias("score"), edge.alias("edge"))

        longer = F.concat(acc["done"], F.array(acc["top"]))
        same = F.struct(acc["done"].alias("done"), acc["end"].alias("end"), F.greatest(acc["top"], path(acc["done"])).alias("top"))
        return F.when(end == acc["end"], same).otherwise(F.struct(longer.alias("done"), end.alias("end"), path(longer).alias("top")))

    best = grouped.select("unit", *kept, F.aggregate("edges", first, step, lambda acc: F.concat(acc["done"], F.array(acc["top"]))).alias("best"))
    def back(acc: Column, _: Column) -> Column:
        edge = F.get(F.col("best"), acc["at"])["edge"]
        on = F.struct(_start(edge).alias("at"), F.concat(_ids(_start(edge), _code(edge), pieces), acc["ids"]).alias("ids"))
        return F.when(acc["at"] > 0, on).otherwise(acc)

    none = F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids"))
    return best.select("unit", *kept, F.aggregate(F.sequence(F.lit(1), n), none, back, lambda acc: acc["ids"]).alias("ids"))


def long_merge(unit: str, known: dict[str, tuple[float, int]], byte_ids: tuple[int, ...]) -> list[int]:
    """What merge() does, for a unit of any length: the best pair (rank, then the leftmost) first."""
    n = len(unit)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        if a >= 0 and (b := after[a]) < n and (hit := known.get(unit[a : end[b]])) is not None:
            heapq.heappush(heap, (-hit[0], a, end[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, to = heapq.heappop(heap)
        # A node that is gone has no end; one that has grown has other ends than when the pair was offered.
        if end[a] < 0 or (b := after[a]) >= n or end[b] != to:
            continue
        end[a], end[b], after[a] = to, -1, after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(a)
        offer(before[a])
    out, a = [], 0
    while a < n:
        hit = known.get(unit[a : end[a]])
        out += [hit[1]] if hit else [byte_ids[x] for x in unit[a].encode()]
        a = after[a]
    return out


def long_viterbi(unit: str, known: dict[str, tuple[float, int]], byte_ids: tuple[int, ...], longest: int, fallback: float) -> list[int]:
    """What viterbi() does, for a unit of any length."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, len(unit) + 1):
        paths = []
        for start in range(max(0, end - longest), end):
            if (hit := known.get(unit[start:end])) is not None:
                paths.append((best[start][0] + hit[0], start, hit[1] + 1))
            elif end - start == 1:
                paths.append((best[start][0] + fallback, start, 0))
        best.append(max(paths))
    out, at = [], len(unit)
    while at:
        _, start, code = best[at]
        out.append([code - 1] if code else [byte_ids[x] for x in unit[start].encode()])
        at = start
    return [i for ids in reversed(out) for i in ids]


def long_units(distinct: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n, ids) for the units that the lattice has no bits for."""
    known, byte_ids, longest, fallback, merges = {p: (x, i) for i, p, x in pieces.rows}, pieces.byte_ids, pieces.longest, pieces.fallback, pieces.merges

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [long_merge(u, known, byte_ids) if merges else long_viterbi(u, known, byte_ids, longest, fallback) for u in b.column("unit").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["unit", "n", "ids"])

    return distinct.select("unit", "n").mapInArrow(each, "unit string, n bigint, ids array<int>")


class Speller:
    """Ids back to texts, a batch at a time. Unknown ids spell nothing; bytes that aren't UTF-8 become U+FFFD."""

    def __init__(self, pieces: Pieces) -> None:
        table = [b""] * (max(max(i for i, _, _ in pieces.rows), *pieces.byte_ids) + 2)
        for i, p, _ in pieces.rows:
            table[i] = p.encode()
        for b, i in enumerate(pieces.byte_ids):
            table[i] = bytes([b])
        self.size = np.array([len(x) for x in table], dtype=np.int32)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(table), dtype=np.uint8)

    def spell(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The text of each run of `counts` ids, without the space before it."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, len(self.size) - 1)
        data, ends = _gather(self.data, self.start[ids], self.size[ids])
        edge = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        whole = data.tobytes()
        return [whole[a + (whole[a : a + 1] == b" ") : b] for a, b in zip(edge, edge[1:])]


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat[starts[0] : starts[0] + sizes[0]], and so on, side by side; where each begins and the last ends)."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return flat[np.repeat((starts - ends[:-1]).astype(np.int32), sizes) + np.arange(ends[-1], dtype=np.int32)], ends


def encode_units(counted: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n, ids) for the distinct units (unit, n) of a corpus: each with its pieces."""
    short, long = counted.where(F.length("unit") <= LONGEST), counted.where(F.length("unit") > LONGEST)
    choose = merge if pieces.merges else viterbi
    return choose(lattice(short.repartition(partitions(counted.sparkSession), "unit"), pieces), pieces).select("unit", "n", "ids").unionByName(long_units(long, pieces))


def _least_count(table: DataFrame, most: int, most_bytes: int) -> int:
    """A count n such that the units that occur n times or more are at most `most`, and they and their ids have at most
    `most_bytes`; from a histogram with 16 bars for each doubling."""
    size = F.octet_length("unit") + 4 * F.size("ids")
    bars = table.groupBy(F.floor(F.log2("n") * 16).alias("bar")).agg(F.count("*").alias("units"), F.sum(size).alias("bytes"), F.min("n").alias("least")).orderBy(F.desc("bar")).collect()
    units, total, least = 0, 0, 1 << 62
    for r in bars:
        units, total = units + r.units, total + r.bytes
        if units > most or total > most_bytes:
            break
        least = r.least
    return least


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffles of what runs in here are removed as soon as it has ended, not when the driver's memory is cleaned."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each) of numbers below 2^21: seven bits a byte, the least first, all but the last with the high bit."""
    size = 1 + (codes >= 1 << 7).astype(np.int64) + (codes >= 1 << 14)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    for k in range(3):
        some = size > k
        out[(end - size)[some] + k] = (codes[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    out = (data[first] & 127).astype(np.int32)
    for k in (1, 2):
        some = last - first >= k
        out[some] |= (data[first[some] + k] & 127).astype(np.int32) << 7 * k
    return out


#: So many units are put together at once.
AT_ONCE = 1 << 20


class _Frequent:
    """The frequent units: their numbers (from 1, the most frequent first; 0 is any other unit) and ids."""

    def __init__(self, table: pa.Table) -> None:
        table = table.combine_chunks()
        lists = pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(c.cast(pa.list_(pa.int32())) for c in table.column("ids").chunks)])
        self.number = {u: i for i, u in enumerate(table.column("unit").to_pylist(), 1)}
        self.size = np.concatenate([[0], lists.value_lengths().to_numpy(zero_copy_only=False)]).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)

    def codes(self, units: pa.StringArray) -> np.ndarray:
        coded = units.dictionary_encode()
        number = np.array([self.number.get(u, 0) for u in coded.dictionary.to_pylist()], dtype=np.int32)
        return number[coded.indices.to_numpy(zero_copy_only=False)]


def _encoded(docs: DataFrame, pieces: Pieces, key: str, text: str, frequent: int, summary: bool) -> DataFrame:
    """(doc_id, ids), and with summary (n_pieces, decoded_hash, exact) of what the ids spell.

    Rows are known by two hashes of id and text, which don't depend on how the table is read. Rows alike in both have the
    same units, which collect_set makes one."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with _shuffles_removed(spark):
        counted = stored(unit_counts(docs, pieces, text), "unit-counts")
        table = stored(encode_units(counted, pieces), "units")
    dropped(counted)
    least = _least_count(table, frequent, FREQUENT_BYTES)
    top = table.where(F.col("n") >= least).orderBy(F.desc("n"), "unit").select("unit", "ids").toArrow()
    held = spark.sparkContext.broadcast(_Frequent(top))
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.xxhash64(key, text).alias("k1"), F.xxhash64(F.lit(1), key, text).alias("k2"), F.col(key).alias("doc_id"), F.xxhash64(whole).alias("hash"), F.octet_length(whole).alias("length"), marked(F.col(text)).alias("t"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(pieces)
        for b in batches:
            units, counts = cutter.cut(b.column("t"))
            at = np.flatnonzero(held.value.codes(units) == 0)
            edge = np.cumsum(counts)
            doc = np.searchsorted(edge, at, "right")
            keys = [b.column(c).take(pa.array(doc)) for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(at - (edge - counts)[doc], pa.int32()), units.take(pa.array(at))], ["k1", "k2", "at", "unit"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(pieces)
        for b in batches:
            units, counts = cutter.cut(b.column("t"))
            data, size = pack(held.value.codes(units))
            edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
            codes = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(edge), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k1", "k2", "doc_id", "hash", "length")), codes], ["k1", "k2", "doc_id", "hash", "length", "codes"])

    with _shuffles_removed(spark):
        found = keyed.select("k1", "k2", "t").mapInArrow(rare, "k1 bigint, k2 bigint, at int, unit string")
        put = stored(found.join(table.where(F.col("n") < least).select("unit", "ids"), "unit").select("k1", "k2", "at", "ids"), "rare")
    dropped(table)
    put = put.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", "ids"))).alias("rare")).select("k1", "k2", F.col("rare.ids").alias("rare"))
    doc_type = docs.schema[key].dataType.simpleString()
    coded = keyed.mapInArrow(known, f"k1 bigint, k2 bigint, doc_id {doc_type}, hash bigint, length int, codes binary")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(pieces) if summary else None
        for b in batches:
            # Rows are put together a few at a time, as ids take many times the room of codes.
            size = np.cumsum([len(x.as_buffer()) for x in b.column("codes")])
            edges = [0, *np.flatnonzero(np.diff(size // AT_ONCE)) + 1, len(size)] if len(size) else [0]
            for low, high in zip(edges, edges[1:]):
                yield from _put_together(b.slice(low, high - low), held.value, speller)

    out = f"doc_id {doc_type}, ids array<int>" + (", n_pieces bigint, decoded_hash string, exact boolean" if summary else "")
    return coded.join(put, ["k1", "k2"], "left").select("doc_id", "hash", "length", "codes", "rare").mapInArrow(assemble, out)


def _put_together(b: pa.RecordBatch, frequent: _Frequent, speller: Speller | None) -> Iterator[pa.RecordBatch]:
    packed = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in b.column("codes")]
    codes = unpack(np.concatenate(packed)) if packed else np.zeros(0, dtype=np.int32)
    counts = np.array([np.count_nonzero(x < 128) for x in packed], dtype=np.int64)
    lists = b.column("rare").flatten()
    sizes, starts = frequent.size[codes], frequent.start[codes]
    gaps = np.flatnonzero(codes == 0)
    if len(gaps) != len(lists):
        raise ValueError(f"{len(gaps)} units without ids, {len(lists)} found")
    sizes[gaps] = lists.value_lengths().to_numpy(zero_copy_only=False)
    starts[gaps] = len(frequent.ids) + np.cumsum(sizes[gaps]) - sizes[gaps]
    ids, ends = _gather(np.concatenate([frequent.ids, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)]), starts, sizes)
    edge = ends[np.concatenate([[0], np.cumsum(counts)])]
    columns = {"doc_id": b.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))}
    if speller is not None:
        texts = speller.spell(ids, np.diff(edge))
        hashes = [xxhash.xxh64_intdigest(t, 42) for t in texts]
        same = np.array(hashes, dtype=np.uint64).view(np.int64) == b.column("hash").to_numpy(zero_copy_only=False)
        same &= np.array([len(t) for t in texts], dtype=np.int64) == b.column("length").to_numpy(zero_copy_only=False)
        columns |= {"n_pieces": pa.array(np.diff(edge), pa.int64()), "decoded_hash": pa.array([f"{h:x}" for h in hashes], pa.string()), "exact": pa.array(same)}
    yield pa.RecordBatch.from_pydict(columns)


def encode(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, ids): the pieces of each text, in order."""
    return _encoded(docs, pieces, key, text, frequent, False)


def decode_texts(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): what the ids spell, without the space before it."""
    bounded_batches(encoded.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(pieces)
        for b in batches:
            ids, counts = b.column("ids").flatten().to_numpy(zero_copy_only=False), b.column("ids").fill_null([]).value_lengths().to_numpy(zero_copy_only=False)
            found = [t.decode("utf-8", "replace") for t in speller.spell(ids, counts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(texts, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def token_summary(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_hash, exact) for each document: its ids in order and the hash of the text that they are
    decoded to. exact: that text has the hash and the length of the document's own."""
    return _encoded(docs, pieces, key, text, frequent, True).select("doc_id", "n_pieces", "ids", "decoded_hash", "exact")
