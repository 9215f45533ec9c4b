"""Phrase collocations by hierarchical pair naming.

Words: `[^\\x20\\x09]+` within pieces, which are what `[.,;:!?\\x0A-\\x0D]` separates, with A-Z lower-cased. Everything is per language
(null: `und`).

Naming: tasks cut their rows into blocks of one language and of BLOCK bytes, and write each block as a sequence of numbers
with a dictionary of its distinct words and their counts. The dictionaries are summed over all blocks; a word of LEAST or
more occurrences gets a global name, which goes back to the blocks that have it, and each block replaces its numbers by names.
Two names side by side are then a pair: the block counts its distinct pairs, these are summed over all blocks, pairs of LEAST or more
are named, and the next level pairs the names of overlapping pairs. The k-gram so named points to its left and right
(k-1)-gram. Only distinct words and pairs of a block are ever shuffled by their value, so a word that holds a third of the
text is one row a block; the sequences move by their block only.

Cuts and subsumption follow the pointers: a gram's prefixes are those of its left parent and itself, its suffixes those of its
right parent and itself. A gram is dropped for a longer one that holds it if and only if it is dropped for one of which it is a
parent, as the gram in between is at least as frequent as the longer one.

Defined results: null and empty texts have no words. Repeated rows and ids count each. Ties in score and count go by the
phrase's bytes. Texts of any length are taken whole (a block is at least one text, whose words must fit into a task). An
empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import LOWER, UPPER, bounded_batches, dropped, stored

#: Least occurrences of a phrase; words of the longest; percent of a phrase's occurrences that a longer one must hold to drop it;
#: phrases returned for each language.
LEAST, WORDS, HELD, MOST = 10, 3, 50, 2000
SCALE = 1_000_000
#: Bytes of text of a block.
BLOCK = 32 << 20
#: Words of a block that are sorted at a time, and pairs that are passed on at a time: they bound a worker's memory.
RUN, OUT = 1 << 19, 1 << 16
#: Shares into which a language's phrases are dealt before the last ranking.
SALT = 64
ENDS = ".,;:!?\n\x0b\x0c\r"
_END = b"\xff"  # in no UTF-8 text
_TABLE = bytes.maketrans((UPPER + ENDS + "\t").encode(), LOWER.encode() + _END * len(ENDS) + b" ")
_BLOCKS = "block long, lang string, local int, word string, n long, seq binary"
_GRAMS = "block long, local int, left long, right long, n long, seq binary"


class _Block:
    """The texts of one language that a task has read last, as numbers of its own dictionary."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_END]
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, text: bytes) -> None:
        words = text.translate(_TABLE).replace(_END, b" \xff ").split()
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        self.parts.append(np.zeros(1, dtype=np.int32))
        self.bytes += len(text)


def _rows(block: int, lang: str, b: _Block) -> Iterator[pa.RecordBatch]:
    """A row for each word of the block, then one with its sequence, in which -1 ends a piece."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("local", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("seq", pa.binary())])
    seq = np.concatenate(b.parts)
    words = list(b.numbers)[1:]
    counts = np.bincount(seq, minlength=len(words) + 1)[1:]
    for low in range(0, len(words), 100_000):
        some = words[low : low + 100_000]
        columns = [np.full(len(some), block), [lang] * len(some), np.arange(low, low + len(some), dtype=np.int32), pa.array(some, pa.binary()).cast(pa.string()), counts[low : low + 100_000], [None] * len(some)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    yield pa.RecordBatch.from_pylist([{"block": block, "lang": lang, "seq": (seq - 1).tobytes()}], schema=schema)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made, open_blocks, held = TaskContext.get().partitionId(), 0, defaultdict(_Block), 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            text = text.as_py()
            open_blocks[lang].add(text)
            held += len(text)
            if held >= BLOCK:
                # All of them: what a task holds is bounded however many languages there are.
                for own, b in open_blocks.items():
                    yield from _rows((task << 32) + made, own, b)
                    made += 1
                open_blocks.clear()
                held = 0
    for own, b in open_blocks.items():
        yield from _rows((task << 32) + made, own, b)
        made += 1


def word_blocks(docs: DataFrame) -> DataFrame:
    """Dictionaries and sequences of the blocks: (block, lang, local, word, n) for words, (block, lang, seq) for sequences."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").alias("text")).where(F.length("text") > 0)
    return texts.mapInArrow(_to_blocks, _BLOCKS)


def _distinct(seq: np.ndarray, to: np.ndarray, count: int, follow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The distinct pairs of names side by side, as left * count + right in order, their counts, and with `follow` the sequence of
    their numbers. `to` gives names' places among `count` of them, -1: none. RUN words are sorted at a time."""
    runs, following = [], np.full(len(seq) - 1, -1, dtype=np.int32) if follow else None
    for low in range(0, len(seq) - 1, RUN):
        at = to[seq[low : low + RUN + 1]]
        both = (at[:-1] >= 0) & (at[1:] >= 0)
        own, number, n = np.unique(at[:-1][both].astype(np.int64) * count + at[1:][both], return_inverse=True, return_counts=True)
        runs.append((own, n.astype(np.int32)))
        if follow:
            following[low : low + RUN][both] = number
    every = np.concatenate([own for own, _ in runs]) if runs else np.empty(0, dtype=np.int64)
    every.sort()
    found = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
    del every
    counts = np.zeros(len(found), dtype=np.int64)
    for i, (own, n) in enumerate(runs):
        place = np.searchsorted(found, own)
        counts[place] += n
        if follow:
            some = following[i * RUN : (i + 1) * RUN]
            some[some >= 0] = place[some[some >= 0]]
        runs[i] = None
    return found, counts, following


def _paired(last: bool):
    schema = pa.schema([("block", pa.int64()), ("local", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64()), ("seq", pa.binary())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One block, of names and one sequence: its pairs of names side by side, with counts, OUT at a time, then the sequence of
        their numbers."""
        block, seq, local, name = None, None, [], []
        for batch in batches:
            block = batch.column("block")[0].as_py()
            local.append(batch.column("local").to_numpy().copy())
            name.append(batch.column("id").to_numpy().copy())
            for x in batch.column("seq").drop_null():
                seq = np.frombuffer(x.as_py(), dtype=np.int32)
        local, name = np.concatenate(local), np.concatenate(name)
        local, name = local[local >= 0], name[local >= 0]
        if seq is None or not len(seq) or not len(name):
            return
        to = np.full(max(int(seq.max()), int(local.max())) + 2, -1, dtype=np.int32)  # the last entry is for -1
        to[local] = np.arange(len(name), dtype=np.int32)
        found, n, following = _distinct(seq, to, len(name), not last)
        for low in range(0, len(found), OUT):
            some = found[low : low + OUT]
            columns = [np.full(len(some), block), np.arange(low, low + len(some), dtype=np.int32), name[some // len(name)], name[some % len(name)], n[low : low + OUT], pa.nulls(len(some), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)
        if len(found) and not last:
            yield pa.RecordBatch.from_pylist([{"block": block, "seq": following.tobytes()}], schema=schema)

    return pair


def grams(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """For each length 1..words a stored table of its phrases of `least` or more occurrences: (id, lang, words, f, left, right, heads,
    tails). left and right are the names of the two phrases of one word less; heads and tails hold the frequencies of the phrase's
    prefixes and suffixes by their length. And (lang, n): the words of each language."""
    blocks = stored(word_blocks(docs), "blocks")
    totals = stored(blocks.where("seq is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    out: list[DataFrame] = []
    for k in range(1, words + 1):
        key = ["lang", "word"] if k == 1 else ["left", "right"]
        entries = blocks.where("seq is null").select(*key, "block", "local", "n").repartition(*key).withColumn("place", F.monotonically_increasing_id())
        # One shuffle gives frequency and name; a key has one row a block at most. Places are given after it, so they aren't shuffled.
        same = Window.partitionBy(*key)
        named = entries.withColumns({"f": F.sum("n").over(same), "id": F.min("place").over(same)}).where(F.col("f") >= least)
        places = stored(named.select(*key, "f", "id", "block", "local", (F.col("place") == F.col("id")).alias("first")), "names")
        named = places.where("first").select(*key, "f", "id")
        if k == 1:
            none = F.lit(None).cast("long")
            level = named.select("id", "lang", F.array("word").alias("words"), "f", none.alias("left"), none.alias("right"), F.array("f").alias("heads"), F.array("f").alias("tails"))
        else:
            a = out[-1].select(F.col("id").alias("left"), "lang", F.col("words").alias("first"), "heads")
            b = out[-1].select(F.col("id").alias("right"), F.element_at("words", -1).alias("word"), "tails")
            both = named.join(a, "left").join(b, "right")
            level = both.select("id", "lang", F.array_append("first", F.col("word")).alias("words"), "f", "left", "right", F.array_append("heads", F.col("f")).alias("heads"), F.array_append("tails", F.col("f")).alias("tails"))
        out.append(stored(level, "grams"))
        if k < words:
            names = places.select("block", "local", "id", F.lit(None).cast("binary").alias("seq"))
            seqs = blocks.where("seq is not null").select("block", F.lit(-1).alias("local"), F.lit(-1).cast("long").alias("id"), "seq")
            paired = names.unionByName(seqs).groupBy("block").applyInArrow(_paired(k + 1 == words), _GRAMS)
            before, blocks = blocks, stored(paired, "blocks")
            dropped(before)
        dropped(places)
    dropped(blocks)
    return out, totals


#: A cut after its first k words: floor(SCALE * f * f / (l * r)) in decimals, at most SCALE, as no part is rarer than the whole.
_CUT = f"""transform(sequence(1, size(words) - 1), k -> named_struct(
    'score', (cast(f as decimal(15,0)) * cast(f as decimal(15,0)) * cast({SCALE} as decimal(7,0)))
             div (cast(heads[k - 1] as decimal(18,0)) * cast(tails[size(words) - k - 1] as decimal(18,0))),
    'k', k, 'l', heads[k - 1], 'r', tails[size(words) - k - 1]))"""


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, held: int = HELD) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score): all phrases of 2 to `words` words that occur `least` times or more and aren't
    dropped for a longer one. a, l and r are the frequencies of the phrase and of both sides of its weakest cut, n all words of
    the language."""
    levels, totals = grams(docs, words, least)
    kept = []
    for k, level in enumerate(levels[1:], start=2):
        if k < words:
            longer = levels[k]
            parents = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("g")).groupBy("id").agg(F.max("g").alias("g"))
            level = level.join(parents, "id", "left").where(F.col("g").isNull() | (100 * F.col("g") < held * F.col("f"))).drop("g")
        kept.append(level)
    every = kept[0]
    for level in kept[1:]:
        every = every.unionByName(level)
    cut = every.withColumn("cut", F.array_min(F.expr(_CUT)))
    cut = cut.select("lang", F.array_join("words", " ").alias("phrase"), "words", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    return cut.join(F.broadcast(totals), "lang")


def ranked(found: DataFrame, most: int = MOST) -> DataFrame:
    """The first `most` phrases of each language by score, count and phrase. They are ranked in SALT shares of a language first, so that the
    last ranking sees SALT * `most` rows of a language at most."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALT))
    first = found.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("share")


def top_collocations(docs: DataFrame) -> DataFrame:
    return ranked(collocations(docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB.
ORACLE = r"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL)),
split AS (SELECT lang, row_number() OVER () AS piece, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM pieces),
one AS (SELECT lang, piece, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM split),
three AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM one WINDOW p AS (PARTITION BY piece ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS a FROM three GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM three WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM three WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f1 GROUP BY lang),
held AS (
  SELECT lang, w1, w2, max(a) AS a
  FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
cuts AS (
  SELECT x.lang, concat_ws(' ', x.w1, x.w2) AS phrase, 1 AS k, x.a, l.a AS l, r.a AS r
  FROM f2 x JOIN f1 l ON l.lang = x.lang AND l.w1 = x.w1 JOIN f1 r ON r.lang = x.lang AND r.w1 = x.w2
  LEFT JOIN held h ON h.lang = x.lang AND h.w1 = x.w1 AND h.w2 = x.w2
  WHERE h.a IS NULL OR 100 * h.a < 50 * x.a
  UNION ALL
  SELECT x.lang, concat_ws(' ', x.w1, x.w2, x.w3), 1, x.a, l.a, r.a
  FROM f3 x JOIN f1 l ON l.lang = x.lang AND l.w1 = x.w1 JOIN f2 r ON r.lang = x.lang AND r.w1 = x.w2 AND r.w2 = x.w3
  UNION ALL
  SELECT x.lang, concat_ws(' ', x.w1, x.w2, x.w3), 2, x.a, l.a, r.a
  FROM f3 x JOIN f2 l ON l.lang = x.lang AND l.w1 = x.w1 AND l.w2 = x.w2 JOIN f1 r ON r.lang = x.lang AND r.w1 = x.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest JOIN n USING (lang)
QUALIFY rank <= 2000
"""
