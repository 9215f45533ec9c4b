"""Byte-level BPE by merge replay over blocks of the corpus.

A text is cut into words, the matches of a pattern, and each word's bytes are merged: of the pairs side by side, the one whose
bytes together have the least rank, the leftmost of equals, until no pair has a rank. That is done for all distinct words of a
block of BLOCK bytes of texts at once. Their bytes stand in one array; an inverted index leads from a pair's rank to the positions
where it stands in any word; the ranks are taken in order, each applied at all of its positions, and only the two neighbours of a merged
pair are looked up anew and entered into the index. If a neighbour's new pair has a lower rank than the one at work,
its word takes its merges one at a time, so the result is that of merging each word alone. A document's ids are then
gathered from its words' ids. There is no shuffle and nothing about the corpus is broadcast; what a task holds is a block, its distinct
words and the vocabulary. Decoding joins the bytes of the ids.

Defined results: null texts count as empty and have no ids. Each row gets a row, repeated ones too; other columns are kept. A text of any length is
taken whole; it must fit into a task. Text that the pattern doesn't match is an error (the public pattern matches any text).
An empty table gives no rows. Ids that the vocabulary lacks are an error in decoding; null ids count as none.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.llm.common import bounded_batches, fresh

#: Bytes of text of a block; characters from which a text's words are taken one by one.
BLOCK, LONG = 16 << 20, 1 << 20
#: Positions that a merge takes one after the other, as arrays aren't worth it.
FEW = 8
_NONE = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """pattern: what matches a word. tokens: the bytes of each rank."""

    pattern: str
    tokens: dict[int, bytes]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that make a token, as sorted numbers of left and right, and the rank that each makes."""
        rank = {t: r for r, t in self.tokens.items()}
        found = {(rank[t[:i]] << 32) + rank[t[i:]]: r for r, t in self.tokens.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
        keys = np.array(sorted(found), dtype=np.int64)  # of two ids below 2^31
        return keys, np.array([found[k] for k in keys.tolist()], dtype=np.int32)


def load_vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """Ranks from a file with a token in base 64 and its rank on each line. Without arguments: the public byte-level vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return Vocabulary(pattern or public_tokenizers.PATTERN, tokens)


class Replay:
    """Merges the words of a block together."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.keys, self.made = vocabulary.pairs()
        self.known = dict(zip(self.keys.tolist(), self.made.tolist()))
        rank = {t: r for r, t in vocabulary.tokens.items()}
        self.single = np.array([rank.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) + right
        at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def _enter(self, at: np.ndarray, rank: np.ndarray) -> None:
        """Adds positions to the index under their pairs' ranks."""
        some = rank != _NONE
        at, rank = at[some], rank[some]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, places in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts) if len(cuts) else [at]):
            if r not in self.index:
                heapq.heappush(self.heap, r)
            self.index[r].append(places)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's begin (with the end of the last)."""
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        n, lengths = len(text), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.r_[0, np.cumsum(lengths)]
        if not n:
            return np.zeros(0, dtype=np.int32), starts
        # A last symbol stands for the end of all. What stands after the last of a word, or before its first, is -1.
        self.symbol = np.r_[self.single[text], 0].astype(np.int32)
        if (self.symbol < 0).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        first = np.zeros(n + 1, dtype=bool)
        first[starts[:-1][lengths > 0]] = True
        first[n] = True
        self.following = np.where(first[1:], -1, np.arange(1, n + 1)).astype(np.int32)
        self.before = np.where(first[:-1], -1, np.arange(-1, n - 1)).astype(np.int32)
        self.alive = np.ones(n, dtype=bool)
        inner = np.flatnonzero(self.following >= 0).astype(np.int32)
        self.rank = np.full(n, _NONE, dtype=np.int32)
        self.rank[inner] = self._ranks(self.symbol[inner], self.symbol[inner + 1])
        self.index: defaultdict[int, list[np.ndarray]] = defaultdict(list)
        self.heap: list[int] = []
        self._enter(inner, self.rank[inner])
        while self.heap:
            r = heapq.heappop(self.heap)
            places = self.index.pop(r)
            at = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
            at = at[self.rank[at] == r]
            if len(at) > FEW:
                self._merge(r, at, word)
            else:
                self._merge_few(r, at.tolist(), word)
        alive = np.flatnonzero(self.alive)
        return self.symbol[alive].astype(np.int32), np.searchsorted(alive, starts)

    def _merge(self, r: int, at: np.ndarray, word: np.ndarray) -> None:
        """Applies rank r at the sorted positions where its pair stands."""
        if len(at) > 1:
            at, later = self._apart(at)
        else:
            later = at[:0]
        new = np.int32(r)
        end = self.following[at]  # the right sides, which go
        last, before = self.following[end], self.before[at]
        # The pairs that each merge would make alone; one of a lower rank goes first, so its word takes one merge now.
        left = np.full(len(at), _NONE, dtype=np.int32)
        some = before >= 0
        left[some] = self._ranks(self.symbol[before[some]], new)
        right = np.full(len(at), _NONE, dtype=np.int32)
        some = last >= 0
        right[some] = self._ranks(np.full(int(some.sum()), new, dtype=np.int32), self.symbol[last[some]])
        low = np.minimum(left, right) < r
        if low.any():
            slow = np.isin(word[at], word[at[low]])
            one = slow & np.r_[True, word[at[1:]] != word[at[:-1]]]
            take = ~slow | one
            later = np.r_[later, at[~take]]
            at, end = at[take], end[take]
            last = last[take]
        self.symbol[at] = new
        self.alive[end] = False
        self.rank[end] = _NONE
        self.following[at] = last
        some = last >= 0
        self.before[last[some]] = at[some]
        # Neighbours are looked up after all merges of the step: two of them may stand side by side.
        touched = np.unique(np.r_[at, self.before[at]])
        touched = touched[touched >= 0]
        follows = self.following[touched]
        rank = np.full(len(touched), _NONE, dtype=np.int32)
        some = follows >= 0
        rank[some] = self._ranks(self.symbol[touched[some]], self.symbol[follows[some]])
        self.rank[touched] = rank
        self._enter(touched, rank)
        if len(later):
            self._enter(later, self.rank[later])

    def _merge_few(self, r: int, at: list[int], word: np.ndarray) -> None:
        """The same, one position after the other."""
        symbol, following, before, rank = self.symbol, self.following, self.before, self.rank
        waits = -1
        for p in at:
            if rank[p] != r:
                continue  # it overlapped with the one before
            if word[p] == waits:
                self._enter_one(p, r)
                continue
            end = int(following[p])
            last, first = int(following[end]), int(before[p])
            symbol[p], following[p], self.alive[end], rank[end], rank[p] = r, last, False, _NONE, _NONE
            low = _NONE
            if last >= 0:
                before[last] = p
                if (low := self.known.get((r << 32) + int(symbol[last]), _NONE)) != _NONE:
                    rank[p] = low
                    self._enter_one(p, low)
            if first >= 0:
                rank[first] = new = self.known.get((int(symbol[first]) << 32) + r, _NONE)
                if new != _NONE:
                    self._enter_one(first, new)
                    low = min(low, new)
            if low < r:
                waits = word[p]

    def _enter_one(self, at: int, rank: int) -> None:
        if rank not in self.index:
            heapq.heappush(self.heap, rank)
        self.index[rank].append(np.array([at], dtype=np.int32))

    def _apart(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the sorted positions whose merges don't overlap, taken from the left, and none or those that do."""
        overlaps = np.r_[False, self.following[at[:-1]] == at[1:]]
        if not overlaps.any():
            return at, at[:0]
        begins = np.flatnonzero(~overlaps)
        within = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
        return at[within % 2 == 0], at[:0]


def _gather(flat: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    out = [np.zeros(0, dtype=np.int32)]
    for low in range(0, len(numbers), 1 << 18):
        some = numbers[low : low + (1 << 18)]
        lengths = starts[some + 1] - starts[some]
        ends = np.cumsum(lengths)
        out.append(flat[np.repeat(starts[some] - (ends - lengths), lengths) + np.arange(ends[-1])])
    return np.concatenate(out)


class _Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.pattern, self.replay = regex.compile(vocabulary.pattern), Replay(vocabulary)

    def words(self, text: str) -> tuple[Iterator[str] | list[str], int]:
        if len(text) < LONG:
            return (found := self.pattern.findall(text)), len(found)
        return (m.group() for m in self.pattern.finditer(text)), -1

    def begin(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__

    def numbered(self, text: str) -> np.ndarray:
        """The words of a text by their numbers in the block."""
        words, n = self.words(text)
        return np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=n)

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the block's words and where each word's begin."""
        words = [w.encode("utf-8", "surrogatepass") for w in self.numbers]
        self.numbers.clear()
        return self.replay(words)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        self.begin()
        rows = [self.numbered(t) for t in texts]
        flat, starts = self.end()
        return [_gather(flat, starts, row) for row in rows]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """docs with the ids of each text as an array of int, in the place of a column of that name; with the text or without it."""
    bounded_batches(docs.sparkSession)
    if ids.lower() != text.lower():
        docs = docs.drop(ids)
    (own,) = fresh(docs, "_text")
    given = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    if not keep_text or ids.lower() == text.lower():
        given = given.drop(text)
    schema = T.StructType([*given.drop(own).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(vocabulary)
        kept: list[tuple[list[pa.Array], list[str], np.ndarray, np.ndarray]] = []
        held = 0
        encoder.begin()

        def done() -> Iterator[pa.RecordBatch]:
            flat, starts = encoder.end()
            lengths = starts[1:] - starts[:-1]
            for columns, names, numbers, at in kept:
                tokens = np.r_[0, np.cumsum(lengths[numbers])][at].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(tokens), pa.array(_gather(flat, starts, numbers)))
                yield pa.RecordBatch.from_arrays([*columns, lists], names=[*names, ids])

        for b in batches:
            rows = [encoder.numbered(t.as_py()) for t in b.column(b.num_columns - 1)]
            at = np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int64)
            kept.append((b.columns[:-1], b.schema.names[:-1], np.concatenate([np.zeros(0, dtype=np.int32), *rows]), at))
            held += b.column(b.num_columns - 1).nbytes
            if held >= BLOCK:
                yield from done()
                kept, held = [], 0
        if kept:
            yield from done()

    return given.mapInArrow(blocks, schema)


def decoded(ids: Column | str, vocabulary: Vocabulary) -> Column:
    """The bytes that an array of ids stands for."""

    @F.pandas_udf("binary")
    def decode(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = vocabulary.tokens.__getitem__
        for s in rows:
            yield pd.Series([b"" if x is None else b"".join(map(get, x.tolist())) for x in s], dtype=object)

    return decode(ids)


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs: its ids, encoded and decoded again."""
    ids = encode(docs.select("doc_id", "text"), vocabulary, keep_text=False)
    whole = ids.withColumn("decoded", decoded("ids", vocabulary))
    return whole.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
