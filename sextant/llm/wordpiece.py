"""Token counts of greedy longest-match word pieces, by a linear automaton.

A word is a run of characters without ASCII white space, preceded by the mark that the vocabulary puts before words. The
pieces of a word are found by greedy longest match over its bytes. Here no piece is built: the vocabulary's trie has
failure links, each with the number of pieces that are popped when it is followed, precomputed breadth-first. A word then
costs one step for each byte and each link, at most two for each byte.

For a node v that spells a string s: if s is itself a piece, the failure link leads to the root, popping 1. Otherwise with
v = child(u, c), it leads to the node reached from link(u) by c, following further links where that step is missing, and
pops what those links pop together. If no such node exists s can't be split and the word counts as one unknown piece. A
vocabulary with all 256 bytes has no unknown words.

Defined results: null and empty texts, and texts of white space, have 0 words and 0 tokens. A very long word takes time in
proportion to its length. Extra columns are kept by `with_token_counts`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, fresh

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Distinct words whose counts a worker remembers, of at most REMEMBER_BYTES bytes each.
REMEMBER, REMEMBER_BYTES = 200_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable Latin-1 characters stand for
    themselves, the other bytes, in order, for the characters from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces as bytes; a word-initial piece begins with a space."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    code = byte_alphabet()
    return [bytes(code[c] for c in piece) for piece in model["model"]["vocab"] if piece not in special]


class Automaton:
    """Trie with failure links and popped-piece counts. Its size is bounded by the bytes of the vocabulary."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.step: dict[int, int] = {}
        end, parents = [False], [(0, 0)]
        for piece in pieces:
            at = 0
            for c in piece:
                key = at << 8 | c
                if (to := self.step.get(key)) is None:
                    to = self.step[key] = len(end)
                    end.append(False)
                    parents.append((at, c))
                at = to
            if at:
                end[at] = True
        depth = [0] * len(end)
        for v in range(1, len(end)):
            depth[v] = depth[parents[v][0]] + 1
        # link -1: none
        self.link, self.pops = [-1] * len(end), [0] * len(end)
        for v in sorted(range(1, len(end)), key=depth.__getitem__):
            if end[v]:
                self.link[v], self.pops[v] = 0, 1
                continue
            u, c = parents[v]
            at, n = self.link[u], self.pops[u]
            while at >= 0 and (to := self.step.get(at << 8 | c)) is None:
                n += self.pops[at]
                at = self.link[at]
            if at >= 0:
                self.link[v], self.pops[v] = to, n

    def count(self, word: bytes) -> int:
        """Pieces of one word, mark included; 1 for a word that can't be split."""
        at = n = 0
        step, link, pops = self.step, self.link, self.pops
        for c in word:
            while (to := step.get(at << 8 | c)) is None:
                if link[at] < 0:
                    return 1
                n += pops[at]
                at = link[at]
            at = to
        while at:
            if link[at] < 0:
                return 1
            n += pops[at]
            at = link[at]
        return n


class Counter:
    """Counts of whole texts, with a bounded memory of words."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton, self.known = automaton, {}

    def text(self, text: str | None) -> tuple[int, int]:
        """(words, tokens)"""
        n, known, count = 0, self.known, self.automaton.count
        words = (text or "").encode("utf-8", "surrogatepass").split()
        for w in words:
            k = known.get(w)
            if k is None:
                k = count(b" " + w)
                if len(w) <= REMEMBER_BYTES:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[w] = k
            n += k
        return len(words), n


def with_token_counts(docs: DataFrame, text: str = "text", pieces: list[bytes] | None = None) -> DataFrame:
    """docs with n_words and n_tokens (under free names)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Automaton(pieces or load_vocabulary()))

    @F.pandas_udf("n_words bigint, n_tokens bigint")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(shared.value)
        for s in batches:
            yield pd.DataFrame([counter.text(t) for t in s], columns=["n_words", "n_tokens"])

    tmp, words, tokens = fresh(docs, "_counts", "n_words", "n_tokens")
    return docs.withColumn(tmp, counts(F.coalesce(text, F.lit("")))).withColumn(words, F.col(f"{tmp}.n_words")).withColumn(tokens, F.col(f"{tmp}.n_tokens")).drop(tmp)
