"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of characters, word repetition and shape, its place, and the
same shares of the lines before and after. Transition weights tie neighbouring labels. Forward-backward gives each line's
marginal; their mean, weighted by length, is the document's share of good text, and a logistic curve fitted on labelled
documents turns that into a score.

Labels are of documents, lines have none: at first all lines take their document's label; then, ROUNDS times, lines of bad
documents that the model holds good are relabelled, but never more than half of a document's length, and the model is
fitted again.

What is learned from is a bounded sample: at most SAMPLE labelled rows of LEARN_CHARS characters and LINES lines at most,
never of the held-out fold. Everything is scored whole; time grows with a text's length, memory with its lines.

Defined results: a null text counts as empty, and an empty text is one empty line. Without labels of both classes every score
is 0.5. Repeated rows each get a row. An empty table gives no rows. Extra columns are kept by `with_score`, whose own column
takes a free name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, fold_of, fresh, labelled_sample

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
SAMPLE, LINES = 3_000, 400
ROUNDS, STEPS, RATE, RIDGE = 2, 120, 0.15, 1e-3
#: Bytes of one pass over a batch; a longer text is one pass of its own.
PASS = 2 << 20

KINDS = ("lower", "upper", "other", "digit", "blank", "bar", "symbol", "exclamation", "stop")


def _kinds() -> np.ndarray:
    kind = np.full(256, 6, dtype=np.uint8)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "", "0123456789", " \t\r\v\f", "|", "", "!", ".,;:?'\"()-")):
        kind[[ord(c) for c in chars]] = k
    kind[128:] = 2
    kind[10] = 9
    return kind


_KIND = _kinds()
#: Features of a line, of which the first NEAR are also taken from the lines before and after.
OWN = ("upper", "digit", "bar", "symbol", "exclamation", "repeated", "stop", "blank", "word", "length", "ends", "empty")
NEAR = 6
N_FEATURES = 1 + len(OWN) + 2 * NEAR + 2


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, characters of all lines, lines of each text)."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass") + b"\n"
    data = np.frombuffer(raw, dtype=np.uint8)
    kind = _KIND[data]
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    size = (ends - starts).astype(float)
    count = np.stack([np.diff(np.r_[0, np.cumsum(kind == k, dtype=np.int64)[ends]]) for k in range(len(KINDS))], axis=1).astype(float)
    lower, upper, other, digit, blank, bar, symbol, exclamation, stop = count.T
    text = np.maximum(size - blank, 1)
    # Words, and whether a word repeats the one before it in its line: by its length and its first 8 bytes.
    gap = (kind == 4) | (kind == 9)
    first = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    last = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    line = np.searchsorted(ends, first)
    head = np.zeros(len(first), dtype=np.uint64)
    for k in range(8):
        byte = np.where(first + k < last, data[np.minimum(first + k, len(data) - 1)], 0).astype(np.uint64)
        head = head << np.uint64(8) | byte
    same = np.zeros(len(first), dtype=bool)
    if len(first) > 1:
        same[1:] = (line[1:] == line[:-1]) & (head[1:] == head[:-1]) & ((last - first)[1:] == (last - first)[:-1])
    words = np.bincount(line, minlength=len(ends)).astype(float)
    repeated = np.bincount(line, weights=same, minlength=len(ends)) / np.maximum(words, 1)
    letters = np.maximum(lower + upper + other, 1)
    ends_well = np.isin(data[np.maximum(ends - 1, 0)], np.frombuffer(b".?!:;\"')", dtype=np.uint8)) & (size > 0)
    own = np.stack([upper / letters, digit / text, np.minimum(1, 5 * bar / text), symbol / text, np.minimum(1, 4 * exclamation / text), repeated, stop / text, blank / np.maximum(size, 1), np.minimum(2, text / np.maximum(words, 1) / 10), np.log1p(size) / 5, ends_well, size == 0], axis=1)
    lines = np.array([t.count("\n") + 1 for t in texts])
    edge = np.r_[0, np.cumsum(lines)]
    is_first, is_last = np.zeros(len(ends)), np.zeros(len(ends))
    is_first[edge[:-1]] = 1
    is_last[edge[1:] - 1] = 1
    before = np.r_[np.zeros((1, NEAR)), own[:-1, :NEAR]] * (1 - is_first)[:, None]
    after = np.r_[own[1:, :NEAR], np.zeros((1, NEAR))] * (1 - is_last)[:, None]
    return np.column_stack([np.ones(len(ends)), own, before, after, is_first, is_last]), size, lines


def passes(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts (from, to) that are worked off together."""
    low = 0
    while low < len(texts):
        high, n = low + 1, len(texts[low])
        while high < len(texts) and n + len(texts[high]) <= PASS:
            n += len(texts[high])
            high += 1
        yield low, high
        low = high


class Chain:
    """Two labels (0 bad, 1 good). Node scores are the good label's weights; transition[i, j] is from label i to j."""

    def __init__(self) -> None:
        self.w, self.transition = np.zeros(N_FEATURES), np.zeros((2, 2))

    def marginals(self, node: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(P(good) of each line, expected transitions, sum of log partition functions). Documents go side by side, the
        longest first, a line of each at a time."""
        order = np.argsort(-lines, kind="stable")
        start = (np.cumsum(lines) - lines)[order]
        size = lines[order]
        alpha, beta = np.zeros((len(node), 2)), np.zeros((len(node), 2))
        scores = np.stack([np.zeros(len(node)), node], axis=1)
        for t in range(int(size[0]) if len(size) else 0):
            at = start[: np.searchsorted(-size, -t, side="left")] + t
            alpha[at] = scores[at]
            if t:
                p = alpha[at - 1][:, :, None] + self.transition
                alpha[at] += np.logaddexp(p[:, 0], p[:, 1])
        for t in range(int(size[0]) - 2 if len(size) else -1, -1, -1):
            at = start[: np.searchsorted(-size, -(t + 1), side="left")] + t
            n = (beta[at + 1] + scores[at + 1])[:, None, :] + self.transition
            beta[at] = np.logaddexp(n[:, :, 0], n[:, :, 1])
        both = alpha + beta
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        last = start + size - 1
        log_z = np.zeros(len(node))
        log_z[:] = np.logaddexp(both[:, 0], both[:, 1])
        follows = np.ones(len(node), dtype=bool)
        follows[start] = False
        to = np.flatnonzero(follows)
        pairs = np.exp(np.clip(alpha[to - 1][:, :, None] + self.transition + (beta[to] + scores[to])[:, None, :] - log_z[to][:, None, None], -500, 0)).sum(axis=0)
        return good, pairs, float(log_z[last].sum())

    def fit(self, x: np.ndarray, y: np.ndarray, lines: np.ndarray, weight: np.ndarray) -> None:
        """Ascends the conditional log-likelihood (Adam). weight: of each document's lines, so that classes balance."""
        edge = np.cumsum(lines) - lines
        follows = np.ones(len(y), dtype=bool)
        follows[edge] = False
        to = np.flatnonzero(follows)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[to - 1], y[to]), 1)
        m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
        for step in range(1, STEPS + 1):
            good, pairs, _ = self.marginals(x @ self.w, lines)
            gradient = np.r_[x.T @ ((y - good) * weight) / weight.sum() - RIDGE * self.w, ((seen - pairs) / len(y) - RIDGE * self.transition).ravel()]
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.w += move[:N_FEATURES]
            self.transition += move[N_FEATURES:].reshape(2, 2)


def _by_document(values: np.ndarray, lines: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(lines) - lines)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    def __init__(self, texts: list[str], quality: np.ndarray) -> None:
        self.chain = None
        if len(set(quality.tolist())) < 2:
            return
        self.chain = Chain()
        x, size, lines = map(np.concatenate, zip(*(line_features(texts[low:high]) for low, high in passes(texts))))
        doc = np.repeat(np.arange(len(lines)), lines)
        y = quality[doc].astype(int)
        share = quality.mean()
        balance = np.where(quality == 1, 0.5 / share, 0.5 / (1 - share))[doc]
        weight = np.maximum(size, 1)
        weight = balance * weight / _by_document(weight, lines)[doc]
        for r in range(ROUNDS + 1):
            self.chain.fit(x, y, lines, weight)
            if r == ROUNDS:
                break
            good = self.chain.marginals(x @ self.chain.w, lines)[0]
            y = quality[doc].astype(int)
            for d in np.flatnonzero(quality == 0):
                at = np.flatnonzero(doc == d)
                best = at[np.argsort(-good[at])]
                best = best[np.cumsum(size[best]) <= 0.5 * size[at].sum()]
                y[best[good[best] > 0.8]] = 1
        s = self._logit(x, size, lines)
        self.curve = self._calibrate(s, quality.astype(float))

    def _logit(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        good = self.chain.marginals(x @ self.chain.w, lines)[0]
        weight = np.maximum(size, 1)
        p = np.clip(_by_document(good * weight, lines) / _by_document(weight, lines), 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    @staticmethod
    def _calibrate(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        a = np.array([1.0, 0.0])
        z = np.c_[s, np.ones(len(s))]
        for _ in range(30):
            p = _sigmoid(z @ a)
            a += np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (y - p) - 1e-2 * a)
        # The score mustn't fall as the share of good text rises.
        return np.array([max(a[0], 1e-3), a[1]])

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if self.chain is None:
            return out
        for low, high in passes(texts):
            out[low:high] = _sigmoid(self._logit(*line_features(texts[low:high])) * self.curve[0] + self.curve[1])
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns on the driver from a bounded sample."""
    rows = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE).where(F.size(F.split("text", "\n")) <= LINES).toPandas().sort_values(["doc_id", "text"])
    return Model(rows["text"].tolist(), rows["y"].to_numpy(dtype=int))


def score_column(docs: DataFrame, model: Model, text: Column) -> Column:
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(s.tolist()))

    return score(F.coalesce(text, F.lit("")))


def with_score(docs: DataFrame, labels: DataFrame, name: str = "quality_score") -> DataFrame:
    """All columns of docs and the score, under a free name."""
    return docs.withColumn(fresh(docs, name)[0], score_column(docs, fit(docs, labels), F.col("text")))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    score = score_column(docs, fit(docs, labels), F.col("text"))
    scored = docs.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score reaches the threshold."""
    tmp = fresh(docs, "_quality")[0]
    return docs.withColumn(tmp, score_column(docs, fit(docs, labels), F.col("text"))).where(F.col(tmp) >= THRESHOLD).drop(tmp)
