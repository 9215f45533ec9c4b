"""Language identification by string kernels.

Two texts are alike by the blended-spectrum presence kernel: the number of distinct character n-grams (n from 1 to 3) that
both have, over the root of the product of what each has. Texts are lower-cased, and what isn't a letter is one space. All
n-grams count, of any script: one is a number of its code points.
Nyström: a text is described by its kernel values with LANDMARKS training texts, whitened by the landmarks' own kernel.
One-versus-rest ridge regression on these is kernel ridge regression in the landmarks' span. Texts are scored in batches:
the batch's matrix of kernel values by the coefficients.

What is learned from is a bounded sample: at most PER_LANGUAGE texts for each language and SAMPLE in all, of LEARN_CHARS
characters at most (as landmarks those of up to LANDMARK_CHARS letters come first; all are whole), in the order of a hash of doc_id, never of the held-out fold. Of several
texts or languages of one doc_id the one with the smallest hash counts. Everything is scored whole, texts of any length.

Defined results: `und` with score 0 for null texts and texts without a letter (as Unicode has letters; signs such as a
superscript two are none); the same for all if nothing is labelled. Ties go to the language that sorts first. Repeated rows
each get a row. An empty table gives no rows. Extra columns are ignored by `predictions` and kept by `with_language`, whose
own columns take free names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import LEARN_CHARS, bounded_batches, fold_of, fresh, sample_of

FOLDS, HELD_OUT = 4, 2
PER_LANGUAGE, SAMPLE = 300, 3_000
LANDMARKS, LANDMARK_CHARS, RIDGE = 96, 8_000, 1e-2
ROWS = 128
UNKNOWN = "und"


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(text: str) -> np.ndarray:
    """The code points of the lower-cased text, each run of others than letters as one space, and a space at both ends."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    good = _is_letter()[c]
    kept = good.copy()
    kept[0] = True
    kept[1:] |= good[:-1]
    return np.where(good, c, 32)[kept].astype(np.int64)


def grams(t: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a text. A code point has 21 bits, so longer n-grams have numbers of their own."""
    two = t[:-1] << 21 | t[1:]
    return pd.unique(np.concatenate([t, two, two[:-1] << 21 | t[2:]]))


class Kernel:
    """Kernel values of texts with landmarks, by a list of landmarks for each n-gram that any of them has."""

    def __init__(self, landmarks: list[np.ndarray]) -> None:
        per = [grams(t) for t in landmarks]
        self.n, self.size = len(per), np.array([len(g) for g in per], dtype=float)
        every, owner = np.concatenate([*per, np.zeros(0, dtype=np.int64)]), np.repeat(np.arange(self.n), [len(g) for g in per])
        order = np.argsort(every, kind="stable")
        self.known, first = np.unique(every[order], return_index=True)
        self.owner, self.edge = owner[order].astype(np.int16), np.append(first, len(every))

    def __call__(self, texts: list[np.ndarray]) -> np.ndarray:
        shared, own = np.zeros((len(texts), self.n)), np.ones(len(texts))
        for i, t in enumerate(texts):
            g = grams(t)
            own[i] = len(g)
            at = np.searchsorted(self.known, g).clip(max=max(0, len(self.known) - 1))
            at = at[self.known[at] == g] if len(self.known) else at[:0]
            low, n = self.edge[at], self.edge[at + 1] - self.edge[at]
            end = np.cumsum(n)
            place = np.repeat(low - end + n, n) + np.arange(end[-1] if len(end) else 0)
            shared[i] = np.bincount(self.owner[place], minlength=self.n)
        return shared / np.sqrt(own[:, None] * np.maximum(self.size, 1))


class Model:
    def __init__(self, texts: list[str], langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        coded = [letters(t) for t in texts]
        y = np.array([self.langs.index(x) for x in langs])
        # Landmarks go round the languages; shorter texts come first where there are any.
        turn = sorted(range(len(y)), key=lambda i: (len(coded[i]) > LANDMARK_CHARS, int((y[:i] == y[i]).sum()), y[i]))
        marks = [coded[i] for i in turn[:LANDMARKS]]
        self.kernel = Kernel(marks)
        values, vectors = np.linalg.eigh(self.kernel(marks))
        kept = values > 1e-6
        white = vectors[:, kept] / np.sqrt(values[kept])
        phi = self.kernel(coded) @ white
        phi = np.c_[phi, np.ones(len(phi))]
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        # Each language weighs the same.
        weight = 1 / np.bincount(y)[y][:, None]
        solved = np.linalg.solve((phi * weight).T @ phi + RIDGE * len(self.langs) / phi.shape[1] * np.eye(phi.shape[1]), (phi * weight).T @ target)
        self.coefficients, self.bias = white @ solved[:-1], solved[-1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if self.langs and t and any(map(str.isalpha, t))]
        for low in range(0, len(some), ROWS):
            part = some[low : low + ROWS]
            scores = self.kernel([letters(texts[i]) for i in part]) @ self.coefficients + self.bias
            for i, s in zip(part, scores):
                best = int(s.argmax())
                out[i] = (self.langs[best], float(min(1.0, max(0.0, (s[best] + 1) / 2))))
        return out


def fit(docs: DataFrame) -> Model:
    """Learns on the driver from a bounded sample of rows with a language."""
    learnt = F.col("lang").isNotNull() & F.length("text").between(1, LEARN_CHARS) & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    keep = sample_of(docs, learnt, F.col("lang"), PER_LANGUAGE).orderBy("nth", "g", "doc_id").limit(SAMPLE).select("doc_id").distinct()
    rows = docs.where(learnt).select("doc_id", "lang", "text").join(F.broadcast(keep), "doc_id")
    h = F.xxhash64("doc_id", "lang", "text").alias("h")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(h, "lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text").toPandas()
    one = one[one["text"].map(lambda t: any(map(str.isalpha, t))).astype(bool)]
    # The order of the sample, by the same hash for all languages.
    one = one.assign(h=[zlib.crc32(str(i).encode()) for i in one["doc_id"]]).sort_values(["h", "doc_id"])
    return Model(one["text"].tolist(), one["lang"].tolist())


def language_column(docs: DataFrame, model: Model, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(s.tolist()), columns=["lang_pred", "score"])

    return predict(text)


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the predicted language and its score, under free names."""
    tmp, lang, score = fresh(docs, "_language", "lang_pred", "lang_score")
    return docs.withColumn(tmp, language_column(docs, model, F.col("text"))).withColumn(lang, F.col(f"{tmp}.lang_pred")).withColumn(score, F.col(f"{tmp}.score")).drop(tmp)


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    p = docs.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), language_column(docs, fit(docs), F.col("text")).alias("p"))
    return p.select("doc_id", "held_out", "p.lang_pred", "p.score")
