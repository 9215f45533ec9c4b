"""Toxicity by weak supervision.

Voters: lexicons and patterns. The lexicons are a fixed list and words and word beginnings mined from labelled rows, of
near copies one each, so that a word that only rides along in copies of a toxic document isn't taken. Mined terms are dealt
to several voters; a voter says toxic, clean or nothing. The sample's labels are one more voter, of a fixed accuracy.

Label model: EM over the votes on labelled and unlabelled rows estimates the prior and each voter's accuracy by class. On an
unlabelled row the voter of labels says nothing, so that its posterior comes from the other voters alone. The correlation
of two voters given the class, beyond what the class explains, discounts the weight of voters that repeat each other; it is
estimated anew in every round. The posteriors are the labels of a logistic regression over votes and densities, which
scores every document.

What is learned from are bounded samples: at most SAMPLE labelled documents and UNLABELLED others, of LEARN_CHARS characters
at most, never of the held-out fold. Their texts are read in tasks and stay there: to the driver come the minima by which
near copies are told, counts of the terms that may be taken, and what voters say. Everything is scored whole, texts of any
length.

Defined results: null texts count as empty, and are scored like any text. Without labels of both classes only the fixed list
votes: 1 for a text with one of its words, else 0. Repeated rows each get a row. An empty table gives no rows. Extra columns
are kept by `with_score`, whose own column takes a free name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import LEARN_CHARS, bounded_batches, dropped, fold_of, fresh, labelled_sample, sample_of, stored

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
SAMPLE, UNLABELLED = 6_000, 2_000
#: Tasks that read the sample.
PARTS = 32
MINED, LEAST_GAIN, PENALTY, CHANCE = 400, 3, 5, 1e-3
#: How far the label model trusts a single label.
LABEL_ACCURACY = 0.95
BEGINNINGS = (4, 5, 6)
MINED_VOTERS = 8
#: Common English insults.
SEED = frozenset(
    "idiot idiots moron morons stupid dumb dumbass loser losers pathetic worthless scum trash clown disgusting imbecile jerk "
    "fool bastard bitch asshole whore slut retard retarded cretin degenerate vermin filth filthy subhuman creep freak pig".split()
)
WORDS = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+[*@$#]+[^\W\d_]+")
PATTERNS = ("shouting", "exclaimed", "masked", "symbols")


MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 1099511627, 2860486313, 3367900313, 3148259783, 2971215073, 1500450271, 4093082899], dtype=np.uint64)


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def terms(words: Column) -> Column:
    """A text's distinct words and their beginnings; a beginning ends with a hyphen."""
    begin = lambda n: F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("-")))
    return F.array_distinct(F.concat(words, *map(begin, BEGINNINGS)))


def minima(words: Iterable[str]) -> list[int]:
    """The least of the hashed words under each multiplier; none without words."""
    h = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint64) + np.uint64(1)
    return ((h[:, None] * MULTIPLIERS) & np.uint64(0xFFFFFFFF)).min(axis=0).tolist() if len(h) else []


def without_copies(docs: Iterable[list[int]]) -> list[int]:
    """Positions of one document for each group of near copies: those that share a band of two minima of hashed words."""
    seen, out = set(), []
    for i, least in enumerate(docs):
        bands = {(k, least[k], least[k + 1]) for k in range(0, len(least), 2)}
        if bands and not bands & seen:
            out.append(i)
        seen |= bands
    return out


class Miner:
    """The terms that tell toxic documents, by the counts (toxic, clean) of documents that have them: first all whose counts
    can't be chance, then, for documents without one, those that cover the most of them. A beginning is taken only if it marks
    more than a word or longer beginning that it covers, and then nothing else that begins so."""

    def __init__(self, counts: dict[str, tuple[int, int]], few: int, sure: float) -> None:
        self.counts, self.few, self.out = counts, few, []
        self.taken: set[str] = set()
        for t in sorted(counts, key=lambda t: (-counts[t][0], t.endswith("-"), -len(t), t)):
            if len(self.out) >= MINED:
                break
            if counts[t][0] - PENALTY * counts[t][1] >= sure:
                self._take(t)

    def _take(self, t: str) -> None:
        word = t.rstrip("-")
        if any(word[:n] + "-" in self.taken for n in BEGINNINGS if len(word) >= n):
            return
        if t.endswith("-") and any(x.startswith(word) and self.counts[x][0] > self.counts[t][0] - self.few for x in self.taken):
            return
        self.taken.add(t)
        self.out.append(t)

    def cover(self, open_: list[set[str]]) -> list[str]:
        """open_: of each toxic document without a term that is taken those that may be."""
        gain = Counter(t for d in open_ for t in d)
        while gain and len(self.out) < MINED:
            best = max(gain, key=lambda t: (gain[t] - PENALTY * self.counts[t][1], self.counts[t][0], t.endswith("-"), len(t), t))
            if gain[best] - PENALTY * self.counts[best][1] < self.few:
                break
            self._take(best)
            for d in open_:
                if best in d:
                    gain.subtract(d)
            open_ = [d for d in open_ if best not in d]
            gain.pop(best, None)
        return self.out


def mine(docs: DataFrame, n: int, toxic: int) -> list[str]:
    """The terms to be taken from the n documents (toxic, words), of near copies one each, of which so many are toxic; none
    without documents of both kinds."""
    if not 0 < toxic < n:
        return []
    share = toxic / n
    few = min(LEAST_GAIN, max(1, toxic // 10))
    found = docs.select("toxic", F.explode(terms(F.col("words"))).alias("term")).groupBy("term")
    counted = stored(found.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "toxicity-terms")
    kinds = counted.agg(F.count_if(F.col("t") > 0) + F.count_if(F.col("c") > 0)).first()[0]
    good = counted.where((F.col("t") >= few) & (F.col("c") <= F.lit(0.05) * F.col("t") * ((1 - share) / share)))
    miner = Miner({r.term: (r.t, r.c) for r in good.collect()}, few, math.log(CHANCE / max(1, kinds)) / math.log(share))
    dropped(counted)
    held = docs.sparkSession.sparkContext.broadcast((miner.counts.keys() - miner.taken, miner.taken))

    @F.pandas_udf("array<string>")
    def left(s: pd.Series) -> pd.Series:
        may, taken = held.value
        return s.map(lambda ts: None if not taken.isdisjoint(ts) else [t for t in ts if t in may])

    left_over = docs.where("toxic = 1").select(left(terms(F.col("words"))).alias("ts")).where("ts IS NOT NULL")
    return miner.cover([set(r.ts) for r in left_over.collect()])


@dataclass
class Voters:
    """All voters; `votes` gives 1 toxic, 0 nothing, -1 clean for each, and `features` what the classifier sees."""

    mined: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.of = {t: i % MINED_VOTERS for i, t in enumerate(self.mined)}
        self.beginnings = {t for t in self.mined if t.endswith("-")}
        self.names = ["fixed", *(f"mined{i}" for i in range(MINED_VOTERS)), *PATTERNS, "unmarked", "plain"]

    def read(self, text: str) -> tuple[list[int], list[float]]:
        low = text.lower()
        words = WORDS.findall(low)
        distinct = set(words)
        found = distinct & self.of.keys()
        if self.beginnings:
            found |= {b for n in BEGINNINGS for w in distinct if len(w) > n and (b := w[:n] + "-") in self.beginnings}
        fixed = distinct & SEED
        by_voter = [0] * MINED_VOTERS
        for t in found:
            by_voter[self.of[t]] = 1
        n, letters = max(1, len(text)), max(1, sum(map(len, words)))
        shouting = sum(map(str.isupper, text)) / letters
        exclaimed, masked = text.count("!") / n, len(MASKED.findall(text))
        symbols = sum(text.count(c) for c in "#$%&*|") / n
        marked = bool(found or fixed)
        votes = [int(bool(fixed)), *by_voter, int(shouting > 0.9), int(exclaimed > 0.05), int(masked > 0), int(symbols > 0.2), 0 if marked else -1, 0 if marked or masked else -1]
        extra = [np.log1p(len(found | fixed)), float(marked), np.log1p(100 * len(found | fixed) / max(1, len(distinct))), shouting, exclaimed, symbols]
        return votes, [*map(float, votes), *extra]


class LabelModel:
    """EM for voters that are independent given the class, with a discount for those that are not. labels: 1, 0, or -1 where
    there is none. `toxic` and `clean` are each voter's shares of -1, 0 and 1 by class."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, rounds: int = 50) -> None:
        onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        trust = np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
        said = np.where(labels > 0, trust, np.where(labels == 0, -trust, 0.0))
        known = labels >= 0
        post = 1 / (1 + np.exp(-said))
        # At first only labelled rows say what voters are like.
        part = known.astype(float) if known.any() else np.ones(len(votes))
        self.weight = np.ones(votes.shape[1])
        for _ in range(rounds):
            self._estimate(votes, onehot, post, part)
            logit = np.log(self.prior / (1 - self.prior)) + said + np.einsum("ijk,jk,j->i", onehot, np.log(self.toxic / self.clean), self.weight)
            post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            part = np.ones(len(votes))
        self.posterior = post

    def _estimate(self, votes: np.ndarray, onehot: np.ndarray, post: np.ndarray, part: np.ndarray) -> None:
        one, zero = post * part, (1 - post) * part
        self.prior = float(np.clip(one.sum() / part.sum(), 1e-4, 1 - 1e-4))
        self.toxic = (np.einsum("i,ijk->jk", one, onehot) + 0.1) / (one.sum() + 0.3)
        self.clean = (np.einsum("i,ijk->jk", zero, onehot) + 0.1) / (zero.sum() + 0.3)
        self.accuracy = self.prior * self.toxic[:, 2] + (1 - self.prior) * self.clean[:, 0]
        mean = lambda shares: shares[:, 2] - shares[:, 0]
        rest = (votes - (post[:, None] * mean(self.toxic) + (1 - post[:, None]) * mean(self.clean))) * np.sqrt(part)[:, None]
        cover = rest.T @ rest / part.sum()
        sd = np.sqrt(np.diag(cover)) + 1e-9
        self.correlation = np.where(np.minimum.outer(sd, sd) < 1e-6, 0.0, cover / np.outer(sd, sd))
        np.fill_diagonal(self.correlation, 0)
        self.weight = 1 / (1 + (self.correlation**2 * (np.abs(self.correlation) > 0.3)).sum(axis=1))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights (bias last) for labels between 0 and 1, by Newton's steps."""
    x = np.c_[x, np.ones(len(x))]
    w, eye = np.zeros(x.shape[1]), ridge * len(x) * np.eye(x.shape[1])
    eye[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + eye, x.T @ (y - p) - eye @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, voters: Voters, features: np.ndarray | None = None, toxic: np.ndarray | None = None) -> None:
        """features: what voters read in the sample's texts, votes first; toxic: their labels, -1 without one. Without them only
        the fixed list votes."""
        self.voters, self.weights = voters, None
        if features is not None:
            self.labels = LabelModel(features[:, : len(voters.names)].astype(int), toxic)
            self.weights = logistic(features, self.labels.posterior)

    def score(self, text: str) -> float:
        votes, features = self.voters.read(text)
        if self.weights is None:
            return float(votes[0] > 0)
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights[:-1], features) + self.weights[-1], -30, 30))))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y): what is learned from; y is -1 for a text without a label."""
    rows = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE)
    learnt = (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT) & (F.length("text") <= LEARN_CHARS)
    some = sample_of(docs, learnt, F.lit(0), UNLABELLED).select("doc_id")
    some = some.join(labels.where(F.col("toxic").isNotNull()).select("doc_id"), "doc_id", "left_anti")
    others = docs.select("doc_id", "text").where(learnt).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return rows.unionByName(others.select("doc_id", "t.text", F.lit(-1).alias("y")))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from bounded samples, whose texts are read in tasks."""
    spark = docs.sparkSession
    bounded_batches(spark)

    @F.pandas_udf("words array<string>, least array<bigint>")
    def split(s: pd.Series) -> pd.DataFrame:
        words = [words_of(t) for t in s]
        return pd.DataFrame({"words": list(map(list, words)), "least": list(map(minima, words))})

    dealt = sample(docs, labels).repartition(PARTS, "doc_id")
    table = stored(dealt.withColumn("of", F.when(F.col("y") >= 0, split("text"))).select("doc_id", "text", "y", "of.*"), "toxicity-sample")
    known = table.where("y >= 0").select("doc_id", "y", "least").toPandas().sort_values("doc_id")
    if known["y"].nunique() < 2:
        dropped(table)
        return Model(Voters())
    one = known.iloc[without_copies(known["least"])]
    kept = F.broadcast(spark.createDataFrame([(i,) for i in one["doc_id"].tolist()], table.select("doc_id").schema))
    voters = Voters(mine(table.join(kept, "doc_id").select(F.col("y").alias("toxic"), "words"), len(one), int(one["y"].sum())))
    held = spark.sparkContext.broadcast(voters)

    @F.pandas_udf("binary")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda t: np.array(held.value.read(t)[1]).tobytes())

    said = table.select("doc_id", "y", read("text").alias("features"), (F.col("y") < 0).alias("other")).toPandas().sort_values(["other", "doc_id"])
    dropped(table)
    return Model(voters, np.frombuffer(b"".join(said["features"])).reshape(len(said), -1), said["y"].to_numpy(dtype=int))


def score_column(docs: DataFrame, model: Model, text: Column) -> Column:
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        m = shared.value
        return s.map(m.score).astype(float)

    return score(F.coalesce(text, F.lit("")))


def with_score(docs: DataFrame, labels: DataFrame, name: str = "toxicity") -> DataFrame:
    """All columns of docs and the score, under a free name."""
    return docs.withColumn(fresh(docs, name)[0], score_column(docs, fit(docs, labels), F.col("text")))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    score = score_column(docs, fit(docs, labels), F.col("text"))
    scored = docs.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted to be toxic."""
    tmp = fresh(docs, "_toxicity")[0]
    return docs.withColumn(tmp, score_column(docs, fit(docs, labels), F.col("text"))).where(F.col(tmp) < THRESHOLD).drop(tmp)
