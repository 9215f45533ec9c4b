"""Byte-level BPE, hard negatives and phrase collocations against plain versions on small tables."""

import hashlib
import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from sextant.llm import bytepairs, negatives, phrases


def plain_encoding(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks={t: r for r, t in vocabulary.tokens.items()}, special_tokens={})


@pytest.fixture(scope="module")
def public():
    return bytepairs.load_vocabulary()


ODD = ["", "   ", "\n\n\n  x", "a" * 5000, " " * 4999, "ab" * 3000, "=-" * 2000, "it's we'll 12,345 <|endoftext|>", "中文字 🎉🎉 é́  \x85\x1c", "word " * 20_000]


def test_encode_rows(spark, public):
    texts = [None, *ODD, *ODD[:4]]
    docs = spark.createDataFrame([(i if i % 5 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    plain = plain_encoding(public)
    got = bytepairs.encode(docs, public).withColumn("back", bytepairs.decoded("ids", public)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert list(r.ids) == plain.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    d = {r.doc_id: r for r in bytepairs.digests(docs.where("doc_id is not null"), public).collect()}
    for i, t in enumerate(texts):
        if i % 5:
            ids = plain.encode_ordinary(t or "")
            assert (d[i].n_tokens, d[i].ids_sha256, d[i].decoded_sha256) == (len(ids), *(hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (t or "").encode())))
    assert bytepairs.digests(docs.limit(0), public).collect() == []


@pytest.mark.parametrize("few", [0, 8, 1000])
def test_replay_of_any_ranks(monkeypatch, few):
    """Vocabularies whose ranks aren't in the order of any training, in blocks of all words and of one."""
    monkeypatch.setattr(bytepairs, "FEW", few)
    rng = random.Random(3)
    for _ in range(5):
        tokens = [bytes([b]) for b in range(256)]
        have = set(tokens)
        for _ in range(300):
            t = rng.choice(tokens[97:102] + tokens[256:]) + rng.choice(tokens[97:102] + tokens[256:])
            if t not in have and len(t) < 9:
                have.add(t)
                tokens.append(t)
        own = tokens[256:]
        rng.shuffle(own)
        v = bytepairs.Vocabulary(public_tokenizers.PATTERN, dict(enumerate(tokens[:256] + own)))
        texts, plain = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 80))) for _ in range(300)], plain_encoding(v)
        encoder = bytepairs._Encoder(v)
        assert [x.tolist() for x in encoder(texts)] == [plain.encode_ordinary(t) for t in texts]
        assert [encoder([t])[0].tolist() for t in texts[:40]] == [plain.encode_ordinary(t) for t in texts[:40]]


def test_long_texts_word_by_word(public, monkeypatch):
    monkeypatch.setattr(bytepairs, "LONG", 10)
    text = "one text of several words, " * 30
    assert bytepairs._Encoder(public)([text])[0].tolist() == plain_encoding(public).encode_ordinary(text)


def plain_negatives(rows):
    def ok(r):
        return None not in r and all(x is not None and abs(x) < float("inf") for x in r[2])

    least = {}
    for i, label, v in (r for r in rows if ok(r)):
        key = (label, tuple(int(256 * x // 1) for x in v))
        least[i] = min(least.get(i, key), key)
    out = set()
    for a, (label, v) in least.items():
        if a % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(v, w)), i, m == label) for i, (m, w) in least.items() if i != a)
            for p, pid, _ in [x for x in s if x[2]][:5]:
                found = [(-n, i) for n, i, same in s if not same and 80 * -p <= 100 * -n <= 100 * -p]
                out |= {(a, pid, k, i, -p, n) for k, (n, i) in enumerate(found[:5], start=1)}
    return out


def vectors(seed, n=700):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        center = rng.choice([(1.0, 0.1, 0.0), (0.0, 1.0, -0.2), (-0.7, 0.3, 0.6)])
        v = [round(c + rng.gauss(0, 0.2), 2) for c in center]
        if i % 3 == 0:
            v = [0.5, 0.25, 0.125]  # a third of all rows share one vector
        rows.append((i * 10 if i % 2 else i * 50, rng.randrange(4), v))
    rows += [(rows[5][0], 3, [9.0, 9.0, 9.0]), rows[7], (100_000_000, None, [1.0, 1.0, 1.0]), (200_000_000, 1, None), (300_000_000, 1, [1.0, None, 0.0]), (400_000_000, 1, [float("nan"), 1.0, 0.0]), (None, 1, [1.0, 1.0, 1.0]), (500_000_000, 2, []), (-100, 2, [1.0, 0.5, 0.2]), (600_000_000, 9, [0.9, 0.1, 0.0])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "ROWS", 20)
    monkeypatch.setattr(negatives, "FIRST", 2)
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 as entry", "2 as list").repartition(5)
    got = [tuple(r) for r in negatives.hard_negatives(df).collect()]
    assert set(got) == plain_negatives(rows) and len(got) == len(set(got)) > 1000


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, label int, embedding array<double>"
    assert negatives.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(0, 1, [1.0])], schema)).collect() == []
    large = spark.createDataFrame([(0, 1, [3e6, 1.0]), (1, 1, [3e5, 1.0]), (2, 2, [2.9e5, 1.0])], schema)
    assert {tuple(r) for r in negatives.hard_negatives(large).collect()} == plain_negatives([tuple(r) for r in large.collect()])
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e9])], schema))


def plain_phrases(rows, most_words=3, least=10, most=2000):
    f = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    n = Counter()
    for (lang, w), a in f.items():
        n[lang] += a * (len(w) == 1)
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            found[lang, w] = (a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score)
    held = {(lang, w[i:j]) for (lang, w), x in found.items() for i, j in itertools.combinations(range(len(w) + 1), 2) if j - i < len(w) and 100 * x[0] >= 50 * f[lang, w[i:j]]}
    out = []
    for lang in n:
        own = sorted((-x[4], -x[0], " ".join(w).encode(), x) for (g, w), x in found.items() if g == lang and (g, w) not in held)
        out += [(lang, i, w.decode(), *x) for i, (_, _, w, x) in enumerate(own[:most], start=1)]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = "New york City is a b c É é über 中文 x\x85y nb sp long-word".split(" ")
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    return rows + [("en", None), ("en", ""), ("xx", " .,; "), ("en", "new York city " * 4000)] + [("fr", "le petit chat")] * 12


@pytest.mark.parametrize("block", [50, 32 << 20])
def test_phrases(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rows = texts(block)
    docs = spark.createDataFrame([(i, t, lang, 7, 8) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, block int, word int").repartition(3)
    assert sorted(tuple(r) for r in phrases.top_collocations(docs).collect()) == plain_phrases(rows)
    few = phrases.ranked(phrases.collocations(docs), most=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in few.collect()) == plain_phrases(rows, most=3)


def test_phrases_of_other_lengths(spark):
    rows = texts(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    for words in (2, 5):
        got = phrases.ranked(phrases.collocations(docs, words=words)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, most_words=words)
    assert phrases.top_collocations(docs.limit(0)).collect() == []


def block_batches(seq, local, name):
    """A block as the pairing step gets it: names in batches, the sequence among them."""
    schema = pa.schema([("block", pa.int64()), ("local", pa.int32()), ("id", pa.int64()), ("seq", pa.binary())])
    half = len(local) // 2
    for some in (slice(0, half), slice(half, None)):
        n = len(local[some])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 3)), pa.array(local[some], pa.int32()), pa.array(name[some], pa.int64()), pa.nulls(n, pa.binary())], schema=schema)
        if some.start == 0:
            yield pa.RecordBatch.from_pylist([{"block": 3, "local": -1, "id": -1, "seq": seq.tobytes()}], schema=schema)


@pytest.mark.parametrize("run", [1, 2, 7, 1000])
@pytest.mark.parametrize("last", [False, True])
def test_pairs_in_runs(monkeypatch, run, last):
    """Sorting and passing on a bounded part of a block at a time gives what sorting it whole gives."""
    monkeypatch.setattr(phrases, "RUN", run)
    monkeypatch.setattr(phrases, "OUT", 4)
    rng = random.Random(run)
    for n in (1, 2, 8, 300):
        seq = np.array([rng.randrange(-1, 7) for _ in range(n)], dtype=np.int32)
        named = {0: 70, 2: 50, 3: 90, 6: 10}
        batches = list(phrases._paired(last)(block_batches(seq, list(named), list(named.values()))))
        assert all(len(b) <= 4 for b in batches)
        rows = [r for b in batches for r in b.to_pylist()]
        pairs = [(named.get(a), named.get(b)) for a, b in itertools.pairwise(seq.tolist())]
        plain = Counter(p for p in pairs if None not in p)
        found = [r for r in rows if r["seq"] is None]
        assert {(r["left"], r["right"]): r["n"] for r in found} == plain and [r["local"] for r in found] == list(range(len(plain)))
        assert {r["block"] for r in rows} <= {3} and len(rows) - len(found) == (bool(plain) and not last)
        if plain and not last:
            number = {(r["left"], r["right"]): r["local"] for r in found}
            assert np.frombuffer(rows[-1]["seq"], dtype=np.int32).tolist() == [number.get(p, -1) for p in pairs]


def test_pairs_memory():
    """A block whose pairs are nearly all different takes less than 64 bytes a word of a worker, output included."""
    words, names = 2_000_000, 200_000
    rng = np.random.default_rng(5)
    seq = rng.integers(0, names, words).astype(np.int32)
    batches = list(block_batches(seq, np.arange(names), rng.permutation(names)))
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    pairs = most = 0
    for batch in phrases._paired(False)(iter(batches)):
        pairs += int(batch.num_rows)
        most = max(most, pa.total_allocated_bytes() - arrow)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs > 0.9 * words
    assert peak + most < 64 * words
