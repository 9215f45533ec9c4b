"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeated rows and
extra columns; and on an empty table."""

import base64
import collections
import hashlib
import io
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from sextant.llm import chat, decontaminate, fingerprints, langid, pieces, quality, simhash, toxicity, warc, wordpiece

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, words string"


def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [(i, text(rng.randint(1, 60)), "en", "s", 1, 7, "x") for i in range(40)]
    base = text(400)
    out += [(100 + i, base.replace(vocabulary[i], "zz", 1), "en", "hot", 1, 7, "x") for i in range(12)]
    out += [(200, None, None, None, None, None, None), (201, "", "fr", "s", 0, 7, "x"), (202, " \n\t ", "fr", "s", 3, 7, "x"), (203, "One", "en", "s", 3, 7, "x")]
    out += [(204, "A" * 5000, "en", "s", 1, 7, "x"), (205, text(6000), "en", "s", 1, 7, "x"), (206, "日本語 𝒳 ▁ 　 é\x00 x  y\n\n", "ja", "s", 1, 7, "x")]
    out += [out[3], out[3], (300, out[5][1], "de", "t", 1, 7, "x")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, empty):
    got = {}
    for r in fingerprints.fingerprint_edits(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    data = sorted(((i, t or "") for i, t, *_ in rows()), key=lambda x: (-x[0], x[1]))
    want = {}
    for k, (i, t) in enumerate(data):
        n, other = len(t), data[(k + 1) % len(data)][1]
        edited = t[: n - n // 2] + other[: n // 2]
        want.setdefault(i, []).append((n, hashlib.sha256(edited.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(edited), fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(other))))
    assert {i: sorted((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_next) for r in v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_prefix_hashes_answer_spans():
    a, b = "the cat sat on the mat, the cat sat", "on the mat, the dog"
    x, y = (fingerprints.PrefixHash(fingerprints.codes_of(t)) for t in (a, b))
    for i in range(len(a)):
        for j in range(len(b)):
            n = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
            assert x.common_extension(i, y, j) == n
    assert fingerprints.likeness(fingerprints.fingerprint(""), fingerprints.fingerprint("a")) == 0


def test_likeness_follows_shared_text():
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdefghij ") for _ in range(4000)) for _ in range(2))
    near = fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(a[:3600] + b[:400]))
    half = fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(a[:2000] + b[:2000]))
    assert near > 0.75 > half > 0.25 and fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) < 0.05


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(data, items):
    w = lambda t: WORD.findall((t or "").translate(LOWER))
    out = []
    for i, t, *_ in data:
        d, hit, found = w(t), set(), set()
        for item, text in items:
            b = w(text)
            k = min(13, len(b))
            grams = {tuple(b[s : s + k]) for s in range(len(b) - k + 1)} if k else set()
            for s in range(len(d) - k + 1) if k else ():
                if tuple(d[s : s + k]) in grams:
                    hit |= set(range(s, s + k))
                    found |= {item} - {None}
        out.append((i, len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(d)))
    return out


@pytest.mark.parametrize("most", [100_000, 0])
def test_contamination(spark, docs, empty, monkeypatch, most):
    # With 0 nothing is broadcast: every join goes by its shuffle.
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    monkeypatch.setattr(decontaminate, "MOST_PLACED", most)
    data = rows()
    long = data[45][1].split()
    items = [(1, " ".join(long[5:40])), (10, " ".join(long[100:113]).upper()), (2, data[4][1]), (3, None), (4, "..."), (5, "One"), (5, " ".join(long[200:230])), (6, " ".join(long[300:312] + ["absent"])), (None, "日本語")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in decontaminate.contamination(docs, b).collect()]
    assert sorted(got) == sorted(brute_contamination(data, items))
    assert decontaminate.contamination(empty, b).count() == 0
    none = decontaminate.contamination(docs, b.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(data)
    kept = decontaminate.clean(docs, b)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {g[0] for g in got} - {g[0] for g in got if g[5]}


def test_phrase_and_proximity_search(spark):
    data = [(1, "a b c a b d"), (2, "b a c"), (3, "d x x b"), (4, "alpha beta"), (5, "alpha x alpha"), (6, None)]
    d = spark.createDataFrame(data, "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a b"), (2, "b d"), (3, "a zz"), (4, "a a"), (5, "alpha alpha"), (6, ""), (7, None), (8, "x")], "query_id int, phrase string")
    for terms in (None, q.select(F.explode(decontaminate.words(F.col("phrase"))).alias("term")).distinct()):
        index = decontaminate.build_index(d, terms)
        assert sorted((r.query_id, r.doc_id, r.starts) for r in decontaminate.search(index, q).collect()) == [(1, 1, [0, 3]), (2, 1, [4]), (8, 3, [1, 2]), (8, 5, [1])]
        near = {(r.query_id, r.doc_id) for r in decontaminate.search(index, q.where("query_id <= 2"), slop=4).collect()}
        assert near == {(1, 1), (1, 2), (2, 1), (2, 3)}
        # A term that the phrase has twice must be there twice.
        twice = {(r.query_id, r.doc_id): r.starts for r in decontaminate.search(index, q.where("query_id >= 4"), slop=3).collect()}
        assert twice == {(5, 5): [0, 2], (8, 3): [1, 2], (8, 5): [1]}
    rng = random.Random(2)
    text = [[rng.choice("abcde") for _ in range(40)] for _ in range(12)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(text)], "doc_id bigint, text string")
    asked = [[rng.choice("abcde") for _ in range(rng.randint(1, 4))] for _ in range(10)]
    index = decontaminate.build_index(docs)
    got = sorted((r.query_id, r.doc_id, r.starts) for r in decontaminate.search(index, spark.createDataFrame([(i, " ".join(a)) for i, a in enumerate(asked)], "query_id int, phrase string")).collect())
    want = [(i, k, s) for i, a in enumerate(asked) for k, t in enumerate(text) if (s := [x for x in range(41 - len(a)) if t[x : x + len(a)] == a])]
    assert got == want


def test_long_phrases(spark):
    """Phrases longer than a window, at its length and beside it, with repeats of a part and a word that differs."""
    rng = random.Random(8)
    text = [[rng.choice("abcdefgh") for _ in range(120)] for _ in range(4)] + [["a"] * 90, ["a", "b"] * 60]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(text)], "doc_id bigint, text string")
    asked = [text[i][low : low + n] for i, low, n in [(0, 3, 31), (0, 5, 32), (1, 0, 33), (2, 40, 64), (2, 7, 65), (3, 0, 120), (4, 0, 70), (5, 1, 100)]]
    asked += [text[1][:40] + ["z"] + text[1][41:80], text[0][:33] + text[1][:33], ["a"] * 91]
    index = decontaminate.build_index(docs)
    found = decontaminate.search(index, spark.createDataFrame([(i, " ".join(a)) for i, a in enumerate(asked)], "query_id int, phrase string"))
    want = [(i, k, s) for i, a in enumerate(asked) for k, t in enumerate(text) if (s := [x for x in range(len(t) + 1 - len(a)) if t[x : x + len(a)] == a])]
    assert sorted((r.query_id, r.doc_id, r.starts) for r in found.collect()) == want and len(want) >= 8


def test_token_counts(docs, empty):
    vocabulary = [bytes([b]) for b in range(256)] + [b" ab", b"abc", b"cde", b"bcdef", b" a", b"de", b"fg", b"efgab", "é".encode()]
    known = set(vocabulary)

    def greedy(w):
        n = i = 0
        while i < len(w):
            i = next(j for j in range(len(w), i, -1) if w[i:j] in known)
            n += 1
        return n

    got = wordpiece.with_token_counts(docs, pieces=vocabulary)
    for r in got.collect():
        words = (r.text or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w) for w in words))
    assert set(docs.columns) < set(got.columns) and wordpiece.with_token_counts(empty, pieces=vocabulary).count() == 0
    assert wordpiece.Automaton([b" a", b"b"]).count(b" ac") == 1


def brute_simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    data = rows()
    fp = [brute_simhash(t) for _, t, *_ in data]
    group = list(range(len(fp)))
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    least = {g: min(d[0] for d, k in zip(data, group) if k == g) for g in set(group)}
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((d[0], f, least[g]) for d, f, g in zip(data, fp, group))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(least.values())
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one_row_of_each_component(spark):
    x, y, z = ("the quick brown fox jumps over the lazy dog", "completely other words stand in this second text", "0123456789 numbers only here 9876543210")
    data = [(1, x), (1, x), (2, x), (None, x), (2, y), (None, z), (None, z)]
    got = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, x), (2, y), (0, z)])


def brute_similarity(s, t):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.translate(LOWER).split() for x in (s, t)))
    return len(a & b) / max(1, len(a | b))


def edited(rng, vocabulary, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = rng.choice(vocabulary)
    return " ".join(out)


def test_similarity_by_least_shingles():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    least = lambda t: simhash.least_of(simhash.long_shingles(simhash.shingle_hashes(t)))
    for length, tolerance in ((5, 1e-9), (60, 1e-9), (500, 1e-9), (20_000, 0.06)):
        words = [rng.choice(vocabulary) for _ in range(length)]
        for n in (0, 1, length // 100, length // 20):
            a, b = " ".join(words), edited(rng, vocabulary, words, n)
            assert abs(simhash.similarity(least(a), least(b)) - brute_similarity(a, b)) <= tolerance
    assert len(simhash.long_shingles(simhash.shingle_hashes("four words are few"))) == len(simhash.long_shingles(simhash.shingle_hashes(None))) == 0


def test_keep_one_by_likeness(spark, empty):
    """Components of links by fingerprint and by exact similarity; groups of near copies, chains, repeats, null and short texts."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    data = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 300)))) for i in range(60)]
    for g in range(12):
        words = [rng.choice(vocabulary) for _ in range(150)]
        data += [(1000 + 100 * g + k, edited(rng, vocabulary, words, 1 + k % 2)) for k in range(8)]
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for k in range(6):
        chain = edited(rng, vocabulary, chain, 2).split()
        data.append((5000 + k, " ".join(chain)))
    half = [rng.choice(vocabulary) for _ in range(100)]
    data += [(6000 + k, " ".join(half + [rng.choice(vocabulary) for _ in range(60)])) for k in range(5)]
    data += [(7000, "one two three"), (7001, "One  two three"), (7002, ""), (7003, None), data[0], data[70], data[70]]
    fp, group = [brute_simhash(t) for _, t in data], list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= simhash.RADIUS or brute_similarity(data[i][1] or "", data[j][1] or "") >= simhash.LIKE:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    want = sorted(min(d[0] for d, k in zip(data, group) if k == g) for g in set(group))
    table = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(table, likeness=True).collect()) == want
    assert len(want) < simhash.keep_one(table).count() and simhash.keep_one(empty, likeness=True).count() == 0


def test_near_copies_in_large_buckets(spark):
    """1,200 planted pairs of texts that all have one passage, so that buckets are large and get split: recall, and nothing
    else goes."""
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    passage, data, alike = [rng.choice(vocabulary) for _ in range(110)], [], set()
    for i in range(1200):
        words = passage + [rng.choice(vocabulary) for _ in range(50)]
        pair = (" ".join(words), edited(rng, vocabulary, words, 1 + i % 3))
        data += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
        if brute_similarity(*pair) >= simhash.LIKE:
            alike.add(2 * i + 1)
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    sketched = simhash.with_sketch(table, "text").select("doc_id", "like.*").collect()
    sizes = collections.Counter(b for r in sketched for b in r.bands)
    assert max(sizes.values()) > 2 * simhash.SPLIT and all(len(r.parts) == simhash.PARTS for r in sketched)
    gone = {i for i, _ in data} - {r.doc_id for r in simhash.keep_one(table, likeness=True).select("doc_id").collect()}
    # Else only what is within the radius of another document's fingerprint, by chance, goes.
    fps = np.array([r.fp for r in sorted(sketched, key=lambda r: r.doc_id)]).view(np.uint64)
    near = {i for i, _ in data if (np.bitwise_count(fps ^ fps[i]) <= simhash.RADIUS).sum() > 1}
    assert len(alike) > 1000 and gone <= {2 * i + 1 for i in range(1200)} | near
    assert len(gone & alike) >= 0.97 * len(alike)


def test_gray_index_finds_every_component():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    ball = np.array([base ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(20, 3, replace=False)) for _ in range(300)], dtype=np.uint64)
    f = np.unique(np.concatenate([ball, rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    f = f[np.argsort(simhash.gray_rank(f))]
    root = simhash.GrayIndex(f, np.zeros(len(f), dtype=int)).components()
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    label = np.arange(len(f))
    for _ in range(len(f)):
        new = np.where(near, label[None, :], len(f)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert (label == root).all()


def test_chat(spark):
    texts = ["[INST]", "[\\INST]", "<\\\\s>", "<<|end|>", "<|turn|>x<|end|>", "a\\", "<", "|end|>", "</s></s>", "", None, "<<SYS>>\n<</SYS>>", "é𝒳"]
    data = [(1, i, "a\nb<|end|>" if i == 3 else "assistant" if i % 2 else "user", t, 9) for i, t in enumerate(texts)] + [(None, 0, None, "x", 9), (2, None, "user", "u", 9), (2, 1, "assistant", "a", 9), (2, 1, "assistant", "a", 9)]
    turns = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, formatted bigint")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.with_special(turns))).collect()}
    assert set(got) == {1, 2, None, -7}
    lines = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t, _ in data if c == 1)
    trained = "".join(t or "" for c, _, r, t, _ in data if c == 1 and r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(lines.encode()).hexdigest() and got[1].loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars, got[-7].loss_chars) == (len(texts), len(trained), 2, len(chat.SPECIAL_TEXT))
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda kind, **kw: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | kw
    parts = [part("text", text="see <|image|>"), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=2.0), None, part("document", ref="c.pdf", pages=3)]
    df = spark.createDataFrame([(1, 0, "user", None, parts)], f"conv_id bigint, turn bigint, role string, text string, parts array<{chat.PART}>")
    r = chat.format_chats(df, F.col("parts")).first()
    assert r.formatted == "<|turn|>user\nsee <\\|image|><|image|><|audio|><|document|><|end|>"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 50), ("document", "c.pdf", 1536)] and r.expanded_tokens == 1589


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, least):
    data = [(1, "u", "same payload"), (7, None, "same payload"), (3, "é", None), (4, "u", ""), (5, "u\n", "x" * 1000 + "é"), (6, "u", "x" * 1000 + "é"), (9, "u", "short"), (8, "u", "short"), (7, None, "same payload"), (None, "u", "lost")]
    pages = spark.createDataFrame([(*d, 1) for d in data], "page_id bigint, url string, html string, n bigint").repartition(3)
    keep = {}
    for i, _, h in data:
        keep[h or ""] = max(keep.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in data:
        b, k = (h or "").encode(), keep[h or ""]
        again = len(b) >= least and k != -1 and k != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", k if again else None))
    got = [tuple(r) for r in warc.round_trip(pages.select("page_id", "url", "html"), least, chunk=100).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    out = io.BytesIO()
    chunks = warc.archive(pages, least, chunk=100)
    assert warc.export_file(chunks, out) == len(out.getvalue()) and out.getvalue().count(b"WARC/1.1\r\n") == len(data)
    assert chunks.agg(F.max(F.length("data"))).first()[0] < 1000
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pieces_by_merges_are_those_of_the_model(spark, docs, empty):
    p = pieces.load_pieces()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert p.merges
    encoded = pieces.encode(docs, p).cache()
    got = {}
    for r in encoded.collect():
        got.setdefault(r.doc_id, r.ids)
    # U+2581 is a character of its own here, and a space to the model.
    data = [(i, t or "") for i, t, *_ in rows() if "\u2581" not in (t or "")]
    assert len(data) > 55
    for i, t in data:
        assert got[i] == model.encode(t), i
    # A unit of exactly LONGEST characters, whose last node is the sign bit, is in the lattice.
    full = ("re" * pieces.LONGEST)[: pieces.LONGEST - 1]
    one = spark.createDataFrame([(0, full), (1, "a"), (2, "\u6f22"), (3, "\U0001f600")], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in pieces.encode(one, p).collect()} == {0: model.encode(full), 1: model.encode("a"), 2: model.encode("\u6f22"), 3: model.encode("\U0001f600")}
    long = [(1, "x" * 63 + "ab"), (2, "\U0001f600" * 200), (3, "la" * 200 + " y"), (4, "\u6f22\U0001f600" * 90), (5, " " * 70), (6, " " * 16 + "re" * 23 + "s")]
    cut = spark.createDataFrame(long, "doc_id long, text string")
    back = pieces.decode_texts(pieces.encode(cut, p), p)
    assert {r.doc_id: r.text for r in back.collect()} == dict(long)
    assert all(r.exact for r in pieces.token_summary(cut, p).collect())
    assert {r.doc_id: r.text for r in pieces.decode_texts(encoded, p).collect()} == {i: t or "" for i, t, *_ in rows()}
    assert pieces.token_summary(empty, p).count() == 0


def test_pieces_of_long_units_are_those_of_the_model(spark):
    p = pieces.load_pieces()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    mixed = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000))
    texts = ["re" * 24, "la" * 200 + " y", "https://example.org/" + "some-long-path/" * 9, mixed, "\u6f22\u5b57\u306e" * 60, "\U0001f600" * 70, " " * 17 + "x", "a\n" + " " * 40 + "return x", " " * 300, "=" * 5000, "x" * 63 + "ab"]
    long = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frequent in (2, 1_000_000):
        got = {r.doc_id: r.ids for r in pieces.encode(long, p, frequent=frequent).collect()}
        assert got == {i: model.encode(t) for i, t in enumerate(texts)}
    known = {s: (x, i) for i, s, x in p.rows}
    for t in (" sentence", " ab\u6f22", " " * 5 + "return"):
        assert pieces.long_merge(t, known, p.byte_ids) == model.encode(t[1:])


def test_units_are_cut_where_no_piece_can_cross():
    p = pieces.load_pieces()
    beside = {x[i : i + 2] for _, x, _ in p.rows for i in range(len(x) - 1)}
    rng = random.Random(7)
    texts = ["", " a, b", "", " x\ny  z9", "".join(rng.choice(" aeiou.,é日本\n12=") for _ in range(500)), "", " \U0001f600\U0001f600"]
    for array in (pa.array(texts, pa.string()), pa.array(["zz", *texts, "zz"], pa.string())[1:-1]):
        units, counts = pieces.Cutter(p).cut(array)
        units, at = units.to_pylist(), 0
        for t, n in zip(texts, counts.tolist()):
            mine, at = units[at : at + n], at + n
            assert "".join(mine) == t and all(mine)
            assert all(a[-1] + b[0] not in beside for a, b in zip(mine, mine[1:])) and all(u[i : i + 2] in beside for u in mine for i in range(len(u) - 1))


def test_numbers_are_packed_and_unpacked():
    codes = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 0], dtype=np.int32)
    data, size = pieces.pack(codes)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 3, 1] and pieces.unpack(data).tolist() == codes.tolist()
    assert len(pieces.unpack(pieces.pack(codes[:0])[0])) == 0


def test_pieces_by_viterbi(docs):
    ranked = pieces.load_pieces()
    p = pieces.Pieces(tuple((i, s, -1.5 - math.log(2 + i)) for i, s, _ in ranked.rows), ranked.byte_ids)
    assert not p.merges
    score = {s: (x, i) for i, s, x in p.rows}
    longest, fallback = p.longest, p.fallback
    data = [(i, t) for i, t, *_ in rows() if len(t or "") < 500]

    def viterbi(t):
        t = " " + t if t else ""
        best = [(0.0, 0, 0)]
        for end in range(1, len(t) + 1):
            paths = []
            for start in range(max(0, end - longest), end):
                if (x := score.get(t[start:end])) is not None:
                    paths.append((best[start][0] + x[0], start, x[1]))
                elif end - start == 1:
                    paths.append((best[start][0] + fallback, start, -1))
            best.append(max(paths))
        out, at = [], len(t)
        while at:
            _, start, i = best[at]
            out = ([i] if i >= 0 else [p.byte_ids[b] for b in t[start:at].encode()]) + out
            at = start
        return out

    got = {}
    encoded = pieces.encode(docs, p).cache()
    for r in encoded.collect():
        got.setdefault(r.doc_id, r.ids)
    for i, t in data:
        assert got[i] == viterbi(t or ""), i
    texts = {i: t or "" for i, t, *_ in rows()}
    assert {r.doc_id: r.text for r in pieces.decode_texts(encoded, p).collect()} == texts
    for frequent in (3, 1_000_000):
        s = pieces.token_summary(docs, p, frequent=frequent).collect()
        assert len(s) == len(rows()) and all(r.exact and r.n_pieces == len(got[r.doc_id]) for r in s)


def test_pieces_of_documents_leave_the_query(spark):
    p = pieces.load_pieces()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    data = [(1, "one two one"), (1, "one two one"), (2, None), (3, "two\nrare word one"), (3, "other"), (None, "one rare"), (4, " ")]
    some = spark.createDataFrame(data, "doc_id long, text string")
    for frequent in (0, 2, 1_000_000):
        got = sorted(((r.doc_id or 0, r.ids, r.exact) for r in pieces.token_summary(some, p, frequent=frequent).collect()))
        assert got == sorted((i or 0, model.encode(t or ""), True) for i, t in data)


def labelled(spark):
    rng = random.Random(3)
    data, labels = [], []
    words = {"en": ["the", "house", "that", "with", "water", "thing"], "de": ["das", "haus", "nicht", "wasser", "und", "schön"], "fr": ["la", "maison", "avec", "eau", "très", "chose"]}
    for lang, own in words.items():
        words[lang] = own * 8 + [rng.choice(own) + "".join(rng.choice(own)[:2] for _ in range(3)) for _ in range(300)]
    for i in range(400):
        lang = rng.choice(list(words))
        lines = [" ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 12))).capitalize() + "." for _ in range(rng.randint(2, 6))]
        bad, toxic = rng.random() < 0.25, rng.random() < 0.3
        if bad:
            lines[1:] = [" | ".join(x.split()) + " %%% ###" for x in lines[1:]]
        if toxic:
            lines[0] += " " + rng.choice(["moron", "snarfel", "snarfing", "snarfo"])
        data.append((i, "\n".join(lines), lang, "s", 1))
        labels.append((i, int(not bad), int(toxic)))
    data += [(1000, None, None, "s", 0), (1001, "", None, "s", 0), (1002, "12 34 !!", "en", "s", 0), data[0]]
    labels += [(5000, 1, 0), (1, None, None)]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, score string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.95)])
def test_classifiers(spark, module, label, least):
    docs, labels = labelled(spark)
    got = module.predictions(docs, labels).cache()
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    held = got.where("held_out").join(labels, "doc_id").where(F.col(label).isNotNull())
    assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least
    keep = (module.keep_good if module is quality else module.keep_clean)(docs, labels)
    assert keep.columns == docs.columns and 0 < keep.count() < docs.count()
    # No labels; no documents; the labels of held-out rows don't matter.
    assert module.predictions(docs, labels.limit(0)).count() == docs.count()
    assert module.predictions(docs.limit(0), labels).count() == 0
    held_ids = got.where("held_out").select("doc_id").distinct()
    turned = labels.join(held_ids.withColumn("h", F.lit(1)), "doc_id", "left").select("doc_id", *[F.when(F.col("h") == 1, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    assert sorted(map(tuple, module.predictions(docs, turned).collect())) == sorted(map(tuple, got.collect()))


def test_language(spark):
    docs, _ = labelled(spark)
    got = langid.predictions(docs).cache()
    by = {r.doc_id: r for r in got.collect()}
    assert by[1000].lang_pred == by[1001].lang_pred == by[1002].lang_pred == "und" and got.count() == docs.count()
    held = got.where("held_out").join(docs.select("doc_id", "lang").distinct(), "doc_id").where("doc_id < 1000")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97
    assert langid.predictions(docs.limit(0)).count() == 0
    assert langid.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0


def test_label_model_trusts_agreeing_voters():
    rng = np.random.default_rng(2)
    y = rng.random(2000) < 0.3
    votes = np.stack([np.where(rng.random(2000) < acc, y, ~y) * 2 - 1 for acc in (0.9, 0.85, 0.8, 0.55)], axis=1)
    votes = np.c_[votes, votes[:, 0]]
    model = toxicity.LabelModel(votes, np.where(rng.random(2000) < 0.9, y, ~y).astype(int))
    assert ((model.posterior > 0.5) == y).mean() > 0.93 and model.correlation[0, 4] > 0.9 and model.weight[0] < model.weight[2]
