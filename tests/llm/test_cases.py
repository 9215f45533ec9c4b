"""Cases that the operators must hold at any size of ids, texts and groups, and models against brute force."""

import base64
import hashlib
import itertools
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import chat, common, fingerprints, langid, quality, simhash, toxicity, warc

BIG = 2**53


def test_large_ids_stay_whole_beside_null_ids(spark):
    data = [(BIG + 1, "a first text"), (BIG + 3, "a second text"), (None, "lost"), (-BIG - 5, "low")]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(data, "doc_id bigint, text string").coalesce(1))
    assert dict(got.dtypes)["doc_id"] == "bigint" and {r.doc_id for r in got.collect()} == {d[0] for d in data}
    pages = [(BIG + 1, "u", "one payload"), (5, "u", "one payload"), (7, "u", "another"), (BIG + 3, "u", None), (None, "u", "x")]
    back = warc.round_trip(spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1))
    rows = {r.page_id: r for r in back.collect()}
    assert set(rows) == {p[0] for p in pages} and rows[5].refers_to == BIG + 1 and rows[5].record_type == "revisit"
    assert rows[BIG + 1].refers_to is None and rows[7].refers_to is None
    digest = base64.b32encode(hashlib.sha1(b"one payload").digest()).decode()
    assert rows[5].payload_digest == rows[BIG + 1].payload_digest == digest and dict(back.dtypes)["refers_to"] == "bigint"


def test_likeness_against_exact_sets_of_spans():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    spans = lambda t: {t[i : i + fingerprints.SPAN] for i in range(len(t) - fingerprints.SPAN + 1)}
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        n = int(len(base) * share)
        other = base[:n] + "".join(rng.choice("abcdefgh ") for _ in range(len(base) - n))
        a, b = spans(base), spans(other)
        dice = 2 * len(a & b) / (len(a) + len(b))
        assert abs(fingerprints.likeness(fingerprints.fingerprint(base), fingerprints.fingerprint(other)) - dice) < 0.2
    h = fingerprints.PrefixHash(fingerprints.codes_of(base))
    seen = {}
    for i, j in itertools.product(range(0, 400, 7), range(1, 40, 3)):
        assert seen.setdefault(h.span(i, i + j), base[i : i + j]) == base[i : i + j]


def test_samples_are_bounded_and_of_one_row_a_document(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en") for i in range(500)] + [(i, f"other {i}", "de" if i % 2 else "fr") for i in range(2, 300)] + [(2, None, "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 300)] + [(1, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = common.labelled_sample(docs, labels, "quality", 4, 2, 2).collect()
    assert len(got) <= 2
    whole = common.labelled_sample(docs, labels, "quality", 4, 2, 1000).collect()
    assert len({r.doc_id for r in whole}) == len(whole) and all(r.y == 1 for r in whole)
    again = common.labelled_sample(docs.repartition(7), labels, "quality", 4, 2, 1000).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, again))
    some = common.sample_of(docs, F.lit(True), F.col("lang"), 20).collect()
    assert all(n <= 20 for n in (sum(r.g == g for r in some) for g in ("en", "de", "fr"))) and len({(r.g, r.doc_id) for r in some}) == len(some)


def test_labels_without_documents_take_no_room_in_a_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10_000)] + [(None, 1)], "doc_id bigint, quality int")
    got = common.labelled_sample(docs, labels, "quality", 4, 2, 50).collect()
    assert len(got) == 50 and all(r.text == f"text {r.doc_id}" and r.y == r.doc_id % 2 for r in got)
    assert common.labelled_sample(docs.limit(0), labels, "quality", 4, 2, 50).count() == 0
    assert common.labelled_sample(docs, labels.limit(0), "quality", 4, 2, 50).count() == 0


def test_long_texts_are_learned_from_whole_where_others_are_few(spark):
    long = "x" * (2 * common.LEARN_CHARS)
    docs = spark.createDataFrame([(i, long if i % 2 else f"text {i}") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    whole = common.labelled_sample(docs, labels, "quality", 4, 2, 100).collect()
    assert len(whole) > 20 and all(r.text == (long if r.doc_id % 2 else f"text {r.doc_id}") for r in whole)
    few = common.labelled_sample(docs, labels, "quality", 4, 2, 10).collect()
    assert len(few) == 10 and all(r.y == 0 for r in few)
    some = common.labelled_sample(docs.where("doc_id % 2 = 1"), labels, "quality", 4, 2, 5).collect()
    assert len(some) == 2 and all(r.text == long for r in some)


def test_repeated_rows_have_records_of_their_own(spark):
    pages = [(5, "u", "x"), (5, "u", "x"), (3, "u", "x"), (4, "v", "y"), (2, "v", "y"), (9, "w", ""), (9, "w", ""), (1, "w", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for least in (0, 1):
        heads = [bytes(r.data).split(b"\r\n\r\n")[0].decode() for r in warc.archive(df, least).collect()]
        own = [line.split(": ")[1] for h in heads for line in h.split("\r\n") if line.startswith("WARC-Record-ID: ")]
        refers = [line.split(": ")[1] for h in heads for line in h.split("\r\n") if line.startswith("WARC-Refers-To: ")]
        assert len(set(own)) == len(own) == len(pages) and set(refers) <= set(own) and len(refers) == 1
        back = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.round_trip(df, least).collect())
        empty = [(1, "revisit", 9)] if least == 0 else [(1, "response", 0)]
        assert back == sorted([(5, "response", 0)] * 2 + [(3, "revisit", 5), (4, "response", 0), (2, "revisit", 4)] + [(9, "response", 0)] * 2 + empty)


def test_signs_that_are_no_letters_have_no_language():
    model = langid.Model(["the house and the water"] * 3 + ["das haus und das wasser"] * 3, ["en"] * 3 + ["de"] * 3)
    texts = ["²", "½", "Ⅷ", "①", "12 !", "", None, "the water", "das wasser " * 50_000]
    assert [x for x, _ in model.predict(texts)] == ["und"] * 7 + ["en", "de"]
    assert all(0 <= s <= 1 for _, s in model.predict(texts))


def test_kernel_against_sets_of_ngrams():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd 日本語éß.!") for _ in range(rng.randint(1, 60))) for _ in range(12)] + ["\U0001f600", "a"]

    def sets(t):
        words = "".join(c if c.isalpha() else " " for c in t.lower())
        s = f" {' '.join(words.split())} ".replace("  ", " ")
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    marks = texts[:5]
    got = langid.Kernel([langid.letters(t) for t in marks])([langid.letters(t) for t in texts])
    for i, t in enumerate(texts):
        for j, m in enumerate(marks):
            a, b = sets(t), sets(m)
            assert got[i, j] == pytest.approx(len(a & b) / math.sqrt(len(a) * len(b))), (t, m)
    # Nyström and ridge in the landmarks' span: with all texts as landmarks that is kernel ridge regression itself.
    k = langid.Kernel([langid.letters(t) for t in texts])([langid.letters(t) for t in texts])
    values, vectors = np.linalg.eigh(k)
    kept = values > 1e-6
    phi = k @ (vectors[:, kept] / np.sqrt(values[kept]))
    assert np.allclose(phi @ phi.T, k, atol=1e-6)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(4)
    chain = quality.Chain()
    chain.transition = rng.normal(size=(2, 2))
    lines = np.array([1, 5, 3, 1])
    node = rng.normal(size=int(lines.sum()))
    good, pairs, log_z = chain.marginals(node, lines)
    want, want_pairs, want_z, at = [], np.zeros((2, 2)), 0.0, 0
    for n in lines:
        total, by, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(node[at + i] for i in range(n) if path[i]) + sum(chain.transition[a, b] for a, b in zip(path, path[1:])))
            total += w
            by += w * np.array(path)
            for a, b in zip(path, path[1:]):
                two[a, b] += w
        want += list(by / total)
        want_pairs += two / total
        want_z += math.log(total)
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and log_z == pytest.approx(want_z)


def test_document_quality_is_the_mean_marginal_by_length():
    texts = ["Good words stand here.\nAnd more of them.", "| a | b | %%% ###\n| c | d | $$$", "", "x" * 200_000 + "\nend."] * 4
    model = quality.Model(texts, np.array([1, 0, 0, 1] * 4))
    x, size, lines = quality.line_features(texts)
    good = model.chain.marginals(x @ model.chain.w, lines)[0]
    edge = np.r_[0, np.cumsum(lines)]
    for k, score in enumerate(model.scores(texts)):
        part = slice(edge[k], edge[k + 1])
        share = np.clip(np.average(good[part], weights=np.maximum(size[part], 1)), 1e-4, 1 - 1e-4)
        assert score == pytest.approx(1 / (1 + math.exp(-(model.curve[0] * math.log(share / (1 - share)) + model.curve[1]))))


def test_label_model_against_a_plain_loop():
    rng = np.random.default_rng(8)
    y = rng.random(300) < 0.3
    votes = np.stack([np.where(rng.random(300) < 0.7, np.where(rng.random(300) < acc, y, ~y) * 2 - 1, 0) for acc in (0.9, 0.8, 0.7)], axis=1)
    labels = np.where(rng.random(300) < 0.3, y, -1).astype(int)
    model = toxicity.LabelModel(votes, labels, rounds=5)
    trust = math.log(toxicity.LABEL_ACCURACY / (1 - toxicity.LABEL_ACCURACY))
    said = [trust if v == 1 else -trust if v == 0 else 0.0 for v in labels]
    post, part = [1 / (1 + math.exp(-s)) for s in said], [float(v >= 0) for v in labels]
    for _ in range(5):
        ones, total = sum(p * w for p, w in zip(post, part)), sum(part)
        prior = ones / total
        share = lambda j, v, k: (sum((p if k else 1 - p) * w for p, w, r in zip(post, part, votes) if r[j] == v) + 0.1) / ((ones if k else total - ones) + 0.3)
        p1, p0 = ([[share(j, v, k) for v in (-1, 0, 1)] for j in range(3)] for k in (1, 0))
        rest = [[(r[j] - p * (p1[j][2] - p1[j][0]) - (1 - p) * (p0[j][2] - p0[j][0])) for j in range(3)] for r, p in zip(votes, post)]
        cover = [[sum(w * r[a] * r[b] for r, w in zip(rest, part)) / total for b in range(3)] for a in range(3)]
        rho = [[0.0 if a == b else cover[a][b] / math.sqrt(cover[a][a] * cover[b][b]) for b in range(3)] for a in range(3)]
        weight = [1 / (1 + sum(x * x for x in row if abs(x) > 0.3)) for row in rho]
        post = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + s + sum(weight[j] * math.log(p1[j][r[j] + 1] / p0[j][r[j] + 1]) for j in range(3))))) for s, r in zip(said, votes)]
        part = [1.0] * 300
    assert np.allclose(model.posterior, post, atol=1e-6)
    unlabelled = labels < 0
    assert ((model.posterior > 0.5) == y)[unlabelled].mean() > 0.85


def test_unlabelled_rows_inform_the_label_model():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < acc, y, ~y) * 2 - 1 for acc in (0.95, 0.9, 0.6)], axis=1)
    labels = np.full(4000, -1)
    labels[:60] = y[:60]
    model = toxicity.LabelModel(votes, labels)
    assert abs(model.accuracy[0] - 0.95) < 0.05 and abs(model.accuracy[2] - 0.6) < 0.05


def part(kind, **kw):
    return {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | kw


def test_control_strings_across_parts_are_escaped(spark):
    cases = [
        [part("text", text="<"), part("text", text="|end|>x")],
        [part("text", text="[IN"), part("text", text=None), part("text", text="ST] a"), part("image"), part("text", text="<"), part("text", text="/s>")],
        [part("text", text="a <"), part("image"), part("text", text="|end|>")],
        [],
        None,
    ]
    df = spark.createDataFrame([(i, 0, "user", None, p) for i, p in enumerate(cases)], f"conv_id int, turn int, role string, text string, parts array<{chat.PART}>")
    out = chat.format_chats(df, F.col("parts")).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"))
    got = {r.conv_id: r for r in out.collect()}
    assert [t.text for t in got[0].turns] == ["<|end|>x"] and got[0].formatted.count("<|end|>") == 1
    assert [t.text for t in got[1].turns] == ["[INST] a<|image|></s>"]
    assert [t.text for t in got[2].turns] == ["a <<|image|>|end|>"] and [t.text for t in got[3].turns] == [t.text for t in got[4].turns] == [""]


def test_scores_take_free_names_and_whole_texts(spark):
    data = [(i, ("Good words stand here. " if i % 2 else "| % # moron ") * (20_000 if i in (60, 61) else 3), "en" if i % 2 else "de", i, i, i) for i in range(62)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, toxicity int, quality_score int, lang_pred int")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(62)], "doc_id bigint, quality int, toxic int")
    for module, name in ((quality, "quality_score"), (toxicity, "toxicity")):
        got = module.with_score(docs, labels)
        assert got.columns == [*docs.columns, f"{name}_"] and got.where(f"{name}_ < 0 or {name}_ > 1 or {name} != doc_id").count() == 0
        by = {r.doc_id: r.predicted for r in module.predictions(docs, labels).collect()}
        assert all(by[i] == (i % 2 if module is quality else 1 - i % 2) for i in (60, 61))
    found = langid.with_language(docs, langid.fit(docs))
    assert found.columns == [*docs.columns, "lang_pred_", "lang_score"] and {r.doc_id: r.lang_pred_ for r in found.collect()}[60] == "de"
    marked = fingerprints.with_fingerprint(docs.withColumn("fingerprint", F.lit(1)))
    assert marked.columns[-1] == "fingerprint_" and len(marked.first().fingerprint_) > 20


def test_groups_of_copies_by_every_way(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    base = " ".join(rng.choice(words) for _ in range(300))
    data = [(i, base) for i in range(40)] + [(100 + i, base.replace(words[i], "zz", 1)) for i in range(8)] + [(200 + i, None) for i in range(5)] + [(300 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(20)] + [(None, base)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    got = []
    for share in (1e-4, 0.05, 1.0):
        monkeypatch.setattr(simhash, "SHARE", share)
        got.append(sorted((-1 if r.doc_id is None else r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(data)
    assert {c for i, _, c in got[0] if i < 100} == {0} and {c for i, _, c in got[0] if 200 <= i < 300} == {200}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


def test_landmarks_are_whole_texts():
    """Texts that differ after LANDMARK_CHARS letters only are told apart where there are no others."""
    rng = random.Random(12)
    start = "".join(rng.choice("abcdefgh") for _ in range(langid.LANDMARK_CHARS + 10))
    ends = {"x": "uvwxyz", "y": "klmnop"}
    tail = lambda g: "".join(rng.choice(ends[g]) for _ in range(3000))
    model = langid.Model([start + tail(g) for g in "xyxyxy"], list("xyxyxy"))
    assert [g for g, _ in model.predict([tail("x"), tail("y"), start + tail("x"), start + tail("y")])] == list("xyxy")


def plain_mine(docs, toxic):
    """The miner over sets of words, all in one place."""
    docs = [d | {w[:n] + "-" for n in toxicity.BEGINNINGS for w in d if len(w) > n} for d in docs]
    in_toxic, in_clean = Counter(t for d, y in zip(docs, toxic) if y for t in d), Counter(t for d, y in zip(docs, toxic) if not y for t in d)
    share = sum(toxic) / len(toxic)
    few = min(toxicity.LEAST_GAIN, max(1, sum(toxic) // 10))
    good = {t: (n, in_clean[t]) for t, n in in_toxic.items() if n >= few and in_clean[t] <= 0.05 * n * ((1 - share) / share)}
    miner = toxicity.Miner(good, few, math.log(toxicity.CHANCE / (len(in_toxic) + len(in_clean))) / math.log(share))
    return miner.cover([d & good.keys() for d, y in zip(docs, toxic) if y and not d & miner.taken])


def test_terms_are_mined_as_in_one_place(spark):
    rng = np.random.default_rng(3)
    plain = [f"plain{'abcdefghijklmnopqrst'[i]}{'xyz'[i % 3] * (i % 4)}" for i in range(20)]
    data = []
    for i in range(400):
        toxic = i % 5 == 0
        rude = list(rng.choice(["zorgish", "zorgling", "quib", "flurbé", "flurbée"], 2)) if toxic and i % 3 else ["rarely", f"only{'abcde'[i % 25 // 5]}"] if toxic else []
        data.append((int(toxic), sorted({*rng.choice(plain, 6).tolist(), *map(str, rude), *(["quib"] if i == 7 else [])})))
    got = toxicity.mine(spark.createDataFrame(data, "toxic int, words array<string>"), len(data), sum(y for y, _ in data))
    assert got and got == plain_mine([set(w) for _, w in data], [y for y, _ in data])


def test_texts_of_the_toxicity_sample_stay_in_tasks(spark):
    word = lambda i: F.translate(F.abs(F.xxhash64("id", i)).cast("string"), "0123456789", "abcdefghij")
    text = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(900)), word), " "), F.when(F.col("id") % 10 == 0, " zorgish").otherwise(""))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), text.alias("text")).cache()
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    assert docs.agg(F.sum(F.length("text"))).first()[0] > 4_000_000
    tracemalloc.start()
    try:
        model = toxicity.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        docs.unpersist()
    assert model.voters.mined == ["zorgish"] and model.score("so zorgish") > 0.5 > model.score("so mild")
    assert peak < 4_000_000


def test_quality_reads_its_sample_a_part_at_a_time(monkeypatch):
    texts = [f"Good line {i}.\n\nANOTHER!!! | {i * i} |" * (1 + i % 7) for i in range(200)]
    whole, sizes = quality.Model(texts, np.arange(200) % 2), []
    read = quality.line_features
    monkeypatch.setattr(quality, "PASS", 500)
    monkeypatch.setattr(quality, "line_features", lambda some: sizes.append(sum(map(len, some))) or read(some))
    parts = quality.Model(texts, np.arange(200) % 2)
    assert max(sizes) <= 500 and (parts.chain.w == whole.chain.w).all() and (parts.curve == whole.curve).all()
