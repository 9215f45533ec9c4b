"""The stored index, dense search and the forward as-of join against plain versions."""

import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from sextant.operators import literal_index, observability, ranking, search_index
from sextant.operators.literal_index import LiteralIndex
from sextant.operators.search_index import SearchIndex, index_of


def texts(seed, n):
    """Frequent and rare words, so that most ranges can't enter a list; every third text is the same."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [("the same text w1 w50" if i % 3 == 0 else " ".join(rng.choices(words, weights, k=rng.randint(0, 40))) if i % 17 else None) for i in range(n)]


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(search_index, "RANGE", 5)
    monkeypatch.setattr(search_index, "FIRST", 1)


def rows(df):
    return sorted((r.query_id, r.rank, r.item_id, round(r.score, 7)) for r in df.collect())


def test_index_equals_scoring_everything(spark, tmp_path, small_ranges):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts(1, 300))], "doc_id long, text string, range long, term string").repartition(3)
    queries = spark.createDataFrame([(0, "w1 w50 w50 the"), (1, "w0"), (2, "unknown"), (3, ""), (4, None), (5, "w59 w58 w3 W2")], "item_id long, text string")
    for analyser, plain in (("words", ranking.bm25), ("words_of_two", ranking.tfidf)):
        index = SearchIndex.build(docs, f"{tmp_path}/{analyser}", analyser)
        search = index.bm25 if analyser == "words" else index.tfidf
        for k in (1, 5, 400):
            assert rows(search(queries, k)) == rows(plain(docs, queries, k))


def test_index_skips_and_reads_no_document(spark, tmp_path, small_ranges):
    source, at = f"{tmp_path}/docs", f"{tmp_path}/index"
    spark.createDataFrame(list(enumerate(texts(2, 400))), "doc_id long, text string").write.parquet(source)
    queries = spark.createDataFrame([(0, "w1 w50 the same"), (1, "w59 w40")], "item_id long, text string")
    index = SearchIndex.build(spark.read.parquet(source), at)
    want = rows(ranking.bm25(spark.read.parquet(source), queries, 3))
    shutil.rmtree(source)
    scored, postings = [], SearchIndex._postings

    def counted(self, blocks, *columns):
        scored.append(blocks.count())
        return postings(self, blocks, *columns)

    SearchIndex._postings = counted
    try:
        assert rows(SearchIndex.open(spark, at).bm25(queries, 3)) == want
    finally:
        SearchIndex._postings = postings
    terms = spark.createDataFrame([(t,) for t in "w1 w50 the same w59 w40".split()], "term string")
    assert 0 < sum(scored) < index._blocks().join(terms, "term").count()


def test_append_delete_and_versions(spark, tmp_path, small_ranges):
    every = list(enumerate(texts(3, 120)))
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    queries = spark.createDataFrame([(0, "w1 w2 w50"), (1, "the w7")], "item_id long, text string")
    first = SearchIndex.build(frame(every[:50]), f"{tmp_path}/i", "words_of_two")
    second = first.append(frame(every[50:]))
    third = second.delete(frame(every).where("doc_id % 4 = 1").select(F.col("doc_id").alias("item_id"))).delete(spark.createDataFrame([(2,), (None,), (999,)], "item_id long"))
    left = [(i, t) for i, t in every if i % 4 != 1 and i != 2]
    for index, some in ((first, every[:50]), (second, every), (third, left)):
        assert rows(index.tfidf(queries, 4)) == rows(ranking.tfidf(frame(some), queries, 4))
        assert rows(index.bm25(queries, 4)) == rows(SearchIndex.build(frame(some), f"{tmp_path}/x{len(some)}", "words_of_two").bm25(queries, 4))
    # A job that dies before its manifest is whole leaves the last version.
    (tmp_path / "i/manifest/00000099").mkdir()
    last = SearchIndex.open(spark, f"{tmp_path}/i")
    assert last.state == third.state
    last.vacuum()
    assert rows(SearchIndex.open(spark, f"{tmp_path}/i").tfidf(queries, 4)) == rows(ranking.tfidf(frame(left), queries, 4))


def test_rows_of_one_item_are_one_text(spark, tmp_path, monkeypatch):
    queries = spark.createDataFrame([(0, "a b")], "item_id long, text string")
    several = spark.createDataFrame([(1, "a a b"), (1, "a c"), (2, "b"), (3, "c c")], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a a b a c"), (2, "b"), (3, "c c")], "doc_id long, text string")
    want = rows(ranking.bm25(one, queries, 5))
    for few in (1000, 0):
        monkeypatch.setattr(search_index, "FEW", few)
        assert rows(SearchIndex.build(several, f"{tmp_path}/{few}").bm25(queries, 5)) == want


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "w1")], "item_id long, text string")
    index = SearchIndex.build(none, f"{tmp_path}/i")
    assert index.bm25(queries, 3).collect() == [] and index.tfidf(queries, 3).collect() == []
    assert index.append(spark.createDataFrame([(1, "w1"), (None, "w1")], "doc_id long, text string")).bm25(queries.limit(0), 3).collect() == []


def test_index_of_a_table_is_built_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    read = lambda: spark.read.parquet(f"{tmp_path}/d")
    assert index_of(read(), "words") is index_of(read(), "words")
    assert index_of(read(), "words") is not index_of(read().where("doc_id = 1"), "words")
    before = index_of(read(), "words")
    spark.createDataFrame([(2, "c")], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/d")
    assert index_of(read(), "words") is not before


def test_dense_with_odd_vectors(spark):
    rng = random.Random(4)
    given = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None), (62, [1.0]), (63, [1.0, None, 0.0])]
    given += [(70 + i, [1.0, 1.0, 0.0]) for i in range(9)]
    asked = [("a", [1.0, 0.2, -1.0]), ("z", [0.0, 0.0, 0.0]), ("n", None), ("s", [2.0, 2.0, 0.0]), ("w", [1.0])]

    def score(a, b):
        if not a or not b or len(a) != len(b) or None in b or not any(a) or not any(b):
            return None
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    items, queries = spark.createDataFrame(given, "item_id long, vector array<double>").repartition(5), spark.createDataFrame(asked, "query_id string, vector array<double>")
    for k in (4, 100):
        got = {(r.query_id, r.rank): (r.item_id, r.score) for r in ranking.dense(items, queries, k, block=2).collect()}
        for name, q in asked:
            best = sorted(((i, score(q, v)) for i, v in given), key=lambda x: (x[1] is None, -round(x[1] or 0, 8), x[0]))[:k]
            for rank, (i, s) in enumerate(best, start=1):
                assert got[name, rank][0] == i and (got[name, rank][1] is None if s is None else abs(got[name, rank][1] - s) < 1e-9)
    assert ranking.dense(items, queries.limit(0), 3).count() == ranking.dense(items.limit(0), queries, 3).count() == 0


def test_next_matching_on_one_key(spark):
    e = spark.range(30_000).select(F.lit(1).alias("k"), F.floor(F.col("id") / 3).alias("t"), "id")
    found = observability.next_matching(e, "k", "t", F.col("id") % 3 == 0, F.col("id") % 3 > 0, "id")
    assert found.where(F.col("matched") == F.col("id") + 4).count() == 9_999 and found.where("matched is null").count() == 1


def test_literal_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(literal_index, "RANGE", 20)
    rng = random.Random(6)
    text = lambda: "\n".join("".join(rng.choice("abAB éÉΣσς.中x") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 8)))
    rows = [(i, text(), 1) for i in range(80)] + [(200 + i, "one common line ab", 1) for i in range(60)] + [(300, None, 1), (301, "", 1), (None, "ab", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int").repartition(3)
    index = LiteralIndex.build(docs, f"{tmp_path}/l")
    words = ["ab", "a", "common", "line ab", "AB", "É", "é", "σ", "bab", "中", "not there", "ab\n", ""]
    got = {(r.term, r.item_id, r.line_no, r.line) for r in index.search(spark.createDataFrame([(w,) for w in words], "term string")).collect()}

    def holds(line, w):
        return w != "" and (w in line if w != w.lower() else w in line.lower())

    assert got == {(w, i, n, line) for w in words for i, t, _ in rows if t is not None and i is not None for n, line in enumerate(t.split("\n"), start=1) if holds(line, w)}
    for monkeyed in (1000, 1):
        monkeypatch.setattr(literal_index, "FEW", monkeyed)
        some = ["common", "ab", "BA"]
        assert sorted(map(tuple, index.grep(some, per_item=2).collect())) == sorted(map(tuple, ranking.grep(docs.where("doc_id is not null"), some, per_doc=2).collect()))
    # A rare text meets few lines, and no other is compared.
    assert index.candidates(spark.createDataFrame([("common",)], "term string")).count() == 60
    assert LiteralIndex.build(docs.limit(0), f"{tmp_path}/e").grep(["ab"]).collect() == []


def test_scorers_leave_texts_in_their_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([*enumerate(texts(7, 200)), (3, "w50 more"), (None, "w1")], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["w1 w50 w50 the", "w0", "unknown", "", None, "w59 w58 w3 W2", "w1 the"])], "item_id long, text string")
    whole = {i: [t or ""] for i, t in enumerate(texts(7, 200))}
    whole[3].append("w50 more")
    words = {i: " ".join(t).lower().split() for i, t in whole.items()}
    df = {t: sum(t in ws for ws in words.values()) for t in {t for ws in words.values() for t in ws}}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    idf = {t: math.log((1 + n) / (1 + x)) + 1 for t, x in df.items()}
    length = lambda ws: math.sqrt(sum((ws.count(t) * idf.get(t, 0)) ** 2 for t in set(ws)))

    def bm25(q, ws):
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for t in q if t in ws)

    def tfidf(q, ws):
        return sum(q.count(t) * ws.count(t) * idf[t] ** 2 for t in set(q) if t in ws) / ((length(q) * length(ws)) or 1)

    written, stored = [], ranking.stored
    monkeypatch.setattr(ranking, "stored", lambda df, name: written.append(stored(df, name)) or written[-1])
    for few, several, cells in ((200_000, 256, 1_000_000), (20, 2, 100), (0, 2, 1)):
        monkeypatch.setattr(ranking, "BROADCAST_TERMS", few)
        monkeypatch.setattr(ranking, "QUERIES", several)
        monkeypatch.setattr(ranking, "CELLS", cells)
        for found, score in ((ranking.bm25, bm25), (ranking.tfidf, tfidf)):
            want = []
            for q in queries.collect():
                scores = {i: score((q.text or "").lower().split(), ws) for i, ws in words.items()}
                best = sorted((i for i in scores if scores[i] > 0), key=lambda i: (-round(scores[i], 8), i))[:4]
                want += [(q.item_id, rank, i, round(scores[i], 7)) for rank, i in enumerate(best, start=1)]
            del written[:]
            assert rows(found(docs, queries, 4)) == sorted(want)
            # What is written is the result, and one row for each term of the whole table.
            assert written[-1].count() == len(want) and len(written) <= 2 and (len(written) == 1 or found is ranking.tfidf)


def test_dense_multiplies_a_few_rows_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    queries, items = rng.normal(size=(2000, 8)), rng.normal(size=(10_000, 8))
    batch = pa.RecordBatch.from_pydict({"item_id": pa.array(range(10_000)), "vector": pa.array(items.tolist())})
    best = ranking._block_best(list(range(2000)), queries, 3)
    tracemalloc.start()
    got = next(iter(best(iter([batch])))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The whole product has 160 MB, several times over.
    assert peak < 150_000_000
    cosine = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (items / np.linalg.norm(items, axis=1)[:, None]).T
    assert (got["item_id"].to_numpy().reshape(2000, 3) == np.argsort(-cosine, axis=1)[:, :3]).all()


def test_literal_index_is_small_and_counts_for_all_queries(spark, tmp_path):
    rng = random.Random(8)
    syllables = ["tion", "the", "ou", "Re", "and", "sh"]
    line = lambda: " ".join("".join(rng.choices(syllables, k=3)) for _ in range(30))
    rows = [(i, "\n".join(line() for _ in range(4))) for i in range(500)]
    index = LiteralIndex.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), f"{tmp_path}/l")
    # A number for each run and block, not for each run and line.
    assert index.blocks.select(F.sum(F.size("numbers"))).first()[0] < 4_000
    asked = [(1, "tionthe"), (1, "sh"), (2, "the ou"), (2, "Re"), (3, "nothing of it"), (4, None), (5, "")]
    got = {(r.query_id, r.item_id): sorted(r.lines) for r in index.hits(spark.createDataFrame(asked, "query_id long, term string")).collect()}
    holds = lambda x, t: bool(t) and (t in x if t != t.lower() else t in x.lower())
    want = {}
    for q in {q for q, _ in asked}:
        for i, text in rows:
            if found := [n for n, x in enumerate(text.split("\n"), start=1) if any(holds(x, t) for p, t in asked if p == q)]:
                want[q, i] = found
    assert got == want
