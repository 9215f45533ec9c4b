"""The pipeline against its stages applied by brute force to what each predecessor kept."""

import corpus_pipeline
import sentencepiece

from sextant.llm import decontaminate, pieces, quality, simhash, toxicity
from tests.llm.test_operators import brute_contamination, brute_similarity, brute_simhash

DIR = "/root/testdata/sf0.001"


def test_stages_keep_and_drop(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "decontamination", "pieces"]
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, DIR).cache()
        kept = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and kept <= set(rows)
        if name == "near_copies":
            fp = {i: brute_simhash(t) for i, t in rows.items()}
            linked = lambda i, j: (fp[i] ^ fp[j]).bit_count() <= simhash.RADIUS or brute_similarity(rows[i] or "", rows[j] or "") >= simhash.LIKE
            for i in rows:
                near = [j for j in rows if j != i and linked(i, j)]
                assert near or i in kept
                assert i not in kept or not any(j in kept for j in near)
            assert len(kept) < len(rows)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            bad = {r[0] for r in brute_contamination(list(rows.items()), items) if r[5]}
            assert kept == set(rows) - bad
    last = corpus_pipeline.STAGES[4][1](spark, docs, DIR).collect()
    assert {r.doc_id for r in last} == kept and all(r.exact for r in last)
    assert decontaminate.WINDOW == 13


def test_run_ends_with_the_ids(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert all(r.ids == model.encode(texts[r.doc_id] or "") for r in corpus_pipeline.run(spark, DIR).collect() if "\u2581" not in (texts[r.doc_id] or ""))


def staged(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    return docs


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_run_equals_stages(spark):
    assert rows_of(corpus_pipeline.run(spark, DIR)) == rows_of(staged(spark, DIR))


def test_classifying_stages_keep_what_the_operators_accept(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    for stage, module, accepted in ((corpus_pipeline.drop_toxic, toxicity, 0), (corpus_pipeline.drop_low_quality, quality, 1)):
        model = module.fit(docs, labels)
        score = (lambda t: model.score(t)) if module is toxicity else (lambda t: float(model.scores([t])[0]))
        want = {r.doc_id for r in docs.collect() if int(score(r.text or "") >= module.THRESHOLD) == accepted}
        assert {r.doc_id for r in stage(spark, docs, DIR).collect()} == want


def test_odd_tables_go_through(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, and a table without rows."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    some = docs.orderBy("doc_id").limit(60)
    odd = spark.createDataFrame([(None, "a text without an id", "en", "s", 1), (9001, None, None, None, None), (9002, "", "en", None, 0), (9003, " \n ", "en", "s", 3)], docs.schema)
    for name, table in (("odd", some.unionByName(some.limit(5)).unionByName(odd)), ("none", docs.limit(0))):
        path = str(tmp_path / name)
        table.write.parquet(f"{path}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{DIR}/{other}.parquet").write.parquet(f"{path}/{other}.parquet")
        got = rows_of(corpus_pipeline.run(spark, path))
        assert got == rows_of(staged(spark, path)) and (len(got) > 0) == (name == "odd") and len(got) == len(set(got))
