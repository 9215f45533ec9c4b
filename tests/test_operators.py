"""Reference operators on hand-built rows: ties, nulls, empty lists, boundaries."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import answers, chunking, evaluation, fusion, observability, ranking, sessions, understanding
from sextant.sources import files
from sextant.streaming import metrics


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_text(spark):
    assert one(spark, " A　 b\n", T.normalize(F.col("x"))) == "a b" and one(spark, None, T.normalize(F.col("x"))) == ""
    assert one(spark, "A, b。 C!", T.squeeze(F.col("x"))) == "abc"
    assert one(spark, "Foo_bar foo 召回率 x the", T.terms(F.col("x"), ["the"])) == ["foo_bar", "foo", "召回率"]
    assert one(spark, "src/a_b/C-d.py", T.path_tokens(F.col("x"))) == ["src", "a", "b", "c", "d", "py"]
    assert one(spark, "a/b.py", T.language_of(F.col("x"))) == "python" and one(spark, "LICENSE", T.language_of(F.col("x"))) == "text"
    assert one(spark, "aaaa", T.occurrences(F.col("x"), F.lit("aa"))) == 2
    assert one(spark, "bad", T.with_default(F.col("x"), "int", 3, 5)) == 5
    assert one(spark, "2024-01-02T03:04:05.6Z", T.iso_seconds(F.col("x"))) == "2024-01-02T03:04:05" and one(spark, "soon", T.iso_seconds(F.col("x"))) == "soon"
    assert one(spark, "a b", T.identifier(F.col("x"), "t")) == "t"


def test_chunks(spark):
    kind = lambda t: one(spark, t, chunking.chunk_type(F.col("x")))
    assert [kind(t) for t in ("```x```\n- a", "- a\n| b |", "| a | b |", "the flow of", "plain")] == ["code", "list", "table", "flow", "paragraph"]
    assert one(spark, "# T\n## S\nx", chunking.title(F.col("x"), F.lit("f"))) == "T" and one(spark, "x", chunking.title(F.col("x"), F.lit("f"))) == "f"
    assert one(spark, "# T\n## S\nx", chunking.section(F.col("x"), F.lit("f"))) == "S"
    parts = chunking.split_text("a" * 700 + "\n\n" + "b " * 300, 520, 80)
    assert all(len(p) <= 520 for p in parts) and "".join(parts).count("a") >= 700
    assert chunking.split_text("", 10, 2) == []
    lines = "\n".join(map(str, range(1, 81)))
    rows = chunking.children(spark.createDataFrame([(1, lines)], "k int, content string"), "k").orderBy("child_no").collect()
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 36), (29, 64), (57, 80)]
    h = one(spark, "a\nb\nc\nhit\nc\nd\ne", chunking.highlight(F.col("x"), F.array(F.lit("HIT"), F.lit("c x"), F.lit("a")), 1, 3, F.lit(10)))
    assert [(x.line_no, x.is_hit) for x in h.lines] == [(12, False), (13, True), (14, False)] and h.hits == [13]
    assert h.text == "...\n     12: c\n>>   13: hit\n     14: c\n..."
    none = one(spark, "\n\nfirst\n", chunking.highlight(F.col("x"), F.array(F.lit("zz"))))
    assert none.hits == [3] and [x.line_no for x in none.lines] == [1, 2, 3]
    empty = one(spark, "", chunking.highlight(F.col("x"), F.array(F.lit("zz"))))
    assert (empty.text, empty.lines, empty.hits) == ("", [], [])


def test_code_parents(spark):
    source = "import x\n\nclass A(B):\n    def f(self, a: int) -> str:\n        return a\n\nasync def g():\n    pass\n"
    got = chunking.code_parents(spark.createDataFrame([("p/a.py", source), ("b.py", "def ("), ("c.go", "x")], "path string, content string")).collect()
    assert [(r.path, r.chunk_type, r.symbol_name, r.signature, r.start_line, r.end_line) for r in got if r.path == "p/a.py"] == [
        ("p/a.py", "class", "A", "class A(B)", 3, 5), ("p/a.py", "function", "f", "def f(self, a: int) -> str", 4, 5), ("p/a.py", "function", "g", "async def g()", 7, 8), ("p/a.py", "file", "", "", 1, 8)]
    assert {r.chunk_type for r in got if r.path != "p/a.py"} == {"file"} and len({r.parent_id for r in got}) == len(got)


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, item_id int, rank int, score double")


def test_rank_fusion_ignores_the_scale_of_weights(spark):
    a, b = ranked(spark, [(1, 1, 1, 9.0), (1, 2, 2, 8.0)]), ranked(spark, [(1, 2, 1, 1.0), (1, 3, 2, 0.5)])
    x, y = ([tuple(r) for r in ranking.fuse([(a, w), (b, v)], 3).select("item_id", "rank", F.round("score", 9)).orderBy("rank").collect()] for w, v in ((0.6, 0.4), (6, 4)))
    assert x == y and [r[0] for r in x] == [2, 1, 3]


def test_roll_up_and_boosts(spark):
    c = spark.createDataFrame([(1, "p", "c1", 4.0, 1.0), (1, "p", "c2", 2.0, 0.0), (1, "p", "c3", 1.0, 0.5)], "query_id int, parent_id string, child_id string, score double, pattern double")
    r = ranking.roll_up(c).first()
    assert r.best_child == "c1" and r.hits == 3 and abs(r.score - (4 + 0.25 * 3 + 0.9 + 0.35 * 0.75)) < 1e-9
    assert [round(spark.range(1).select(ranking.path_boost(F.lit(n), 2.0).alias("b")).first().b, 6) for n in (0, 1, 2, 99)] == [0, 2.0, 2.5, 5.0]


def hits_of(spark, rows):
    return spark.createDataFrame(rows, "query_id int, source string, item_id int, path string, section string, rank int, score double, grade string")


def test_quota_hits_come_before_what_fills_up(spark):
    rows = [(1, s, 10 * k + i, f"{s}{i}", "", i, 1.0 - i / 10, "high") for k, (s, n) in enumerate((("wiki_a", 4), ("code", 1))) for i in range(1, n + 1)] + [(1, "wiki_a", 9, "wiki_a1", "", 5, 0.1, "high")]
    plan = fusion.Plan({"wiki": 2.0, "code": 0.1, "case": 1.0}, {"wiki": 2, "code": 2, "case": 1}, 5)
    got = fusion.merge(hits_of(spark, rows), plan).orderBy("fusion_rank").collect()
    assert [r.kind for r in got] == ["wiki", "wiki", "code", "wiki", "wiki"] and [r.fusion_rank for r in got] == [1, 2, 3, 4, 5] and 9 not in {r.item_id for r in got}
    # A kind without a quota of its own may fill the whole list.
    own = fusion.merge(hits_of(spark, [(1, "notes", i, f"n{i}", "", i, 1.0, "low") for i in range(1, 5)]), fusion.Plan(quotas={}, final_top_k=3)).collect()
    assert [r.kind for r in own] == ["notes"] * 3
    q = spark.range(1).select(fusion.distinct_queries(F.array(F.lit("A  b"), F.lit("a b"), F.lit(" "), F.lit("c"))).alias("q")).first().q
    assert q == ["A b", "c"]


def test_grades_and_intents_bias_the_fused_score(spark):
    rows = [(1, s, i, s, "", 2, 1.0, g) for i, (s, g) in enumerate((("wiki", "high"), ("code", "medium"), ("case", "low"), ("code2", "insufficient"), ("x", "disabled"), ("", None)))]
    score = lambda plan: {r.path: r.fusion_score for r in fusion.weigh(hits_of(spark, rows), plan).collect()}
    plain = score(fusion.Plan())
    assert plain == pytest.approx({"wiki": 1.41, "code": 1.21, "case": 0.66, "code2": 0.96, "x": 0.86, "": 1.06})
    place = fusion.Plan().for_intent("code_location")
    assert (place.weights, place.quotas) == ({"wiki": 0.8, "code": 1.35, "case": 0.6}, {"wiki": 2, "code": 5, "case": 1})
    assert score(place) == pytest.approx({"wiki": 1.11, "code": 1.81, "case": 0.66, "code2": 1.56, "x": 0.86, "": 1.06})
    first = fusion.Plan(quotas={"wiki": 1, "code": 4}).for_intent("wiki_first")
    assert (first.weights["wiki"], first.weights["code"], first.quotas["wiki"]) == (1.15, 0.9, 4)
    assert fusion.Plan(quotas={"wiki": 0, "code": 1}).for_intent("code_location").quotas == {"wiki": 1, "code": 5}


def test_a_score_depends_on_no_other_query(spark):
    docs = spark.createDataFrame([(1, "apple pear plum plum"), (2, "apple " + "filler " * 50), (3, "pear x"), (4, None)], "doc_id int, text string")
    one_ = spark.createDataFrame([(1, "apple apple zz")], "item_id int, text string")
    two = spark.createDataFrame([(1, "apple apple zz"), (2, "filler plum")], "item_id int, text string")
    for search in (ranking.tfidf, ranking.bm25):
        pick = lambda r: sorted((x.item_id, x.rank, round(x.score, 9)) for x in r.where("query_id = 1").collect())
        assert pick(search(docs, one_, 5)) == pick(search(docs, two, 5)) and [x[0] for x in pick(search(docs, one_, 5))] == [1, 2]
    # Against a plain version: all terms of a document are in its norm.
    import math

    words = {1: ["apple", "pear", "plum", "plum"], 2: ["apple"] + ["filler"] * 50, 3: ["pear"], 4: []}
    df = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    idf = {t: math.log(5 / (1 + n)) + 1 for t, n in df.items()}
    norm = lambda w: math.sqrt(sum((w.count(t) * idf[t]) ** 2 for t in set(w)))
    got = {x.item_id: x.score for x in ranking.tfidf(docs, one_, 5).collect()}
    assert got == pytest.approx({i: words[i].count("apple") * idf["apple"] / norm(words[i]) for i in (1, 2)})
    assert ranking.bm25(docs.limit(0), one_, 5).count() == ranking.tfidf(docs.limit(0), one_, 5).count() == 0


def test_strategies_of_child_scores(spark):
    rows = [(1, 1.0, 2.0, 1, 3, 1, 0.5, 0.25), (2, 0.0, 0.0, None, None, 2, 0.1, 0.0), (3, 0.0, 0.0, 1, 1, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, lexical double, pattern double, bm25_rank int, tfidf_rank int, fused_rank int, path_boost double, line_boost double")
    score = lambda s: {r.id: r.score for r in ranking.score_children(df, s).collect()}
    # The worse of two ranks counts, and without one of them nothing does.
    assert score("no_rg") == pytest.approx({1: 1 + 4.2 + 14 + 3.2, 3: 4.2 + 28})
    assert score("rg_first") == pytest.approx({1: 23.15, 3: 32.2}) and score("rg_only") == pytest.approx({1: 0.7 + 0.3 + 0.7 + 1.6})
    with pytest.raises(ValueError, match="unknown strategy"):
        ranking.score_children(df, "other")
    c = spark.createDataFrame([(1, "p", "c1", 4.0, 1.0, ["ab", "c"], 0.5), (1, "p", "c2", 2.0, 0.0, ["abc", "c"], 0.7)], "query_id int, parent_id string, child_id string, score double, pattern double, matched array<string>, path_boost double")
    r = ranking.roll_up(c).first()
    assert r.matched == ["abc", "ab", "c"] and r.path_boost == 0.7 and r.best_pattern == 1.0


def test_retry_asks_other_queries(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, text string")
    again = q.withColumn("text", F.concat("text", F.lit("2")))
    scores = {"a": [7.0, 6.0], "b": [1.0], "b2": [4.0, 3.0], "c": [], "c2": []}

    def search(qs, k):
        rows = [(r.query_id, i, i, s) for r in qs.collect() for i, s in enumerate(scores[r.text][:k], 1)]
        return spark.createDataFrame(rows, "query_id int, item_id int, rank int, score double")

    got = sorted((r.query_id, r.score) for r in ranking.retry(search, q, 3, again=again).collect())
    assert got == [(1, 6.0), (1, 7.0), (2, 3.0), (2, 4.0)]
    assert sorted(r.score for r in ranking.retry(search, q.where("query_id = 2"), 3, again=q.limit(0)).collect()) == [1.0]


def test_issue_sections(spark):
    read = lambda x: tuple(one(spark, x, answers.issue_sections(F.col("x"))))
    assert read("根因：缓存失效\n风险\n- a\n2. b\na\n修复建议:\n1) c\n验证步骤 d\n\n* e") == ("缓存失效", ["a", "b"], ["c"], ["d", "e"])
    assert read("first\nsecond\r\n third \nfourth") == ("first", ["second", "third"], ["second", "third", "fourth"], ["third", "fourth"])
    assert read("lead\n结论：one\n结论：two\nmore\nmore\nlast") == ("one", ["more", "last"], ["more", "last"], ["more", "last"])
    assert read("## 根因\nx\n### y\n-  z") == ("x", ["z"], ["z"], [])
    assert read("风险\n- a\n- b\n- c\n- d") == ("", ["a", "b", "c"], [], []) and read(None) == read(" \n#") == ("", [], [], [])
    long = "风险\n" + "\n".join(f"- {i}" for i in range(20_000)) + "\n根因 x"
    assert read(long) == ("x", ["0", "1", "2"], [], [])


def test_fact_coverage_needs_words_on_both_sides(spark):
    groups = F.array(F.array(F.lit("A b"), F.lit("z")), F.array(F.lit("q")), F.array(F.lit(" ")))
    assert one(spark, "x a-B.", evaluation.fact_coverage(F.col("x"), groups)) == 0.5
    assert one(spark, "x", evaluation.fact_coverage(F.col("x"), F.array().cast("array<array<string>>"))) == 1.0
    assert one(spark, "x", evaluation.forbidden_pass(F.col("x"), F.array(F.lit("?!")))) == 1.0


def test_suppression_starts_anew_with_each_emitted_alert(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", at(m)) for m in (0, 20, 30, 31, 50, 61, 62, 200)] + [("b", at(5))]
    c = spark.createDataFrame(rows, "alert_type string, ts timestamp")
    got = sorted((r.alert_type, int((r.ts - at(0)).total_seconds() // 60)) for r in observability.suppress(c, 30).collect())
    assert got == [("a", 0), ("a", 31), ("a", 62), ("a", 200), ("b", 5)]


def test_streams(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    minute = lambda t: int((t - at(0)).total_seconds() // 60)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    # Files are read one by one, the oldest first. The watermark moves between them: after the second one it is at
    # 90 - 10 = 80 minutes, so that 1 comes too late in the third.
    for i, part in enumerate(([0, 10, 31, 45], [62, 63, 62, 90], [1, 300])):
        spark.createDataFrame([(m, at(m), 1, "view", float(m)) for m in part], schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (f,) = (tmp_path / f"part{i}").glob("part-*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        f.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    source = lambda: metrics.read_events(spark, str(tmp_path / "in"))
    emitted = metrics.run_to_end(metrics.suppressed(source(), 30), "emitted").collect()
    assert sorted(minute(r.ts) for r in emitted) == [0, 31, 62, 300]
    # The window from 300 on is still open at the end; the one from 0 has lost the late event.
    windows = {minute(r.start): (r.n, r.mean) for r in metrics.run_to_end(metrics.windowed(source(), "30 minutes"), "windows").collect()}
    assert windows == {0: (2, 5.0), 30: (2, 38.0), 60: (3, pytest.approx(187 / 3)), 90: (1, 90.0)}
    slid = {minute(r.start): r.n for r in metrics.run_to_end(metrics.windowed(source(), "30 minutes", "15 minutes"), "slid").collect()}
    assert slid == {-15: 2, 0: 2, 15: 1, 30: 2, 45: 4, 60: 3, 75: 1, 90: 1}
    spans = sorted((minute(r.start), minute(r.end), r.n) for r in metrics.run_to_end(metrics.user_sessions(source()), "sessions").collect())
    assert spans == [(0, 120, 8)]
    once = sorted(r.event_id for r in metrics.run_to_end(metrics.distinct_events(source(), "1 day"), "distinct_events").collect())
    assert once == [0, 1, 10, 31, 45, 62, 63, 90, 300]


def test_log_lines(spark):
    lines = spark.createDataFrame([('2024-01-01 00:00:00 | INFO | llm.debug_request | {"node": "a", "attempt": 1}',), ("x | INFO | e | {broken \"node\": \"b\"",), ("nothing",)], "value string")
    got = observability.parse_log(lines, ["node"]).select("event", "node").collect()
    assert [tuple(r) for r in got] == [("llm.debug_request", "a"), ("e", "b")]
    assert one(spark, "llm.debug_request", observability.response_event(F.col("x"))) == "llm.debug_response"


def test_metrics_count_misses(spark):
    cases = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "query_id int, gold int")
    hits = ranked(spark, [(1, 5, 2, 1.0), (1, 6, 1, 1.0), (2, 5, 1, 1.0)])
    r = evaluation.overall(evaluation.per_case(cases, hits, F.col("item_id") == F.col("gold"))).first()
    assert (r.cases, round(r.recall_at_1, 4), round(r.recall_at_3, 4), r.mrr) == (3, 0.3333, 0.6667, 0.5)
    w = spark.range(1).select(evaluation.weighted([(F.lit(1.0), 3), (F.lit(None).cast("double"), 9), (F.lit(0.0), 1)]).alias("w")).first().w
    assert w == 0.75


def test_sessions(spark):
    s = spark.createDataFrame([("a", 1, 5, "x"), ("b", 2, 2, "y")], "session_id string, created_at int, updated_at int, title string")
    n = spark.createDataFrame([("a", 9, 9, "new"), ("c", 3, 3, "z")], s.schema)
    assert sorted(map(tuple, sessions.upsert(s, n).collect())) == [("a", 1, 9, "new"), ("b", 2, 2, "y"), ("c", 3, 3, "z")]


def test_understanding(spark):
    p = understanding.Profile(domain_words=("bid", "recall"), modules=(understanding.Module("bid", 1, ("bid",)), understanding.Module("rank", 2, ("rank", "recall"), (), ("RankService",))))
    m = lambda t: one(spark, t, understanding.module(F.col("x"), p))
    assert [m(t) for t in ("bid and rank", "rankservice bid", "rank recall bid", "none")] == ["bid", "rank", "rank", "general"]
    scope = lambda t, **kw: understanding.gate(F.col("x"), p, **kw)
    route = lambda t: one(spark, t, understanding.intent(F.col("x"), p, scope(t)))
    assert [route(t) for t in ("hello", "bid recall error", "write code for bid recall", "bid recall rate", "bid 告警", "how to fix a bid drop", "how to fix a bid drop 503")] == ["out_of_scope", "issue_analysis", "code_generation", "knowledge_qa", "issue_analysis", "knowledge_qa", "issue_analysis"]
    score = lambda t, **kw: tuple(one(spark, t, scope(t, **kw)))
    # One domain word lifts to a floor, and so does a code hint; history adds; off-topic and short texts lose without either.
    assert score("one bid") == (0.62, True, "scored") and score("see Foo.py now") == (0.58, True, "scored") and score("bid and recall and f(x)")[0] == pytest.approx(0.66, abs=0.05)
    assert score("one bid", from_history=F.lit(True))[0] == pytest.approx(0.8) and score("the weather of bid") == (0.62, True, "scored")
    assert score("the weather is fine", from_history=F.lit(True)) == (0.0, False, "offtopic") and score("abc", from_history=F.lit(True)) == (0.0, False, "short_non_domain")
    assert score("write code please", has_module=F.lit(True)) == (0.58, True, "scored") and score(None) == (0.0, False, "small_talk") and score("哈哈！")[2] == "small_talk"
    kind = lambda t: one(spark, t, understanding.question_type(F.col("x")))
    assert [kind(t) for t in ("how to bid", "how to go", "有哪些 阶段", "list which", None)] == ["formula", "reason", "list", "general", "general"]


def chat_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, kind string, intent string, text string, module string, related array<string>")


def test_topics_carry_over(spark):
    """The scripted conversations: a short question for code keeps the topic, an off-topic one finds nothing, a question over two
    modules keeps the second one, a general question for a method is no incident."""
    p = understanding.Profile(domain_words=("出价", "pcvr", "召回"), off_topic=("天气",), trouble=("下降", "排查"), modules=(understanding.Module("bid-optimizer", 1, ("出价", "target_cpa"), hint="bids"), understanding.Module("rate-prediction", 2, ("pctr", "pcvr")), understanding.Module("ad-recall", 3, ("召回",))), default_module="main", places=("代码在哪",))
    rows = [(1, 0, "user", None, None, "target_cpa 的出价公式是什么", None, None), (1, 1, "assistant", "knowledge_qa", "knowledge_qa", "a", "bid-optimizer", ["rate-prediction"]), (1, 2, "user", None, None, "代码在哪里", None, None)]
    rows += [(2, 0, "user", None, None, "今天天气怎么样", None, None), (2, 1, "assistant", "out_of_scope", "out_of_scope", "a", None, None), (2, 2, "user", None, None, "召回 这个", None, None)]
    rows += [(3, 0, "assistant", "issue_analysis", "issue_analysis", "a", "ad-recall", None), (3, 1, "assistant", "knowledge_qa", "knowledge_qa", "b", "bid-optimizer", None), (3, 2, "user", None, None, "它呢", None, None), (3, 3, "user", None, None, "pcvr 与出价", None, None)]
    got = {(r.conv_id, r.turn): r for r in understanding.carry_over(chat_of(spark, rows), p).collect()}
    assert (got[1, 0].module_name, got[1, 0].topic_source) == ("bid-optimizer", "current_query")
    assert (got[1, 2].question, got[1, 2].module_name, got[1, 2].module_hint, got[1, 2].related_modules) == ("target_cpa 的出价公式是什么，对应的代码在哪里", "bid-optimizer", "bids", ["rate-prediction"])
    assert (got[2, 2].module_name, got[2, 2].topic_source) == ("ad-recall", "current_query") and got[2, 0].module_name == "main"
    # An analysed issue comes before a later answer.
    assert (got[3, 2].module_name, got[3, 2].topic_source) == ("ad-recall", "history_memory")
    assert (got[3, 3].module_name, got[3, 3].related_modules) == ("bid-optimizer", ["rate-prediction"])
    route = lambda t: one(spark, t, understanding.intent(F.col("x"), p, understanding.gate(F.col("x"), p)))
    assert route("今天天气怎么样") == "out_of_scope" and route("召回队列下降怎么排查") == "knowledge_qa" and route("召回队列 10:30 下降怎么排查") == "issue_analysis"
    out = evaluation.regressions(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], "case_id string, turn int, kind string"), {"a": (F.col("n_turns") == 2) & (F.col("t2.kind") == "y"), "b": F.col("t2.kind") == "y", "c": F.lit(True) & (F.col("n_turns") > 0)})
    assert {r.case_id: r.passed for r in out.collect()} == {"a": True, "b": False, "c": False}


def test_queries_of_a_question(spark):
    p = understanding.Profile(modules=(understanding.Module("bid", 1, ("bid",), ("price", "offer", "third")),), synonyms={"rank": ("sort",)}, abbreviations={"cpa": "cost"}, symbol_aliases={"floor": ("apply_floor",)}, templates=(understanding.Template(("t1", "t2"), ("how",), ("floor", "roof")),), code_words=(), metric=("metric",), places=("where",))
    base = lambda t, route: one(spark, t, understanding.expand(understanding.base_queries(F.col("x"), F.lit(route), F.lit("bid"), F.array(F.lit("other")), p), F.col("x"), p))
    assert base("how is the floor metric  CPA", "knowledge_qa") == ["how is the floor metric CPA", "apply_floor", "t1", "t2", "price", "offer", "other", "cost"]
    assert base("sort it", "code_generation") == ["sort it", "other", "bid 业务说明", "bid 设计背景 业务口径", "rank", "sort"]
    assert base("a pipeline", "issue_analysis") == ["a pipeline", "bid 异常日志", "bid 排查案例", "bid 联调排障", "price", "offer", "third", "other"]
    again = one(spark, "q", understanding.retry_queries(F.array(F.lit("q"), F.lit("Q ")), F.col("x"), F.lit("bid"), understanding.RETRY_CODE))
    assert again == ["q", "bid 实现 入口 函数", "bid 关键参数 校验", "q 代码位置 文件路径"]
    assert one(spark, "m", understanding.code_paths(F.col("x"), p)) == ["services/default/m/handler.py", "tests/default/m/test_handler.py"]
    skills = spark.createDataFrame([("b", "ctr", None, 1, True), ("a", None, "查一下.*指标", 0, True), ("off", "x", None, -1, False)], "skill string, keyword string, pattern string, ord int, enabled boolean")
    texts = spark.createDataFrame([("the CTR x",), ("查一下这个指标 ctr",), ("none x",)], "text string")
    assert [r.skill for r in understanding.match_skill(texts, skills).orderBy("text").collect()] == [None, "b", "a"]


def test_answers(spark):
    s = one(spark, "request_id=abc 近30分钟 报错 500 Timeout, trace_id: x-1 at 10:30 报错", answers.symptoms(F.col("x")))
    assert (s.ids, s.times, s.signals) == (["abc", "x-1"], ["近30分钟", "10:30"], ["报错", "500", "Timeout"])
    numbered = lambda t, k: one(spark, t, answers.numbered(F.col("x"), F.lit(k)))
    assert numbered("一。二，三!四?五", "list") == "一。二，三!四?五\n\n**要点清单**\n1. 一\n2. 二\n3. 三\n4. 四"
    assert numbered("1. a\nb", "list") == "1. a\nb" and numbered("a, b", "general") == "a, b" and numbered(None, "list") == ""
    why = lambda t: one(spark, t, answers.rejected(F.col("x")))
    assert [why(t) for t in (None, " \n", "my Chain of Thought", "思考过程", "fine")] == ["empty_answer", "empty_answer", "empty_answer:reasoning_dump", "empty_answer:reasoning_dump", None]
    judge = lambda t: one(spark, t, answers.judge_score(F.col("x")))
    assert [judge(t) for t in ('said {"score": 1.7} ok', "none", '{"detail": {"a": 1}, "score": 0.9}', '{"score": "x"}', None)] == [1.0, 0.0, 0.9, 0.0, 0.0]
    assert one(spark, "## Cause\n- a\n2. b\n# Fix:\nc", answers.sections(F.col("x"), ["cause", "fix"])) == {"cause": ["a", "b"], "fix": ["c"]}


def evidence_of(spark, hits):
    keys = ("source_type", "path", "title", "section", "symbol_name", "start_line", "end_line", "excerpt", "score")
    return spark.createDataFrame([("q", [tuple(h.get(k) for k in keys) for h in hits])], f"x string, hits array<{answers.HIT}>")


def test_answers_from_evidence_alone(spark):
    code = {"source_type": "code_x", "path": "a/b.py", "symbol_name": "f", "start_line": 3, "end_line": 9, "excerpt": "def  f"}
    wiki = {"source_type": "wiki", "path": "w.md", "title": "W", "section": "s", "excerpt": "text"}
    df = evidence_of(spark, [code, wiki, {"source_type": "case", "path": "c"}])
    f = df.select(answers.issue_fallback(F.lit("m"), answers.symptoms(F.lit("trace_id=t1 报错")), F.col("hits")).alias("f")).first().f
    assert f.root_cause == "高概率问题集中在 `a/b.py` -> `f` (line: 3-9) 所在逻辑分支，需重点核查输入边界、异常路径与状态更新链路。 已观测到异常信号：报错。"
    assert len(f.risks) == 3 and "`t1`" in f.risks[0] and len(f.fix_plan) == 4 and "`W`" in f.fix_plan[1] and len(f.verification_steps) == 3 and not f.need_user_confirmation
    none = evidence_of(spark, []).select(answers.issue_fallback(F.lit("m"), answers.symptoms(F.lit(None)), F.col("hits")).alias("f"), answers.qa_fallback(F.lit("m"), F.lit("h"), F.lit("list"), F.col("hits")).alias("q"), answers.evidence_block(F.col("hits")).alias("b")).first()
    assert none.f.need_user_confirmation and len(none.f.risks) == 2 and len(none.f.fix_plan) == 2 and none.q.startswith("当前问题主要落在 `m`。 模块说明：h。") and none.b == "none"
    given = F.struct(F.lit(" ").alias("root_cause"), F.array(F.lit("r")).alias("risks"), F.array().cast("array<string>").alias("fix_plan"), F.lit(None).cast("array<string>").alias("verification_steps"))
    kept = df.select(answers.filled(given, answers.issue_fallback(F.lit("m"), answers.symptoms(F.lit("")), F.col("hits"))).alias("f")).first().f
    assert kept.risks == ["r"] and kept.root_cause.startswith("高概率") and len(kept.fix_plan) == 4 and len(kept.verification_steps) == 3
    said = df.select(answers.qa_fallback(F.lit("m"), F.lit(""), F.lit("reason"), F.col("hits")).alias("q"), answers.place_fallback(F.lit("m"), F.lit(""), fusion.by_source(F.col("hits"))["code"]).alias("p"), answers.names_code(F.lit("see B.PY"), F.col("hits")).alias("y"), answers.names_code(F.lit("see"), F.col("hits")).alias("n")).first()
    assert said.q == "1. 代码位置：`a/b.py` -> `f` (line: 3-9)\n2. 代码摘要：def f\n3. W：text\n4. c" and said.p == "1. `a/b.py` -> `f` (line: 3-9)" and said.y and not said.n
    block = df.select(answers.evidence_block(F.col("hits"), 1).alias("b")).first().b
    assert block.split("\n")[0] == "[evidence_1]" and "- line_range: 3-9" in block


def test_final_messages(spark):
    hit = {"source_type": "Wiki_page", "path": "p", "section": "s"}
    df = evidence_of(spark, [hit, hit, {"path": "q"}]).withColumn("none", F.slice("hits", 1, 0))
    base = [F.lit("t").alias("trace_id"), F.lit("knowledge_qa").alias("route"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("answer")]
    cited = df.select(*base, F.col("hits").alias("citations"), F.col("none").alias("wiki_hits"), F.col("none").alias("case_hits"), F.lit(None).alias("code_hits"))
    m = answers.finalize(cited, debug=True).first()
    assert (m.kind, m.intent, m.status, m.content, [(c.source_type, c.path) for c in m.citations]) == ("knowledge_qa", "knowledge_qa", "completed", "", [("wiki", "p"), ("unknown", "q")])
    assert m.debug.evidence_count == 2 and m.debug.llm_reason == "llm_status_missing"
    listed = df.select(*base, F.col("none").alias("citations"), F.col("none").alias("wiki_hits"), F.col("hits").alias("case_hits"), F.col("none").alias("code_hits"))
    assert [c.source_type for c in answers.finalize(listed).first().citations] == ["wiki", "case"]
    out = answers.finalize(cited.withColumn("status", F.lit("out_of_scope"))).first()
    assert out.citations == [] and out.content == answers.TEXTS["out_of_scope"]


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("---\nname: x\nname: 'y'\non: yes\nn: 3\ntags: [a, b]\n---\nbody")
    (tmp_path / "b.md").write_text("  ")
    (tmp_path / "c.py").write_text("x = 1")
    lines = ['{"id": "1", "query": " q ", "gold_paths": ["p", "p", " "], "required_facts": ["a", ["b", "c"], []], "forbidden_claims": ["z"]}', '{"id": "2", "query": "q", "gold_wiki_paths": ["w"], "gold_code_paths": ["k"], "gold_paths": ["old"], "expected_module": "m"}', '{"id": "3", "query": "q", "expected_sources": ["Code_x"], "expected_route": "knowledge_qa"}']
    (tmp_path / "q.jsonl").write_text("\n".join(lines))
    docs = files.markdown(spark, str(tmp_path))
    row = files.front_matter(docs).select("*", files.meta_value(F.col("meta"), "on", "boolean").alias("on"), files.meta_value(F.col("meta"), "n", "int").alias("n"), files.meta_value(F.col("meta"), "tags", "array<string>").alias("tags"), files.meta_value(F.col("meta"), "gone", "int", 7).alias("gone")).first()
    assert docs.count() == 1 and row.meta["name"] == "y" and row.body == "body" and (row.on, row.n, row.tags, row.gone) == (True, 3, ["a", "b"], 7)
    assert [r.content for r in files.code(spark, str(tmp_path)).collect()] == ["x = 1"]
    one_, two, three = files.cases(spark, str(tmp_path / "q.jsonl")).orderBy("id").collect()
    assert (one_.query, one_.gold_paths, one_.expected_sources, one_.required_facts, one_.forbidden_claims, one_.expected_mode) == ("q", ["p"], ["wiki"], [["a"], ["b", "c"]], ["z"], "answer")
    assert (two.gold_paths, two.expected_sources, two.expected_module, two.expected_status) == (["w", "k"], ["wiki", "code"], "m", "completed") and (three.expected_sources, three.expected_route) == (["code"], "knowledge_qa")
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n')
    with pytest.raises(Exception, match="a case lacks query"):
        files.cases(spark, str(tmp_path / "bad.jsonl")).collect()


def test_stores_and_sinks(spark, tmp_path):
    v = lambda rows: spark.createDataFrame(rows, "item_id int, vector array<double>")
    path = str(tmp_path / "vectors")
    files.save_vectors(v([(1, [1.0]), (1, [1.0]), (2, [2.0])]), path)
    for _ in range(2):
        files.add_vectors(v([(2, [9.0]), (3, [3.0])]), path)
    files.delete_vectors(spark, v([(1, [])]), path)
    assert sorted((r.item_id, r.vector[0]) for r in files.load_vectors(spark, path).collect()) == [(2, 9.0), (3, 3.0)]
    log = spark.createDataFrame([(dt.datetime(2024, 1, 1), "info", "llm.debug_request", "n", 1)], "ts timestamp, level string, event string, node_name string, attempt int")
    files.append_log(log, str(tmp_path / "log"))
    files.append_log(log, str(tmp_path / "log"))
    lines = files.tail(spark, str(tmp_path / "log"), "debug_request", 1, str(tmp_path / "last"))
    parsed = observability.parse_log(lines, ["node_name", "attempt"]).first()
    assert (parsed.ts, parsed.level, parsed.event, parsed.node_name, parsed.attempt) == ("2024-01-01 00:00:00", "INFO", "llm.debug_request", "n", "1")
    assert spark.read.text(str(tmp_path / "last")).count() == 1
    report = spark.createDataFrame([("a|b", 1.5), (None, 2.0)], "name string, value double")
    files.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    assert files.markdown_table(report, "R").split("\n")[2:] == ["| name | value |", "| --- | --- |", "| a\\|b | 1.5 |", "|  | 2.0 |"]
    assert sorted(files.bootstrap(spark, str(tmp_path / "store"))) == sorted(files.TABLES) and files.bootstrap(spark, str(tmp_path / "store")) == []
    assert spark.read.parquet(str(tmp_path / "store/alerts")).count() == 0
    assert [one(spark, x, files.relative(F.col("x"), "/r/")) for x in ("/r/a/b", "\\r\\a", "/other")] == ["a/b", "a", "/other"]
    assert files.resolve("q", str(tmp_path / "none"), str(tmp_path)) == str(tmp_path / "none/q") and files.resolve("log", str(tmp_path / "none"), str(tmp_path)) == str(tmp_path / "log")


def test_profiles_are_data(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"profile_id": "d", "domain_gate": {"domain_terms": ["bid"], "threshold": 0.6}, "routing": {"default_module": "main"}, "modules": [{"name": "bid", "hint": "h", "route_priority": 3, "keywords": ["bid"], "symbol_keywords": ["f"]}], "query_rewrite": {"synonyms": {"A": ["b"]}, "query_templates": [{"trigger_all": ["x"], "queries": ["y"]}], "intent_terms": {"code": ["src"]}}, "prompts": {"qa_path": "qa.md", "own": "t"}}')
    (tmp_path / "qa.md").write_text(" hello \n")
    p = files.profile(str(tmp_path / "p.json"))
    assert (p.profile_id, p.threshold, p.default_module, p.synonyms, p.code_words, p.templates[0].queries, p.short_most) == ("d", 0.6, "main", {"a": ("b",)}, ("src",), ("y",), 4)
    assert [tuple(r) for r in understanding.module_table(p, spark).select("name", "hint", "priority", "is_default").collect()] == [("bid", "h", 3, False)]
    assert files.prompts(str(tmp_path / "p.json")) == {"qa": "hello", "own": "t"}
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError, match="isn't JSON"):
        files.profile(str(tmp_path / "bad.json"))


def test_skills(spark, tmp_path):
    from sextant.sources import skills

    (tmp_path / "a/references").mkdir(parents=True)
    (tmp_path / "a/references/r.txt").write_text("x")
    (tmp_path / "a/SKILL.md").write_text("---\nname: metrics\ntrigger:\n  keywords: [CTR]\n  patterns: ['q.*z']\ntools:\n  - name: t\n    parameters:\n      a: {type: array, required: true, default: 1}\n      b: string\n      c: 3\n    script: s.py\n---\nbody")
    (tmp_path / "b").mkdir()
    (tmp_path / "b/SKILL.md").write_text("---\nname: [\n---\n")
    (tmp_path / "c").mkdir()
    (tmp_path / "c/SKILL.md").write_text("---\nid: other\nenabled: false\ntools: [{name: u}]\n---\n")
    c = skills.Catalog().scan(str(tmp_path))
    assert list(c.skills) == ["metrics", "other"] and len(c.failed) == 1 and [s.skill_id for s in c.enabled()] == ["metrics"]
    assert c.schemas() == [{"type": "function", "function": {"name": "t", "description": "", "parameters": {"type": "object", "properties": {"a": {"type": "array", "description": "", "default": 1}, "b": {"type": "string", "description": ""}}, "required": ["a"]}}}]
    texts = spark.createDataFrame([("the ctr",), ("Q and Z",), ("no",)], "text string")
    assert [r.skill for r in understanding.match_skill(texts, c.triggers(spark)).orderBy("text").collect()] == ["metrics", None, "metrics"]
    assert [r.name for r in skills.references(spark, str(tmp_path)).collect() if r.name == "r.txt"] == ["r.txt"]
    c.register(spark, "twice", lambda x: 2 * x, "int")
    assert spark.sql("SELECT twice(4) AS y").first().y == 8


def test_turns_and_alerts(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    cite = [("wiki_x",), ("code",)]
    long = "x" * 40
    rows = [(at(1), long, cite, "knowledge_qa", "completed", "llm", None, 100), (at(2), long, cite, "knowledge_qa", "completed", "rule", "empty_answer:x", 200), (at(3), long + "证据不足", cite, "knowledge_qa", "failed", "", "", 300), (at(4), " " * 50, [], "other", "completed", None, None, 900), (at(90), long, cite, "knowledge_qa", "completed", "llm", None, 1)]
    t = spark.createDataFrame(rows, "ts timestamp, answer string, citations array<struct<source_type:string>>, intent string, status string, generation_mode string, fallback_reason string, latency_ms int")
    f = observability.turn_flags(t)
    got = [tuple(r) for r in f.orderBy("ts").select("is_qa_turn", "is_empty_response", "is_fallback", "contains_insufficient", "exact_like_pass", "wiki_citations").collect()]
    assert got == [(True, False, False, False, True, 1), (True, True, True, False, False, 1), (True, False, False, True, False, 1), (False, False, False, False, False, 0), (True, False, False, False, True, 1)]
    lit = lambda x: F.lit(x).cast("timestamp")
    s = lambda mode, until=60: tuple(observability.turn_summary(f, lit(at(0)), lit(at(until)), mode).first())
    assert s("compat") == (3, 0.25, 0.25, 0.25, 0.25, 290.0) and s("qa_only") == pytest.approx((3, 1 / 3, 1 / 3, 1 / 3, 1 / 3, 290.0)) and s("compat", 0) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    summary = observability.turn_summary(f, lit(at(0)), lit(at(60)))
    found = observability.alerts(summary, observability.turn_rules(0.1, 0.3, 0.1, 100.0, 0.9), least=3)
    assert {r.alert_type for r in found.collect()} == {"empty_response_rate_high", "insufficient_rate_high", "p95_latency_high", "exact_like_pass_rate_low"}
    emitted = spark.createDataFrame([("p95_latency_high", at(30), "open"), ("insufficient_rate_high", at(29), "open"), ("exact_like_pass_rate_low", at(59), "closed")], "alert_type string, created_at timestamp, status string")
    left = observability.not_recent(found, emitted, 30, lit(at(60)))
    assert {r.alert_type for r in left.collect()} == {"empty_response_rate_high", "insufficient_rate_high", "exact_like_pass_rate_low"}
    row = observability.alert_rows(left, summary, 60, lit(at(60))).where("alert_type = 'insufficient_rate_high'").first()
    assert (row.status, row.window_minutes, row.sample_size, row.severity, row.metric_value) == ("open", 60, 3, "medium", 0.25) and '"fallback_rate":0.25' in row.detail
    assert observability.snapshot_rows(summary, 60).count() == 0 and observability.snapshot_rows(summary, 60, 3).first().p95_latency_ms == 290.0


def test_log_joins_with_ties(spark):
    rows = [(1, 1, "v"), (2, 1, "p"), (3, 2, "p"), (4, 2, "v"), (5, 1, "p"), (6, 2, "p"), (9, 1, "p")]
    e = spark.createDataFrame(rows, "id int, t int, kind string").withColumn("k", F.lit(1))
    left, right = F.col("kind") == "v", F.col("kind") == "p"
    assert {r.id: r.matched for r in observability.next_matching(e, "k", "t", left, right, "id").collect()} == {1: 3, 4: None}
    assert {r.id: r.matched for r in observability.last_matching(e, "k", "t", left, right, "id").collect()} == {1: 9, 4: 6}
    entries = [(1, "a.debug_request", "n", "1", "m"), (2, "a.debug_response", "x", "1", "m"), (3, "a.debug_response", "n", "1", "other"), (4, "a.debug_response", "n", "1", ""), (5, "a.debug_request", "n", "2", None)]
    df = spark.createDataFrame([("f", *x) for x in entries], "file string, line int, event string, node_name string, attempt string, model string")
    assert {r.line: r.response_line for r in observability.responses(df, ("model",)).collect()} == {1: 4, 5: None}


def test_sessions_round_trip(spark):
    s = spark.createDataFrame([("session-12345678", " ", 1, 2, None, "u", 5), ("b", "T", 1, 2, "busy", None, None)], "session_id string, title string, created_at int, updated_at int, status string, user string, n int")
    rows = sessions.serialize(s)
    back = {r.session_id: r for r in sessions.deserialize(rows, "user string, n int, title string").collect()}
    assert (back["session-12345678"].title, back["session-12345678"].status, back["session-12345678"].user, back["session-12345678"].n) == ("新会话 12345678", "idle", "u", 5) and back["b"].title == "T"
    over = sessions.deserialize(rows.withColumn("payload", F.lit('{"title": "over"}')), "title string").collect()
    assert {r.title for r in over} == {"over"}
    with pytest.raises(Exception, match="lacks its id"):
        sessions.serialize(s.withColumn("session_id", F.lit(" "))).collect()
    m = spark.createDataFrame([("m1", 1, "t", "assistant", "k", "i", "s"), ("m2", 1, None, "user", None, None, None)], "message_id string, conv_id int, trace_id string, role string, kind string, intent string, status string")
    give = lambda i: spark.createDataFrame([(i, True, " x ", 5, None)], "message_id string, helpful boolean, reason_tag string, rating int, comment string")
    r = sessions.feedback(m, give("m1")).first()
    assert (r.reason_tag, r.comment, r.trace_id, r.payload) == ("x", "", "t", '{"kind":"k","intent":"i","status":"s"}')
    for i in ("m2", "gone"):
        with pytest.raises(Exception, match="only an assistant"):
            sessions.feedback(m, give(i)).collect()
    h = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id int, turn int, role string, text string")
    new = spark.createDataFrame([(1, "user", "c", 1), (2, "user", "d", 1)], "conv_id int, role string, text string, nth int")
    assert sorted((r.conv_id, r.turn, r.text) for r in sessions.add_turn(h, new).collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")]


def test_recursive_chunks_against_a_plain_version():
    def plain(text, size, overlap, seps):
        sep = next((s for s in seps if s == "" or s in text), "")
        rest = seps[seps.index(sep) + 1 :]
        parts = list(text) if not sep else [(sep if i else "") + p for i, p in enumerate(text.split(sep))]
        out, window = [], []
        emit = lambda: out.append("".join(window).strip()) if "".join(window).strip() else None
        for p in filter(None, parts):
            if len(p) > size and rest:
                emit()
                window = []
                out.extend(plain(p, size, overlap, rest))
                continue
            if window and sum(map(len, window)) + len(p) > size:
                emit()
                while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(p) > size):
                    window.pop(0)
            window.append(p)
        emit()
        return out

    import random

    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "\n\n", "\n## ", "。", "；", "d" * 30]) for _ in range(rng.randint(0, 120)))
        assert chunking.split_text(text, 60, 12) == plain(text, 60, 12, list(chunking.SEPARATORS))


def test_content_and_grep_terms(spark):
    r = spark.createDataFrame([("p", "s"), ("p", "gone"), ("q", "s")], "path string, section string")
    c = spark.createDataFrame([("p", "t", 0, "first"), ("p", "s", 1, "own")], "path string, section string, chunk_no int, content string")
    assert {(x.path, x.section): x.content for x in ranking.with_content(r, c).collect()} == {("p", "s"): "own", ("p", "gone"): "first", ("q", "s"): None}
    words = one(spark, "a", ranking.wiki_grep_terms(F.array(F.lit("recall"), F.lit("x"), F.lit("bid")), F.lit("Bid-Opt")))
    assert words == ["recall", "bid", "bid-opt"]
    assert ranking.no_cases(spark.createDataFrame([(1,)], "query_id int")).count() == 0
    ranked_ = spark.createDataFrame([(1, 1, 1, 5.0, 0.1), (1, 2, 2, 4.0, None), (1, 3, 3, 3.0, 0.9)], "query_id int, item_id int, rank int, score double, s double")
    assert [x.item_id for x in ranking.rerank(ranked_, F.col("s")).orderBy("rank").collect()] == [3, 1, 2]


def test_code_scores(spark):
    rows = [("where is bid_rate = x", "def bid_rate(): a = bid_rate", "bid_rate"), ("plain words", "nothing", "other"), ("", "", ""), (None, "x", "y")]
    df = spark.createDataFrame(rows, "q string, c string, s string").withColumn("asked", ranking.code_patterns(F.col("q")))
    c, s, asked, path = F.lower("c"), F.col("s"), F.col("asked"), F.lit("src/bid_rate.py")
    got = df.select("asked", ranking.code_lexical(c, s, path, c, asked["ids"]).alias("l"), ranking.code_pattern(c, F.col("c"), s, path, asked).alias("p")).collect()
    assert got[0].asked.ids == ["bid_rate", "where", "is"] and got[0].asked.exact == got[0].asked.fields == ["bid_rate"]
    assert got[0].asked.formula and got[0].asked.place and not got[1].asked.place
    # Two occurrences, a long name; in the symbol, path and signature. The symbol itself, a field, a formula, a place.
    assert got[0].l == pytest.approx(2 * 1.8 + 1.4 + 1.1 + 0.9) and got[0].p == pytest.approx(6.0 + 0.8 + 1.2 + 0.6)
    assert all(r.l == r.p == 0.0 for r in got[1:]) and got[3].asked.ids == []


def test_general_penalty(spark):
    rows = [("00-all.md", ["02-"], 0.0, True, 0.25), ("00-all.md", ["02-"], 0.5, True, 0.15), ("00-02-x.md", ["02-"], 0.0, True, 0.0), ("rate.md", ["Rate"], 0.0, True, 0.0), ("a-rate.md", ["rate"], 0.0, True, 0.25), ("x.md", ["02-"], 0.0, False, 0.0), ("00-all.md", [], 0.0, True, 0.0)]
    df = spark.createDataFrame(rows, "path string, hints array<string>, boost double, general boolean, want double")
    for r in df.withColumn("got", ranking.general_penalty(F.col("path"), F.col("hints"), F.col("boost"), F.col("general"))).collect():
        assert r.got == pytest.approx(r.want), r


def test_answer_measures(spark):
    none = []
    rows = [("The bid = 3, see Bid.py", ["bid=3"], ["f"], ["src\\\\bid.py"], ["wiki"], ["wiki", "code"]), ("不足", none, none, none, none, none), ("1. a", ["b"], ["a"], none, ["wiki", "case"], ["wiki"])]
    df = spark.createDataFrame(rows, "a string, claims array<string>, symbols array<string>, paths array<string>, want array<string>, have array<string>")
    a, anchor, sources = F.col("a"), evaluation.anchor_hit(F.col("a"), F.col("symbols"), F.col("paths")), evaluation.sources_hit(F.col("want"), F.col("have"))
    kinds = [evaluation.structure_hit(F.lit(k), a, anchor, sources).alias(k[0] + k[-1]) for k in ("formula", "reason", "function_location", "mixed_followup", "other")]
    modes = [evaluation.mode_accuracy(a, F.lit(m), ["不足"]).alias(m) for m in ("either", "insufficient_evidence", "answer")]
    got = df.select(evaluation.forbidden_pass(a, F.col("claims")).alias("f"), *modes, anchor.alias("n"), sources.alias("s"), evaluation.hit_if_gold(F.col("want"), F.col("have")).alias("g"), *kinds).collect()
    assert tuple(got[0]) == (0.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, None)
    assert tuple(got[1]) == (1.0, 1.0, 1.0, 0.0, None, None, None, 0.0, 0.0, 0.0, 0.0, None)
    assert tuple(got[2]) == (1.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, None)


def test_retrieval_plan(spark):
    rows = [("why this line of x.py?", "knowledge_qa"), ("the class of it", "issue_analysis"), ("指标 口径", "knowledge_qa"), ("metric of the code", None), (None, "issue_analysis")]
    df = spark.createDataFrame(rows, "t string, r string").select(understanding.retrieval_plan(F.col("t"), F.col("r"), understanding.Profile()).alias("p"))
    got = [r.p for r in df.collect()]
    assert [p.strategy for p in got] == ["code_first", "code_first", "wiki_first", "hybrid", "hybrid"]
    assert [(p.wiki_top_k, p.code_top_k) for p in got] == [(2, 7), (3, 7), (6, 2), (4, 4), (4, 6)]
    assert got[4].weights.code == 1.15 and got[4].reasons == ["query_is_hybrid", "issue_analysis_bias_code"] and got[0].quotas.wiki == 2


def test_line_boost(spark):
    children = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "k string, child_no int")
    lines = spark.createDataFrame([("a", 29), ("a", 29), ("a", 36), ("a", 37), ("a", 150)], "k string, line_no int")
    got = {(r.k, r.child_no): (r.line_hits, round(r.line_boost, 4)) for r in ranking.line_boost(children, lines, "k").collect()}
    # Lines 29 to 36 are in the first two windows; 150 is beyond the last one.
    assert got == {("a", 0): (2, 4.4), ("a", 1): (3, 6.6), ("a", 2): (0, 0.0), ("a", 3): (0, 0.0)}


def test_highlight_of_many_lines_takes_time_by_their_number(spark):
    """The place of the first hit was looked for again in each line."""
    import time

    text = "\n".join(["a line without it"] * 4000 + ["the hit"] * 3)
    docs = spark.createDataFrame([(text,)] * 4, "x string").repartition(4)
    h = chunking.highlight(F.col("x"), F.array(F.lit("hit"), F.lit("no")))
    start = time.time()
    found = docs.select(h.alias("h")).select("h.hits", "h.text").collect()
    assert [r.hits for r in found] == [[4001, 4002, 4003]] * 4 and found[0].text.startswith("...\n   3999: a line without it")
    assert time.time() - start < 20
