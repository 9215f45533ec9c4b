"""Operators that split large groups over tasks, held to plain versions."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from sextant.operators import chunking, evaluation, observability, statistics
from sextant.sources import files


def test_suppression_by_blocks_equals_the_fold_over_a_keys_times(spark):
    rng, base = random.Random(5), datetime.datetime(1969, 12, 25)
    rows = [(k, base + datetime.timedelta(seconds=rng.randrange(86400 * d), microseconds=rng.choice([0, 1, 250_000]))) for k, d, n in (("dense", 3, 4000), ("sparse", 90, 300), (None, 2, 500)) for _ in range(n)]
    rows += [("one", base), ("one", base), ("edge", base), ("edge", base + datetime.timedelta(minutes=30)), ("edge", base + datetime.timedelta(minutes=30, microseconds=1)), ("none", None)]
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame(rows, "alert_type string, ts timestamp_ntz").select("alert_type", F.col("ts").cast(kind)).repartition(5)
        for minutes in (0, 1, 30):
            want = []
            for k in {r[0] for r in rows}:
                last = None
                for t in sorted({t for x, t in rows if x == k and t is not None}):
                    if last is None or t > last + datetime.timedelta(minutes=minutes):
                        want.append((k, t))
                        last = t
            out = observability.suppress(df, minutes)
            assert dict(out.dtypes)["ts"] == kind
            got = out.select("alert_type", F.col("ts").cast("timestamp_ntz")).collect()
            assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert observability.suppress(df.limit(0), 30).count() == 0


@pytest.mark.parametrize("few", [1, 50, 1_000_000])
def test_percentiles_by_narrowed_ranges_are_exact(spark, few):
    rng = random.Random(7)
    rows = [("even", rng.random()) for _ in range(2000)] + [("skewed", 10 ** rng.uniform(-300, 300) * rng.choice([-1, 1])) for _ in range(900)]
    rows += [("one", 3.5), ("same", 2.0), ("same", 2.0), (None, 1.0), (None, 4.0), ("empty", None), ("two", -1e308), ("two", 1e308), ("far", float("inf")), ("far", float("-inf")), ("far", 0.0), ("nan", float("nan")), ("nan", 5.0)] + [("hot", float(rng.randrange(3))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for p in (0.0, 0.5, 0.95):
        got = {r.k: r.p for r in statistics.percentiles(df, ["k"], "v", p, few).collect()}
        want = {r.k: r.p for r in df.withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).groupBy("k").agg(F.percentile("v", p).alias("p")).collect()}
        assert set(got) == set(want)
        for k in want:
            assert (got[k] is None) == (want[k] is None) and (got[k] is None or got[k] == pytest.approx(want[k], rel=1e-12, abs=0))
    assert statistics.percentiles(df.limit(0), ["k"], "v", 0.5, few).count() == 0
    assert statistics.percentiles(df.limit(0), [], "v", 0.5, few).first().p is None


def test_snapshots_are_in_a_global_order_from_parts(spark):
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(60):02d}", i, "x" * rng.randrange(5)) for i in range(700)]
    df = spark.createDataFrame(rows, "path string, chunk_no int, content string").repartition(5)
    got = [tuple(r) for r in chunking.snapshot(df).select("path", "chunk_no", "doc_chunk_index", "index", "content_length").collect()]
    want, seen = [], {}
    for i, (path, no, content) in enumerate(sorted(rows)):
        seen[path] = seen.get(path, 0) + 1
        want.append((path, no, seen[path], i + 1, len(content)))
    assert got == want and chunking.snapshot(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "double", "timestamp_ntz", "string"])
def test_as_of_joins_of_split_keys_equal_plain_ones(spark, kind):
    rng = random.Random(9)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, *range(300)]), rng.randrange(3)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, k string, t bigint, kind int").repartition(5)
    at = {"bigint": F.col("t"), "double": F.col("t") / 7, "timestamp_ntz": F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(t AS int))"), "string": F.lpad(F.col("t").cast("string"), 5, "0")}[kind]
    df = df.withColumn("o", at).drop("t")
    assert dict(df.dtypes)["o"] == kind
    left, right, low = F.col("kind") == 0, F.col("kind") == 1, lambda t: -1 if t is None else t
    forward = {r.id: r.matched for r in observability.next_matching(df, "k", "o", left, right, "id").collect()}
    backward = {r.id: r.matched for r in observability.last_matching(df, "k", "o", left, right, "id").collect()}
    asked = [r for r in rows if r[3] == 0]
    assert len(forward) == len(backward) == len(asked)
    for i, k, t, _ in asked:
        said = [(low(x[2]), x[0]) for x in rows if x[3] == 1 and x[1] == k]
        assert forward[i] == min((x for x in said if x[0] > low(t)), default=(0, None))[1]
        assert backward[i] == max((x for x in said if x[0] <= low(t)), default=(0, None))[1]
    assert observability.next_matching(df.limit(0), "k", "o", left, right, "id").count() == 0


def test_responses_by_masks_equal_all_pairs(spark):
    rng = random.Random(4)
    pick = lambda *x: rng.choice([None, "", *x])
    rows = [(rng.choice("fg"), i, rng.choice(["x.debug_request", "x.debug_response", "y"]), pick("n"), pick("1"), pick("m", "o"), pick("p", "q")) for i in range(400)]
    df = spark.createDataFrame(rows, "file string, line int, event string, node_name string, attempt string, model string, module_name string")
    got = {(r.file, r.line): r.response_line for r in observability.responses(df, ("model", "module_name")).collect()}
    same = lambda a, b: (a or "") == (b or "")
    either = lambda a, b: not a or not b or a == b
    for r in rows:
        if r[2] == "x.debug_request":
            fits = [x[1] for x in rows if x[0] == r[0] and x[1] > r[1] and x[2] == "x.debug_response" and same(x[3], r[3]) and same(x[4], r[4]) and either(x[5], r[5]) and either(x[6], r[6])]
            assert got.pop((r[0], r[1])) == min(fits, default=None)
    assert not got


def test_reports_are_written_whole(spark, tmp_path):
    df = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("a|b\nc"), "id")).alias("x y")).orderBy(F.desc("id"))
    files.write_pretty_json(df, str(tmp_path / "j"))
    (name,) = (tmp_path / "j").glob("*.txt")
    assert json.loads(name.read_text()) == [r.asDict() for r in df.collect()] and '\n  "id"' in name.read_text()
    files.write_pretty_json(df.limit(0), str(tmp_path / "e"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "e").glob("*.txt"))) == []
    files.write_markdown(df, "T", str(tmp_path / "m"))
    (name,) = (tmp_path / "m").glob("*.txt")
    assert name.read_text().rstrip("\n") == files.markdown_table(df, "T", 3000) and name.read_text().count("\n") == 3004
    assert files.markdown_table(df, "T", 10).endswith("Only the first 10 rows are shown.")


def test_scripts_of_any_number_of_turns(spark):
    messages = spark.createDataFrame([("long", i, f"m{i}") for i in range(1, 8)] + [("short", 1, "x")], "case_id string, turn int, text string")
    checks = {"long": F.col("t7")["text"] == "m7", "short": F.col("t5").isNull() & (F.col("t1")["text"] == "x"), "none": F.lit(None).cast("boolean")}
    got = {r.case_id: (r.n_turns, r.passed) for r in evaluation.regressions(messages, checks).collect()}
    assert got == {"long": (7, True), "short": (1, True), "none": (0, False)}
