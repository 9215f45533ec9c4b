"""Retrieval and answer metrics. Cases are the left side throughout, so that a case without hits counts as a miss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import squeeze


def per_case(cases: DataFrame, hits: DataFrame, is_gold: Column, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """cases (query_id, ...) and hits (query_id, rank, ...): hit@k and the reciprocal rank of the first gold hit."""
    first = hits.join(cases, "query_id").where(is_gold).groupBy("query_id").agg(F.min("rank").alias("first_gold"))
    joined = cases.join(first, "query_id", "left")
    return joined.select("*", *[(F.coalesce(F.col("first_gold") <= k, F.lit(False))).cast("double").alias(f"hit_at_{k}") for k in ks], F.coalesce(1.0 / F.col("first_gold"), F.lit(0.0)).alias("reciprocal_rank"))


def overall(per: DataFrame, ks: tuple[int, ...] = (1, 3, 5), by: str | None = None) -> DataFrame:
    """Means over cases; with `by` for each group and, under a null group, for all."""
    measures = [F.count("*").alias("cases"), *[F.avg(f"hit_at_{k}").alias(f"recall_at_{k}") for k in ks], F.avg("reciprocal_rank").alias("mrr")]
    return per.rollup(by).agg(*measures) if by else per.agg(*measures)


def says(answer: Column, claim: Column) -> Column:
    """Whether the answer has the claim in it, both without case, space and punctuation; nothing says an empty claim."""
    return (squeeze(claim) != "") & F.contains(squeeze(answer), squeeze(claim))


def fact_coverage(answer: Column, groups: Column) -> Column:
    """Share of the groups of which the answer says one alternative; 1 without groups. Groups of blank alternatives only don't
    count."""
    real = F.filter(groups, lambda g: F.exists(g, lambda x: F.trim(x) != ""))
    return F.when(F.size(real) > 0, F.size(F.filter(real, lambda g: F.exists(g, lambda x: says(answer, x)))) / F.size(real)).otherwise(1.0)


def hit_or_empty(gold: Column, found: Column) -> Column:
    return F.when(F.size(gold) == 0, 1.0).otherwise(F.arrays_overlap(gold, found).cast("double"))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that are there, weighted; null if none is."""
    some = [(c, w) for c, w in parts if w > 0]
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in some), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(c, F.lit(0.0)) * w for c, w in some), F.lit(0.0)) / total)


def exact(coverage: Column, forbidden_ok: Column, mode_ok: Column, cited: Column, least: float = 0.8) -> Column:
    return (coverage >= least) & forbidden_ok & mode_ok & cited


def gate(metrics: DataFrame, metric: str, least: float) -> DataFrame:
    return metrics.withColumn("passed", F.col(metric) >= least)


#: Modes that ask nothing of an answer's form.
FREE_MODES = ("either", "answer_or_insufficient", "flexible")


def forbidden_pass(answer: Column, claims: Column) -> Column:
    """1 unless the answer makes one of the claims, both compared without case, space and punctuation."""
    return F.when(F.exists(claims, lambda c: says(answer, c)), 0.0).otherwise(1.0)


def mode_accuracy(answer: Column, expected: Column, markers: list[str]) -> Column:
    """Whether an answer that should say that evidence is missing says so, and no other does."""
    says = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(answer, m))
    return F.when(expected.isin(*FREE_MODES), 1.0).when(expected == "insufficient_evidence", says.cast("double")).otherwise((~says).cast("double"))


def hit_if_gold(gold: Column, found: Column) -> Column:
    """1 or 0 where there is gold, else null: an average over it has its own denominator."""
    return F.when(F.size(gold) > 0, F.arrays_overlap(gold, found).cast("double"))


def sources_hit(expected: Column, found: Column) -> Column:
    """1 if all expected sources were cited; null where none is expected."""
    return F.when(F.size(expected) > 0, (F.size(F.array_except(expected, found)) == 0).cast("double"))


def anchor_hit(answer: Column, symbols: Column, paths: Column) -> Column:
    """1 if the answer names a symbol, a path or a path's file; null where neither is expected."""
    names = F.concat(symbols, paths, F.transform(paths, lambda p: F.element_at(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), -1)))
    hit = F.exists(F.filter(names, lambda n: squeeze(n) != ""), lambda n: F.contains(squeeze(answer), squeeze(n)))
    return F.when((F.size(symbols) > 0) | (F.size(paths) > 0), hit.cast("double"))


def structure_hit(kind: Column, answer: Column, anchor: Column, sources: Column) -> Column:
    """By kind of question: a formula in the answer, a list or the word for reason, a code anchor, all sources; else null."""
    formula = F.contains(answer, F.lit("=")) | F.contains(squeeze(answer), F.lit("公式"))
    reason = answer.rlike(r"(?m)^\s*(?:\d+\.|[-*])\s+") | F.contains(squeeze(answer), F.lit("原因"))
    return (
        F.when(kind == "formula", formula.cast("double"))
        .when(kind == "reason", reason.cast("double"))
        .when(kind == "function_location", F.coalesce(anchor, F.lit(0.0)))
        .when(kind == "mixed_followup", F.coalesce(sources, F.lit(0.0)))
    )


def contains_text(text: Column, part: Column) -> Column:
    """Whether a text holds another one, both without case, space and punctuation; an empty one is in none."""
    return (squeeze(part) != "") & F.contains(squeeze(text), squeeze(part))


def _hit_within(hits: Column, gold: Column, k: int, texts: Callable[[Column], Column]) -> Column:
    """1 without gold; else whether one of the texts of the first k hits holds a gold text."""
    some = F.exists(F.slice(hits, 1, k), lambda h: F.exists(texts(h), lambda t: F.exists(gold, lambda g: contains_text(t, g))))
    return F.when(F.size(F.coalesce(gold, F.array().cast("array<string>"))) == 0, 1.0).otherwise(F.coalesce(some, F.lit(False)).cast("double"))


def _joined(h: Column, *names: str) -> Column:
    return F.array(F.concat_ws(" ", *[F.coalesce(h[n], F.lit("")) for n in names]))


def symbol_hit(hits: Column, gold: Column, k: int) -> Column:
    """hits: an array of structs with symbol_name and signature, the best first."""
    return _hit_within(hits, gold, k, lambda h: _joined(h, "symbol_name", "signature"))


def pattern_hit(hits: Column, gold: Column, k: int) -> Column:
    """hits: structs with title, symbol_name, signature and excerpt."""
    return _hit_within(hits, gold, k, lambda h: _joined(h, "title", "symbol_name", "signature", "excerpt"))


def highlight_hit(hits: Column, gold: Column, k: int) -> Column:
    """hits: structs with lines, an array of struct(line_no, content, is_hit): a hit line must hold a gold text."""
    return _hit_within(hits, gold, k, lambda h: F.transform(F.filter(h["lines"], lambda x: x["is_hit"]), lambda x: x["content"]))


def numbered_lines(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?mU)^\s*\d+\.\s+"))


def issue_measures(cases: DataFrame, responses: DataFrame, need_model: bool = False) -> DataFrame:
    """One row for each case (id, expected_route, expected_kind, expected_status, expected_module) with what its response (id,
    intent, kind, status, answer, anchors, module, root_cause, risks, fix_plan, verification_steps, generation_mode,
    legacy_mode, need_user_confirmation, attempts) got right, as 1.0 or 0.0. module_hit is null where no module is expected;
    a case without a response has missed everything. anchors are names of its evidence."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    one = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    filled = lambda c: F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    mode = F.lower(F.coalesce(F.nullif(text("generation_mode"), F.lit("")), text("legacy_mode")))
    low = F.lower(text("answer"))
    rows = cases.join(responses, "id", "left").select(
        *[F.col(c) for c in cases.columns], mode.alias("mode"),
        *[one(text(got) == F.col(f"expected_{want}")).alias(f"{want}_hit") for got, want in (("intent", "route"), ("kind", "kind"), ("status", "status"))],
        F.when(F.trim(F.coalesce("expected_module", F.lit(""))) != "", one(text("module") == F.col("expected_module"))).alias("module_hit"),
        one(text("root_cause") != "").alias("root_cause"), *[one(filled(c) >= 2).alias(c) for c in ("risks", "fix_plan", "verification_steps")],
        one((low != "") & F.exists("anchors", lambda a: (F.length(a) >= 3) & F.contains(low, F.lower(a)))).alias("anchor_hit"),
        one(F.col("need_user_confirmation")).alias("need_user_confirmation"), one(numbered_lines(F.col("answer")) >= 2).alias("numbered_answer"),
        F.coalesce(F.col("attempts"), F.lit(0)).cast("double").alias("attempts"),
    )
    model = F.col("mode") == "llm"
    right = (F.col("route_hit") == 1) & (F.col("kind_hit") == 1) & (F.col("status_hit") == 1) & (F.coalesce("module_hit", F.lit(1.0)) == 1)
    return rows.select(
        "*", one((F.col("root_cause") == 1) & (F.col("risks") == 1) & (F.col("fix_plan") == 1) & (F.col("verification_steps") == 1)).alias("structure_pass"),
        one(model).alias("llm_mode"), one(F.col("mode") == "fallback_rule").alias("fallback_mode"), one(F.col("mode").isin("llm", "fallback_rule")).alias("valid_generation_mode"),
        one(F.col("mode") == "error").alias("runtime_error"), one(model if need_model else F.lit(True)).alias("llm_required_pass"), one(right & model if need_model else right).alias("strict_pass"),
    )


def issue_report(measures: DataFrame, least_model_rate: float = 0.0) -> DataFrame:
    """One row: the rates over all cases, module_accuracy over those with an expected module, and whether enough answers came
    from the model."""
    names = {
        "route_accuracy": "route_hit", "kind_accuracy": "kind_hit", "status_accuracy": "status_hit", "module_accuracy": "module_hit", "strict_pass_rate": "strict_pass",
        "root_cause_presence_rate": "root_cause", "risk_coverage_rate": "risks", "fix_plan_coverage_rate": "fix_plan", "verification_coverage_rate": "verification_steps",
        "analysis_structure_pass_rate": "structure_pass", "evidence_anchor_hit_rate": "anchor_hit", "llm_mode_rate": "llm_mode", "fallback_mode_rate": "fallback_mode",
        "valid_generation_mode_rate": "valid_generation_mode", "need_user_confirmation_rate": "need_user_confirmation", "numbered_answer_rate": "numbered_answer",
        "runtime_error_rate": "runtime_error", "llm_required_pass_rate": "llm_required_pass", "avg_attempts": "attempts",
    }
    out = measures.agg(F.count("*").alias("total_cases"), F.count("module_hit").alias("module_eval_count"), *[F.round(F.avg(c), 6).alias(name) for name, c in names.items()])
    return out.withColumn("llm_mode_threshold_passed", F.coalesce(F.col("llm_mode_rate"), F.lit(0.0)) >= least_model_rate)


def require(gated: DataFrame, name: str = "passed") -> None:
    """Raises if a gate hasn't passed: the hard form of `gate`."""
    if (failed := gated.where(~F.col(name)).count()) > 0:
        raise ValueError(f"{failed} gates have not passed")


def backoff(attempt: Column, base_ms: int = 300) -> Column:
    """Seconds to wait before the next attempt: doubled each time."""
    return F.lit(base_ms / 1000.0) * F.pow(F.lit(2.0), attempt - 1)


def regressions(messages: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Scripted conversations: messages (case_id, turn, ...) against one condition for each case, over the case's turns as
    columns t1, t2, ... of structs, as many as the longest case has (four at least, null beyond a case's end). A case without
    messages, or whose condition is null, has failed. A case, being a script, fits into a task."""
    most = max(4, messages.groupBy("case_id").count().agg(F.max("count")).first()[0] or 0)
    turns = messages.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.struct(*[c for c in messages.columns if c != "case_id"]).alias("m")))).alias("ts"))
    cases = messages.sparkSession.createDataFrame([(c,) for c in checks], "case_id string").join(turns, "case_id", "left")
    named = cases.select("case_id", *[F.get("ts", F.lit(i))["m"].alias(f"t{i + 1}") for i in range(most)], F.coalesce(F.size("ts"), F.lit(0)).alias("n_turns"))
    passed = F.lit(False)
    for case, condition in checks.items():
        passed = F.when(F.col("case_id") == case, F.coalesce(condition, F.lit(False))).otherwise(passed)
    return named.select("case_id", "n_turns", passed.alias("passed"))
