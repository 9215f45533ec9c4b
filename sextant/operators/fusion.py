"""Evidence fusion: normalise sources, weight, order, deduplicate, fill quotas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What a list's grade adds to its hits, and what a kind of question adds to a kind of source.
GRADE_BIAS = {"high": 0.35, "medium": 0.15, "low": 0.0, "insufficient": -0.1, "disabled": -0.2}
INTENT_BIAS = {"code_location": {"code": 0.25, "wiki": -0.1, "case": 0.0}, "wiki_first": {"wiki": 0.15, "code": -0.05, "case": 0.0}}
#: The order of lists of hits, which ties follow.
SOURCES = ("wiki", "case", "code")


@dataclass(frozen=True)
class Plan:
    """How sources are weighted and how many of each are wanted. intent is code_location, wiki_first or empty."""

    weights: dict[str, float] = field(default_factory=lambda: {"wiki": 1.0, "code": 1.0, "case": 0.6})
    quotas: dict[str, int] = field(default_factory=lambda: {"wiki": 4, "code": 4, "case": 1})
    final_top_k: int = 6
    intent: str = ""

    def for_intent(self, intent: str) -> Plan:
        """A question for a place in code raises the code's weight and quota and lowers the wiki's, of which one hit at least
        stays wanted; a question for documents the other way round."""
        w, n = dict(self.weights), dict(self.quotas)
        if intent == "code_location":
            w |= {"code": max(w.get("code", 1.0), 1.35), "wiki": min(w.get("wiki", 1.0), 0.8)}
            n |= {"code": max(n.get("code", 0), 5), "wiki": min(max(n.get("wiki", 1), 1), 2)}
        elif intent == "wiki_first":
            w |= {"wiki": max(w.get("wiki", 1.0), 1.15), "code": min(w.get("code", 1.0), 0.9)}
            n |= {"wiki": max(n.get("wiki", 0), 4)}
        return Plan(w, n, self.final_top_k, intent)


def source_kind(source: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return F.when(s == "", "unknown").when(s.startswith("wiki"), "wiki").when(s.startswith("code"), "code").when(s.startswith("case"), "case").otherwise("other")


def _lookup(of: dict[str, float | int], key: Column, default: float | int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in of.items() for x in p]), key), F.lit(default)) if of else F.lit(default)


def source_key(source: Column) -> Column:
    """wiki, code or case by how a source's name begins, else the name itself; unknown without one."""
    kind, name = source_kind(source), F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return F.when(kind == "other", name).otherwise(kind)


def weigh(hits: DataFrame, plan: Plan) -> DataFrame:
    """hits (query_id, source, item_id, path, section, rank, score, grade) with kind and fusion_score."""
    kind = source_key(F.col("source"))
    bias = _lookup(GRADE_BIAS, F.col("grade"), 0.0) + _lookup(INTENT_BIAS.get(plan.intent, {}), kind, 0.0)
    fused = F.col("score") * _lookup(plan.weights, kind, 1.0) + 0.12 / F.greatest(F.col("rank"), F.lit(1)) + bias
    return hits.withColumn("kind", kind).withColumn("fusion_score", F.round(fused, 6))


def _order() -> list[Column]:
    at = _lookup({k: i for i, k in enumerate(SOURCES)}, F.col("kind"), len(SOURCES))
    return [F.desc("fusion_score"), F.desc(F.round("score", 8)), at, F.col("kind"), F.col("rank"), F.col("item_id")]


def deduplicate(weighed: DataFrame) -> DataFrame:
    """The first of each (kind, path, section) in the fused order."""
    w = Window.partitionBy("query_id", "kind", "path", "section").orderBy(*_order())
    return weighed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def select(weighed: DataFrame, plan: Plan) -> DataFrame:
    """Each kind up to its quota (final_top_k where a kind has none), in the fused order; where that doesn't fill final_top_k,
    the others after them. fusion_rank is the place in that list."""
    within = Window.partitionBy("query_id", "kind").orderBy(*_order())
    over = F.row_number().over(within) > _lookup(plan.quotas, F.col("kind"), plan.final_top_k)
    tiered = weighed.withColumn("_tier", over.cast("int"))
    placed = tiered.withColumn("fusion_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_tier", *_order())))
    return placed.where(F.col("fusion_rank") <= plan.final_top_k).drop("_tier")


def merge(hits: DataFrame, plan: Plan) -> DataFrame:
    return select(deduplicate(weigh(hits, plan)), plan)


def profile(merged: DataFrame) -> DataFrame:
    by = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("wiki", "code", "case")]
    return merged.groupBy("query_id").agg(F.count("*").alias("citations"), *by, F.max("fusion_score").alias("best"))


def distinct_queries(queries: Column, most: int = 16) -> Column:
    """Texts with white space collapsed, the first of those that differ in case only, `most` at most."""
    flat = F.filter(F.transform(queries, lambda q: F.trim(F.regexp_replace(q, r"(?U)\s+", " "))), lambda q: q != "")
    none = F.array().cast("array<string>")
    return F.slice(F.aggregate(flat, none, lambda acc, q: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(q)), acc).otherwise(F.array_append(acc, q))), 1, most)


def evidence(citations: Column, *lists: Column) -> Column:
    """The citations, or where there are none all lists, one after the other."""
    return F.when(F.size(F.coalesce(citations, F.array())) > 0, citations).otherwise(F.concat(*lists))


def first_of_each(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The items without those that are the same as one before them."""
    return F.aggregate(items, F.slice(items, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda a: same(a, x)), acc).otherwise(F.concat(acc, F.array(x))))


def output(hits: Column, most: int = 4) -> Column:
    """The first of hits (structs with source_type, path, section) that differ in those three, `most` at most, in order."""
    key = lambda h: F.struct(*[F.coalesce(h[c], F.lit("")).alias(c) for c in ("source_type", "path", "section")])
    return F.slice(first_of_each(hits, lambda a, b: key(a) == key(b)), 1, most)


def by_source(hits: Column) -> Column:
    """struct(wiki, code, case): hits by source; what is neither code nor case counts as wiki."""
    of = lambda h: source_kind(h["source_type"])
    return F.struct(
        F.filter(hits, lambda h: ~of(h).isin("code", "case")).alias("wiki"), F.filter(hits, lambda h: of(h) == "code").alias("code"), F.filter(hits, lambda h: of(h) == "case").alias("case"),
    )
