"""Service metrics: turn flags, window summaries, failing queries, alerts and their suppression, log correlation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import contains_any
from sextant.operators.fusion import source_kind
from sextant.operators.statistics import percentiles


#: What an answer says that lacks evidence.
INSUFFICIENT = ("当前证据不足", "证据不足")
RATES = ("empty_response", "fallback", "insufficient", "exact_like_pass")


def turn_flags(turns: DataFrame, insufficient: tuple[str, ...] = INSUFFICIENT, required: int = 40) -> DataFrame:
    """turns (answer, citations, intent, status, generation_mode, fallback_reason) with what the metrics count; citations are
    structs with a source_type."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cited = F.coalesce("citations", F.array())
    of = lambda kind: F.size(F.filter(cited, lambda c: source_kind(c["source_type"]) == kind))
    flagged = turns.withColumns({
        "is_qa_turn": text("intent") == "knowledge_qa",
        "is_empty_response": F.startswith(text("fallback_reason"), F.lit("empty_answer")),
        "is_fallback": ~text("generation_mode").isin("", "llm"),
        "contains_insufficient": contains_any(text("answer"), list(insufficient)),
        "citation_count": F.size(cited),
        **{f"{kind}_citations": of(kind) for kind in ("wiki", "code", "case")},
    })
    long = F.length(F.regexp_replace(text("answer"), r"(?U)^\s+|\s+$", "")) >= required
    fine = F.col("is_qa_turn") & (text("status") == "completed") & ~F.col("is_empty_response") & ~F.col("contains_insufficient") & long & (F.col("citation_count") > 0)
    return flagged.withColumn("exact_like_pass", fine)


def turn_summary(flagged: DataFrame, since: Column, until: Column, mode: str = "compat") -> DataFrame:
    """One row over a look-back window of flagged turns (ts, latency_ms): the number of question turns, four rates, and the
    exact 95th percentile of question turns' latency. compat divides rates by all turns, qa_only by question turns. Without
    turns all are 0."""
    qa = F.col("is_qa_turn")
    columns = ("is_empty_response", "is_fallback", "contains_insufficient", "exact_like_pass")
    rate = lambda c: F.avg(F.when(F.lit(True) if mode == "compat" else qa, F.col(c).cast("double")))
    rates = [F.coalesce(rate(c), F.lit(0.0)).alias(f"{name}_rate") for name, c in zip(RATES, columns)]
    inside = flagged.where((F.col("ts") > since) & (F.col("ts") <= until))
    return _with_p95(inside.agg(F.count_if(qa).alias("sample_size"), *rates), inside.where(qa), F.col("latency_ms"), "p95_latency_ms")


def _with_p95(row: DataFrame, rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The one row with the exact 95th percentile of other rows' value beside it, 0 without any."""
    p95 = percentiles(rows.select(value.alias("v")), [], "v", 0.95)
    return row.join(F.broadcast(p95.select(F.coalesce("p", F.lit(0.0)).alias(name))))


def summary(events: DataFrame, since: Column, until: Column, is_qa: Column, value: Column, mode: str = "compat") -> DataFrame:
    """One row over a look-back window: counts, rates and the exact 95th percentile. compat divides rates by all turns,
    qa_only by question turns; the sample size counts question turns in both."""
    inside = events.where((F.col("ts") > since) & (F.col("ts") <= until))
    rate = (lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))) if mode == "compat" else (lambda c: F.avg(F.when(is_qa, F.when(c, 1.0).otherwise(0.0))))
    row = inside.agg(F.count_if(is_qa).alias("sample_size"), F.coalesce(rate(F.col("failed")), F.lit(0.0)).alias("fail_rate"), F.coalesce(rate(F.col("slow")), F.lit(0.0)).alias("slow_rate"))
    return _with_p95(row, inside.where(is_qa), value, "p95")


def top_failed(events: DataFrame, key: Column, failed: Column, n: int) -> DataFrame:
    """The groups with the most failures; groups without any are dropped after the limit, as the limit comes first."""
    by = events.groupBy(key.alias("key")).agg(F.count("*").alias("total"), F.count_if(failed).alias("fails"))
    return by.orderBy(F.desc("fails"), F.desc("total"), "key").limit(n).where("fails > 0")


@dataclass(frozen=True)
class Rule:
    alert: str
    metric: str
    threshold: float
    above: bool = True
    severity: str = "warning"


def alerts(metrics: DataFrame, rules: list[Rule], sample: str = "sample_size", least: int = 20) -> DataFrame:
    """One row for each rule that a row of metrics breaks, if its sample is large enough."""
    each = F.array(*[F.struct(F.lit(r.alert).alias("alert_type"), F.lit(r.severity).alias("severity"), F.lit(r.metric).alias("metric_name"), F.col(r.metric).cast("double").alias("metric_value"), F.lit(float(r.threshold)).alias("threshold"), F.lit(r.above).alias("above")) for r in rules])
    kept = [c for c in metrics.columns if c not in {r.metric for r in rules}]
    rows = metrics.where(F.col(sample) >= least).select(*kept, F.explode(each).alias("a")).select(*kept, "a.*")
    return rows.where(F.when(F.col("above"), F.col("metric_value") > F.col("threshold")).otherwise(F.col("metric_value") < F.col("threshold"))).drop("above")


#: Times of a key are cut into blocks of so many suppression windows (of a minute at least) each.
BLOCK_WINDOWS = 64
#: Before all times.
NEVER = -(2**62)


def _micros(ts: Column, kind: str) -> Column:
    """Microseconds since 1970; of a time without zone by the clock, whatever the session's zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(ts)
    seconds = F.unix_date(F.to_date(ts)).cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def _time_of(micros: Column, kind: str) -> Column:
    if kind != "timestamp_ntz":
        return F.timestamp_micros(micros)
    day, seconds = F.lit(86_400_000_000), (F.pmod(micros, F.lit(86_400_000_000)) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.date_from_unix_date(F.floor(micros / day).cast("int")).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def _successors(times: np.ndarray, span: int) -> np.ndarray:
    """For each time the place of the first one beyond its window; the number of times where there is none."""
    return np.append(np.searchsorted(times, times + span, side="right"), len(times))


def _block_ends(span: int) -> Callable[..., Column]:
    """A function of blocks (arrays of ascending times): where a run of emitted alerts that begins at a time ends, by doubling the
    successor pointers. Times next to each other with the same end are one entry: [[the largest of them, ...], [the end, ...]]."""

    @F.pandas_udf("array<array<bigint>>")
    def ends(blocks: pd.Series) -> pd.Series:
        out = []
        for times in map(np.asarray, blocks):
            n, to = len(times), _successors(times, span)
            last = np.arange(n + 1)
            while (to[:n] < n).any():
                last = last[np.where(to < n, to, last)]
                to = to[to]
            end = times[last[:n]]
            edge = np.append(end[1:] != end[:-1], True)
            out.append([times[edge].tolist(), end[edge].tolist()])
        return pd.Series(out)

    return ends


def _chained(span: int) -> Callable[..., Column]:
    """A function of a key's block ends in order: the last alert emitted before each block (NEVER where there is none)."""

    @F.pandas_udf("array<bigint>")
    def chained(keys: pd.Series) -> pd.Series:
        out = []
        for blocks in keys:
            last, before = NEVER, []
            for upto, end in blocks:
                before.append(last)
                at = int(np.searchsorted(upto, last + span, side="right"))
                last = int(end[at]) if at < len(upto) else last
            out.append(before)
        return pd.Series(out)

    return chained


def _emitted(span: int) -> Callable[..., Column]:
    """A function of blocks and the last alert emitted before each: the times that are emitted."""

    @F.pandas_udf("array<bigint>")
    def emitted(blocks: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for times, last in zip(map(np.asarray, blocks), before):
            to, kept = _successors(times, span), []
            at = int(np.searchsorted(times, last + span, side="right"))
            while at < len(times):
                kept.append(int(times[at]))
                at = int(to[at])
            out.append(kept)
        return pd.Series(out)

    return emitted


def suppress(candidates: DataFrame, minutes: int, key: str = "alert_type") -> DataFrame:
    """(key, ts) of the alerts that are emitted: one is held back if the last emitted one of its key is at most `minutes`
    before. Each emitted alert starts the window anew, so this is a fold over a key's times.

    A key's times are cut into blocks of BLOCK_WINDOWS windows. Each block works out by itself where a run that begins at any
    of its times ends; only these short lists are folded in a key's order, and each block then emits from where the run
    reaches it. So a key takes as many tasks as it has blocks, but for that fold. Repeated times count once; null times are
    left out, and null keys are a key of their own."""
    span, kind = minutes * 60_000_000, dict(candidates.dtypes)["ts"]
    times = candidates.where(F.col("ts").isNotNull()).select(F.col(key).alias("k"), _micros(F.col("ts"), kind).alias("at"))
    width = max(span, 60_000_000) * BLOCK_WINDOWS
    blocks = times.groupBy("k", F.floor(F.col("at") / width).cast("bigint").alias("block")).agg(F.array_sort(F.collect_set("at")).alias("at"))
    ends = blocks.select("k", F.struct("block", _block_ends(span)("at").alias("ends")).alias("b"))
    folded = ends.groupBy("k").agg(F.array_sort(F.collect_list("b")).alias("b"))
    before = folded.select(F.col("k").alias("k2"), F.explode(F.arrays_zip(F.col("b.block").alias("block"), _chained(span)(F.col("b.ends")).alias("last"))).alias("z"))
    placed = blocks.join(before.select("k2", "z.*").withColumnRenamed("block", "block2"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("block") == F.col("block2")))
    return placed.select(F.col("k").alias(key), F.explode(_emitted(span)("at", "last")).alias("ts")).withColumn("ts", _time_of(F.col("ts"), kind))


def turn_rules(empty: float, fallback: float, insufficient: float, p95: float, passed: float) -> list[Rule]:
    """The five checks of a summary of turns, each with its threshold."""
    return [
        Rule("empty_response_rate_high", "empty_response_rate", empty, severity="high"),
        Rule("fallback_rate_high", "fallback_rate", fallback, severity="medium"),
        Rule("insufficient_rate_high", "insufficient_rate", insufficient, severity="medium"),
        Rule("p95_latency_high", "p95_latency_ms", p95, severity="high"),
        Rule("exact_like_pass_rate_low", "exact_like_pass_rate", passed, above=False, severity="high"),
    ]


def alert_rows(violations: DataFrame, summary: DataFrame, window_minutes: int, at: Column) -> DataFrame:
    """Rows to append to a table of alerts: violations (alert_type, severity, metric_name, metric_value, threshold), open, with
    the (one-row) summary as JSON."""
    detail = F.to_json(F.struct(*[F.col(c) for c in summary.columns]))
    one = F.broadcast(summary.select(F.col("sample_size").alias("sample_size"), detail.alias("detail")))
    rows = violations.drop("sample_size").join(one)
    return rows.select(at.alias("created_at"), "alert_type", "severity", "metric_name", "metric_value", "threshold", F.lit(window_minutes).alias("window_minutes"), "sample_size", F.lit("open").alias("status"), "detail")


def not_recent(violations: DataFrame, emitted: DataFrame, minutes: int, now: Column) -> DataFrame:
    """Violations of types that have no open alert emitted within so many minutes."""
    recent = emitted.where((F.col("status") == "open") & (F.col("created_at") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))).select("alert_type").distinct()
    return violations.join(recent, "alert_type", "left_anti")


def snapshot_rows(summary: DataFrame, window_minutes: int, least: int = 20) -> DataFrame:
    """The row to append to a table of metrics: the summary, if its sample is large enough."""
    rates = [F.col(c) for c in summary.columns if c.endswith("_rate") or c == "p95_latency_ms"]
    payload = F.to_json(F.struct(*[F.col(c) for c in summary.columns]))
    return summary.where(F.col("sample_size") >= least).select(F.lit(window_minutes).alias("window_minutes"), "sample_size", *rates, payload.alias("payload"))


def newest(alerts_: DataFrame, n: int = 50) -> DataFrame:
    """The last alerts first, with defaults for what they lack."""
    return alerts_.orderBy(F.desc("created_at"), "alert_type").limit(max(1, n)).fillna({"metric_value": 0.0, "threshold": 0.0, "severity": "", "status": ""})


def node_latencies(spans: DataFrame) -> DataFrame:
    """spans (trace_id, node, ms) to one row a node: calls, mean, exact 95th percentile and share of all time."""
    by = spans.groupBy("node").agg(F.count("*").alias("calls"), F.avg("ms").alias("mean_ms"), F.sum("ms").alias("total"))
    p95 = percentiles(spans, ["node"], "ms", 0.95).select(F.col("node").alias("node2"), F.col("p").alias("p95_ms"))
    by = by.join(p95, F.col("node").eqNullSafe(F.col("node2"))).drop("node2")
    total = F.sum("total").over(Window.partitionBy(F.lit(1)))
    return by.select("node", "calls", "mean_ms", "p95_ms", F.when(total > 0, F.col("total") / total).otherwise(0.0).alias("share"))


LINE = r"^\s*([^|]*?)\s*\|\s*([A-Z]+)\s*\|\s*([^|]*?)\s*\|\s*(.*)$"


def parse_log(lines: DataFrame, fields: list[str], text: str = "value") -> DataFrame:
    """timestamp | level | event | JSON; a field that the JSON doesn't give is looked for by a pattern."""
    part = lambda i: F.regexp_extract(text, LINE, i)
    parsed = lines.select("*", part(1).alias("ts"), part(2).alias("level"), part(3).alias("event"), part(4).alias("payload")).where(F.col("event") != "")
    for f in fields:
        by_pattern = F.nullif(F.regexp_extract("payload", rf'"{f}"\s*:\s*"?([^",}}]*)', 1), F.lit(""))
        parsed = parsed.withColumn(f, F.coalesce(F.get_json_object("payload", f"$.{f}"), by_pattern))
    return parsed


def response_event(event: Column) -> Column:
    return F.when(event.endswith(".debug_request"), F.regexp_replace(event, r"\.debug_request$", ".debug_response")).otherwise(F.concat(event, F.lit(".response")))


#: Ranges of the order into which the rows of each key are dealt, and what edges are drawn with.
AS_OF_BLOCKS, AS_OF_ACCURACY = 64, 2048


def _blocks(events: DataFrame, order: str) -> Column:
    """The range, from 0, in which a row's order lies: ranges of about as many rows each, all rows of one order in one. Nulls
    come first; orders that are no numbers or times are one range."""
    kind, x = dict(events.dtypes)[order], F.col(order)
    if kind.startswith("timestamp"):
        number = _micros(x, kind).cast("double")
    elif kind == "date":
        number = F.unix_date(x).cast("double")
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        number = x.cast("double")
    else:
        return F.lit(0)
    edges = sorted(set(events.select(F.percentile_approx(number, [i / AS_OF_BLOCKS for i in range(1, AS_OF_BLOCKS)], AS_OF_ACCURACY)).first()[0] or []))

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(number < edges[mid], place(low, mid)).otherwise(place(mid + 1, high))

    return F.when(number.isNull(), 0).otherwise(place(0, len(edges)))


def _as_of(events: DataFrame, key: str, order: str, is_left: Column, is_right: Column, value: str, forward: bool) -> DataFrame:
    """Rows of a key are dealt to ranges of their order, so that a key with many rows takes many tasks. What the ranges before (or
    after) give is worked out on one small row a range and goes into each range as one more row: rows are shuffled once."""
    at = F.when(is_right, F.struct(F.col(order).alias("at"), F.col(value).alias("v")))
    rows = events.withColumn("_b", _blocks(events, order)).withColumn("_r", at).withColumn("_left", F.coalesce(is_left, F.lit(False)))
    best = F.min if forward else F.max
    each = rows.groupBy(key, "_b").agg(best("_r").alias("_c"))
    beside = Window.partitionBy(key).orderBy(F.desc("_b") if forward else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = each.withColumn("_c", best("_c").over(beside)).where(F.col("_c").isNotNull()).withColumn("_left", F.lit(False))
    all_ = rows.unionByName(carried, allowMissingColumns=True)
    block = Window.partitionBy(key, "_b")
    if forward:
        # Times are numbered, ties alike; later ones come first, so that the frame grows by what it has not seen.
        all_ = all_.withColumn("_t", F.dense_rank().over(block.orderBy(order)))
        frame = block.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, -1)
    else:
        frame = block.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.coalesce(best("_r").over(frame), best("_c").over(block))
    return all_.withColumn("matched", near["v"]).where("_left").select(*events.columns, "matched")


def next_matching(events: DataFrame, key: str, order: str, is_left: Column, is_right: Column, value: str) -> DataFrame:
    """Forward as-of join: for each left row the least value of the right rows of its key at the first later time. Rows of the
    same time aren't later. Null keys are one key; null times come before all others."""
    return _as_of(events, key, order, is_left, is_right, value, True)


def last_matching(events: DataFrame, key: str, order: str, is_left: Column, is_right: Column, value: str) -> DataFrame:
    """Backward as-of join: for each left row the largest value of the right rows of its key at the last time not after it.
    Rows of the same time count. Null keys are one key; null times come before all others."""
    return _as_of(events, key, order, is_left, is_right, value, False)


def responses(entries: DataFrame, optional: tuple[str, ...] = ("model", "module_name", "user_query_preview")) -> DataFrame:
    """Log entries (file, line, event, node_name, attempt, optional fields) as requests, each with the line of its response: the
    first later line of the file with the response's event, the same node and attempt, and the same optional fields where
    both have them.

    Which optional fields a side has is a mask. A request is looked up once for each mask that a response can have, by the fields
    of both masks, and a response is filed once for each mask that a request can have: a forward as-of join on equal keys, of
    2 ** len(optional) rows for each entry, however many requests and responses a file has."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("node_name", "attempt", *optional)]
    all_ = entries.select("file", "line", "event", *known)
    asked = all_.where(F.col("event").endswith(".debug_request")).withColumn("request_event", F.col("event")).withColumn("event", response_event(F.col("event")))
    own = sum((F.when(F.col(c) != "", 1 << i).otherwise(0) for i, c in enumerate(optional)), F.lit(0))
    both = F.col("own").bitwiseAND(F.col("other"))
    shared = [F.when(both.bitwiseAND(F.lit(1 << i)) > 0, F.col(c)).alias(c) for i, c in enumerate(optional)]

    def filed(side: DataFrame, is_request: bool) -> DataFrame:
        masks = side.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit((1 << len(optional)) - 1))))
        pair = [F.col("own" if is_request else "other").alias("request"), F.col("other" if is_request else "own").alias("response")]
        return masks.select("file", "line", F.struct("file", "event", "node_name", "attempt", *pair, *shared).alias("k"), F.lit(is_request).alias("is_request"))

    rows = filed(asked, True).unionByName(filed(all_, False))
    near = next_matching(rows, "k", "line", F.col("is_request"), ~F.col("is_request"), "line")
    found = near.groupBy("file", "line").agg(F.min("matched").alias("response_line"))
    return asked.join(found, ["file", "line"], "left").drop("event").withColumnRenamed("request_event", "event")


def trace_of(entries: DataFrame, start: str = "workflow.invoke.start") -> DataFrame:
    """Log entries (file, line, event, trace_id) with the trace of the last start at or before them."""
    w = Window.partitionBy("file").orderBy("line")
    return entries.withColumn("trace", F.last(F.when(F.col("event") == start, F.col("trace_id")), ignorenulls=True).over(w))
