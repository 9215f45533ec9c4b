"""Sources and sinks. Every reader has an explicit schema; nothing is inferred."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.operators.fusion import source_kind
from sextant.operators.understanding import PLACE_WORDS, Module, Profile, Template
from sextant.sources.store import BUCKETS, Store

#: What counts as code, and folders that don't.
CODE_SUFFIXES = ("py", "js", "ts", "tsx", "jsx", "java", "go", "rs", "cpp", "c", "h", "sql", "sh", "yaml")
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "dist", "build")
MOST_BYTES = 256 << 10


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all non-empty Markdown files below root."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.trim("value") != "")


def code(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of code files of MOST_BYTES at most, outside ignored folders."""
    glob = "*.{" + ",".join(CODE_SUFFIXES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    fine = (F.col("length") <= MOST_BYTES) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED)))
    return files.where(fine).select("path", F.expr("try_validate_utf8(cast(content as string))").alias("content")).where(F.col("content").isNotNull())


CASES = (
    "id string, query string, retrieval_queries array<string>, gold_paths array<string>, gold_wiki_paths array<string>, gold_code_paths array<string>, gold_sections array<string>, "
    "gold_symbols array<string>, expected_patterns array<string>, required_facts variant, forbidden_claims array<string>, expected_mode string, expected_sources array<string>, "
    "expected_code_symbols array<string>, hybrid_type string, expected_route string, expected_kind string, expected_status string, expected_module string, intent string, note string"
)
#: The defaults of fields that a case leaves empty.
DEFAULTS = {"expected_mode": "answer", "hybrid_type": "unknown", "expected_route": "issue_analysis", "expected_kind": "issue_analysis", "expected_status": "completed", "expected_module": "", "intent": "", "note": ""}


def _strings(c: str) -> Column:
    """Trimmed, without empty ones, each once."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of all kinds from JSON lines; a case without id or query is an error. Older files give the paths of
    documents as gold_paths. required_facts are groups of alternatives; a plain text is a group of one. Sources that aren't
    named follow from the gold paths."""
    rows = spark.read.schema(CASES).json(path)
    need = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.raise_error(F.lit(f"a case lacks {c}")).cast("string")).otherwise(F.trim(F.col(c)))
    wiki = F.when(F.col("gold_wiki_paths").isNotNull(), _strings("gold_wiki_paths")).otherwise(_strings("gold_paths"))
    code, named = _strings("gold_code_paths"), F.array_distinct(F.transform(_strings("expected_sources"), source_kind))
    inferred = F.array_compact(F.array(F.when(F.size(wiki) > 0, "wiki"), F.when(F.size(code) > 0, "code")))
    facts = F.coalesce(F.try_variant_get("required_facts", "$", "array<variant>"), F.array().cast("array<variant>"))
    one = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$", "string")))
    groups = F.filter(F.transform(facts, lambda v: F.filter(F.transform(one(v), lambda x: F.trim(x)), lambda x: x != "")), lambda g: F.size(g) > 0)
    lists = [_strings(c).alias(c) for c in ("retrieval_queries", "gold_sections", "gold_symbols", "expected_patterns", "forbidden_claims", "expected_code_symbols")]
    plain = [F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(v)).alias(c) for c, v in DEFAULTS.items()]
    return rows.select(
        need("id").alias("id"), need("query").alias("query"), F.array_distinct(F.concat(wiki, code)).alias("gold_paths"), wiki.alias("gold_wiki_paths"), code.alias("gold_code_paths"),
        F.when(F.size(named) > 0, named).otherwise(inferred).alias("expected_sources"), groups.alias("required_facts"), *lists, *plain,
    )


def profile(path: str) -> Profile:
    """A domain's profile from JSON, with the files of its prompts read in by `prompts`. JSON that can't be read, or isn't an
    object, is an error; fields that lack keep their defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} isn't JSON: {e}") from e
    if not isinstance(raw, dict):
        raise ValueError(f"{path} isn't a JSON object")
    gate, rewrite, answering = (raw.get(k) or {} for k in ("domain_gate", "query_rewrite", "answering"))
    words = rewrite.get("intent_terms") or {}
    some = lambda d, k: tuple(str(x).strip() for x in d.get(k) or () if str(x).strip())
    modules = [
        Module(str(m["name"]), int(m.get("route_priority", 100)), some(m, "keywords"), some(m, "aliases"), some(m, "symbol_keywords"), str(m.get("hint", "")), some(m, "wiki_hints"))
        for m in raw.get("modules") or () if isinstance(m, dict) and m.get("name")
    ]
    lists = lambda d: {str(k).lower(): tuple(map(str, v)) for k, v in (d or {}).items()}
    found = {
        "profile_id": raw.get("profile_id"), "domain_words": some(gate, "domain_terms"), "off_topic": some(gate, "offtopic_terms"), "greetings": some(gate, "small_talk_exact"),
        "greeting_parts": some(gate, "small_talk_substr"), "greeting_pattern": gate.get("laugh_like_regex"), "code_hint": gate.get("code_hint_regex"), "threshold": gate.get("threshold"),
        "weak_in_scope": gate.get("weak_in_scope_min_score"), "weak_code_hint": gate.get("weak_code_hint_min_score"), "history_bonus": gate.get("history_memory_bonus"),
        "off_topic_penalty": gate.get("offtopic_penalty"), "short_penalty": gate.get("short_query_penalty"), "short_most": gate.get("short_query_max_len"),
        "modules": tuple(modules), "default_module": (raw.get("routing") or {}).get("default_module"), "synonyms": lists(rewrite.get("synonyms")),
        "abbreviations": {str(k).lower(): str(v) for k, v in (rewrite.get("abbreviations") or {}).items()}, "symbol_aliases": lists(rewrite.get("symbol_aliases")),
        "templates": tuple(Template(some(t, "queries"), some(t, "trigger_all"), some(t, "trigger_any")) for t in rewrite.get("query_templates") or () if isinstance(t, dict)),
        "metric": some(words, "metric"), "pipeline": some(words, "pipeline"), "architecture": some(words, "architecture"), "trouble": some(words, "troubleshoot"),
        "code_words": some(words, "code"), "places": tuple(dict.fromkeys((*some(words, "code_location"), *PLACE_WORDS))), "bid_terms": some(answering, "bid_terms"),
        "file_templates": some(raw.get("code_generation") or {}, "file_templates"),
    }
    return Profile(**{k: v for k, v in found.items() if v not in (None, (), {}, "")})


def prompts(path: str) -> dict[str, str]:
    """The prompts of a profile: texts given in place, or those of the files that `..._path` names, beside the profile. The
    environment (SEXTANT_PROMPT_<NAME>) comes before both."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f).get("prompts") or {}
    out = {}
    for name, value in raw.items():
        if name.endswith("_path"):
            with open(os.path.join(os.path.dirname(path), value), encoding="utf-8") as f:
                out[name.removesuffix("_path")] = f.read().strip()
        else:
            out.setdefault(name, str(value))
    return out | {n: os.environ[v] for n in out if (v := f"SEXTANT_PROMPT_{n.upper()}") in os.environ}


def front_matter(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the front matter's plain keys as a map of texts without quotes (of repeated keys the last counts), and the
    body. `meta_value` reads a value as a type."""
    head = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*\n", 1)
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda x: F.split(x, r":\s*", 2)), lambda p: (F.size(p) == 2) & p[0].rlike(r"^\w+$"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q[0] == p[0]))
    plain = lambda x: F.regexp_replace(F.trim(x), r"^([\"'])(.*)\1$", "$2")
    return docs.withColumn("meta", F.map_from_entries(F.transform(last, lambda p: F.struct(p[0], plain(p[1]))))).withColumn("body", F.regexp_replace(text, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*\n", ""))


def meta_value(meta: Column, key: str, kind: str, default: object = None) -> Column:
    """A front matter's value as a type: boolean understands yes, no, on and off, array<string> a list in brackets."""
    raw = F.try_element_at(meta, F.lit(key))
    if kind == "boolean":
        low = F.lower(raw)
        read = F.when(low.isin("true", "yes", "on"), True).when(low.isin("false", "no", "off"), False)
    elif kind == "array<string>":
        read = F.when(raw.rlike(r"^\[.*\]$"), F.filter(F.transform(F.split(F.regexp_extract(raw, r"^\[(.*)\]$", 1), ","), lambda x: F.trim(x)), lambda x: x != ""))
        return read if default is None else F.coalesce(read, F.array(*map(F.lit, default)).cast(kind))
    else:
        read = raw.try_cast(kind)
    return read if default is None else F.coalesce(read, F.lit(default).cast(kind))


def tail(spark: SparkSession, path: str, pattern: str, n: int, out: str | None = None) -> DataFrame:
    """The last n matching lines of a log file, in order; written to `out` too, where it is given."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(F.col("value").rlike(pattern))
    last = lines.orderBy(F.desc("at")).limit(n).orderBy("at")
    if out is not None:
        last.select("value").coalesce(1).write.mode("overwrite").text(out)
    return last


#: What stands between the fields of a log line.
BAR = " | "


def log_lines(events: DataFrame) -> DataFrame:
    """events (ts, level, event, further columns) as lines: time, level, event and the further columns as JSON."""
    more = [c for c in events.columns if c not in ("ts", "level", "event")]
    payload = F.to_json(F.struct(*more)) if more else F.lit("{}")
    return events.select(F.concat_ws(BAR, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.upper("level"), "event", payload).alias("value"))


def append_log(events: DataFrame, path: str) -> None:
    """Appends events to a log: a folder of text files, a file for each partition and call, so that it rolls over by itself."""
    log_lines(events).write.mode("append").text(path)


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(f"{path}/feedback")


def write_report(report: DataFrame, path: str) -> None:
    """A small report (metrics, cases) as one JSON file, one object a row."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_pretty_json(report: DataFrame, path: str) -> None:
    """A whole report as one indented JSON array, in one file: a row at a time passes through one task. An empty report is an
    empty array."""
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in report.columns]), {"pretty": "true", "ignoreNullFields": "false"})
    _one_file(report, ["["], value, ["]"], path, ",\n")


def write_markdown(report: DataFrame, title: str, path: str) -> None:
    """A whole report as a Markdown table, in one file, in the order of its rows: a row at a time passes through one task."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, report.columns)), F.lit(" |"))
    head = [f"# {title}", "", f"| {' | '.join(report.columns)} |", f"| {' | '.join(['---'] * len(report.columns))} |"]
    _one_file(report, head, row, [], path)


def _one_file(report: DataFrame, head: list[str], row: Column, foot: list[str], path: str, between: str = "") -> None:
    """Lines before the rows, a text for each row in their order, lines after them. One task puts all in order,
    as one file needs, and sorts on disk where it must."""
    ends = [(i - len(head), x) for i, x in enumerate(head)] + [((1 << 62) + i, x) for i, x in enumerate(foot)]
    at = report.select(F.monotonically_increasing_id().alias("at"), row.alias("value"))
    whole = at.unionByName(report.sparkSession.createDataFrame(ends, "at bigint, value string"))
    last = F.lag("at").over(Window.orderBy("at"))
    is_row = lambda x: (x >= 0) & (x < 1 << 62)
    placed = whole.withColumn("begin", F.when(is_row(last) & is_row(F.col("at")), between).otherwise(""))
    placed.repartition(1).sortWithinPartitions("at").select(F.concat("begin", "value").alias("value")).write.mode("overwrite").text(path)


def markdown_table(report: DataFrame, title: str, most: int = 1000) -> str:
    """A small report as Markdown, its first rows on the driver; a last line tells if there are more (`write_markdown` writes
    all)."""
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [[show(v) for v in r] for r in report.limit(most + 1).collect()]
    lines = [report.columns, ["---"] * len(report.columns), *rows[:most]]
    more = ["", f"Only the first {most} rows are shown."] if len(rows) > most else []
    return "\n".join([f"# {title}", "", *(f"| {' | '.join(x)} |" for x in lines), *more])



#: The tables of the event log.
TABLES = {
    "requests": "trace_id string, created_at timestamp, conv_id string, query string, answer string, intent string, kind string, status string, latency_ms int, is_qa_turn boolean, is_empty_response boolean, is_fallback boolean, contains_insufficient boolean, exact_like_pass boolean",
    "evidence": "trace_id string, rank_no int, citation string",
    "feedback": "message_id string, conv_id string, trace_id string, helpful boolean, reason_tag string, comment string, rating int, payload string",
    "alerts": "created_at timestamp, alert_type string, severity string, metric_name string, metric_value double, threshold double, window_minutes int, sample_size bigint, status string, detail string",
    "snapshots": "window_minutes int, sample_size bigint, empty_response_rate double, fallback_rate double, insufficient_rate double, exact_like_pass_rate double, p95_latency_ms double, payload string",
    "sessions": "session_id string, title string, created_at timestamp, updated_at timestamp, status string, payload string",
}


def bootstrap(spark: SparkSession, path: str) -> list[str]:
    """Makes those tables of the event log that aren't there yet, empty, as Parquet under path; returns their names."""
    made = []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, schema in TABLES.items():
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")
            made.append(name)
    return made


def append_turns(turns: DataFrame, path: str) -> None:
    """Request rows, and one evidence row for each citation."""
    turns.drop("citations").write.mode("append").parquet(f"{path}/requests")
    turns.select("trace_id", F.posexplode("citations").alias("rank_no", "citation")).write.mode("append").parquet(f"{path}/evidence")


def save_vectors(vectors: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes a store anew, one vector for each item."""
    Store.create(vectors, path, "item_id", buckets)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return Store.open(spark, path).read()


def add_vectors(vectors: DataFrame, path: str) -> None:
    """Puts vectors into a store: new items are added, those that it has are replaced, so that adding twice changes nothing."""
    Store.open(vectors.sparkSession, path).upsert(vectors)


def delete_vectors(spark: SparkSession, items: DataFrame, path: str) -> None:
    """Takes the items (item_id) out of a store."""
    Store.open(spark, path).delete(items)


def relative(path: Column, root: str) -> Column:
    """A path below root without it; others, and paths with other separators, with slashes."""
    slashed, base = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(slashed, F.lit(base)), F.substr(slashed, F.lit(len(base) + 1))).otherwise(slashed)


def resolve(value: str, *roots: str) -> str:
    """The first of the roots under which a relative path exists, else the path under the first root."""
    if os.path.isabs(value):
        return value
    candidates = [os.path.join(r, value) for r in roots]
    return next((c for c in candidates if os.path.exists(c)), candidates[0])
