"""Query understanding: gating, intents, modules, rewriting. A profile holds all words; the expressions come from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions.text import contains_any, count_hits, normalize
from sextant.operators.fusion import distinct_queries, first_of_each


@dataclass(frozen=True)
class Module:
    name: str
    priority: int
    keywords: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    hint: str = ""
    doc_hints: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    """Queries to add where all of `all_of` and, if there are any, one of `any_of` are in a text."""

    queries: tuple[str, ...]
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()


#: What asks for a method instead of telling of an incident, and what tells of one.
METHOD_WORDS = (
    "怎么排查", "如何排查", "排查思路", "排查步骤", "排查手册", "排障手册", "排查方法", "排查流程", "排查建议", "怎么定位", "如何定位", "怎么处理", "如何处理",
    "how to troubleshoot", "troubleshooting steps", "troubleshoot guide", "how to locate", "how to fix",
)
DETAIL_WORDS = ("日志", "log", "trace", "stack", "request_id", "trace_id", "campaign", "adset", "线上", "离线", "告警", "报警", "timeout", "5xx", "4xx")
ISSUE_PATTERN = r"(?iU)(报错|错误|异常|失败|超时|告警|报警|traceback|error|exception|\b[45]\d{2}\b|panic|fatal)"
GENERATION_WORDS = ("给我代码", "给出代码", "直接给代码", "代码实现", "实现一个", "写一下代码", "补丁", "patch", "改代码", "修改代码", "直接修", "生成代码", "code snippet", "show me code", "write code")
CODE_HINT = r"[A-Za-z_][A-Za-z0-9_]{2,}\s*(\(|\.py\b|/)"
LAUGH = r"^[哈呵嘿啊嗯哦嗨~\s!！?？,，。…]+$"
#: Pronouns and words by which a short question leans on the one before it, and words for places in code.
PRONOUNS = ("它", "这个", "这个问题", "那个", "那这个", "这块", "这里", "上面这个", "it", "that", "this")
FOLLOW_UP_WORDS = ("对应", "这个", "上述", "上面", "这块", "这段")
PLACE_WORDS = ("代码在哪儿", "代码在哪", "代码位置", "实现在哪", "入口在哪", "哪个文件", "在哪个文件", "路径在哪", "哪一行", "line", "where is the code", "where is code")
CODE_ANCHORS = ("代码", "函数", "文件", "路径", "实现", "入口", "行号")
WHERE_ANCHORS = ("哪里", "在哪", "哪个", "哪一", "位置")


@dataclass(frozen=True)
class Profile:
    """The words and numbers of a domain, as data."""

    profile_id: str = "default"
    domain_words: tuple[str, ...] = ()
    code_words: tuple[str, ...] = ("class", "function", "def", "code", "file", "implement", "line")
    off_topic: tuple[str, ...] = ("weather", "joke", "recipe", "lottery")
    greetings: tuple[str, ...] = ("hi", "hello", "thanks", "bye")
    greeting_parts: tuple[str, ...] = ()
    greeting_pattern: str = LAUGH
    code_hint: str = CODE_HINT
    trouble: tuple[str, ...] = ("error", "fail", "timeout", "drop", "abnormal", "troubleshoot")
    metric: tuple[str, ...] = ("metric", "rate", "ctr", "roi")
    pipeline: tuple[str, ...] = ("pipeline", "flow", "stage")
    architecture: tuple[str, ...] = ("architecture", "overview", "design")
    places: tuple[str, ...] = PLACE_WORDS
    modules: tuple[Module, ...] = ()
    default_module: str = "general"
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    abbreviations: dict[str, str] = field(default_factory=dict)
    symbol_aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    templates: tuple[Template, ...] = ()
    bid_terms: tuple[str, ...] = ()
    file_templates: tuple[str, ...] = ("services/{profile_id}/{module_name}/handler.py", "tests/{profile_id}/{module_name}/test_handler.py")
    threshold: float = 0.5
    weak_in_scope: float = 0.62
    weak_code_hint: float = 0.58
    history_bonus: float = 0.18
    off_topic_penalty: float = 0.45
    short_penalty: float = 0.25
    short_most: int = 4


def small_talk(text: Column, p: Profile) -> Column:
    q = normalize(text)
    return (q == "") | q.isin(*p.greetings) | contains_any(q, list(p.greeting_parts)) | F.regexp_like(q, F.lit(rf"^(?:{p.greeting_pattern})\z"))


def asks_for_code(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), list(GENERATION_WORDS))


def gate(text: Column, p: Profile, from_history: Column | None = None, has_module: Column | None = None) -> Column:
    """struct(score, in_scope, reason). Domain words and a code hint add; one of either lifts to a floor, as a request for code
    does where a module is active; a topic from history adds. Off-topic and short texts without either lose, and are out of
    scope whatever is left."""
    q, raw = normalize(text), F.coalesce(text, F.lit(""))
    no = F.lit(False)
    hits, hint = count_hits(q, list(p.domain_words)), raw.rlike(p.code_hint)
    base = F.least(F.lit(1.0), 0.22 * hits + F.when(hint, 0.22).otherwise(0.0))
    base = F.when(hits > 0, F.greatest(base, F.lit(p.weak_in_scope))).otherwise(base)
    lifted = hint | (asks_for_code(raw) & F.coalesce(has_module, no) if has_module is not None else no)
    base = F.when(lifted, F.greatest(base, F.lit(p.weak_code_hint))).otherwise(base)
    if from_history is not None:
        base = F.when(F.coalesce(from_history, no), F.least(F.lit(1.0), base + p.history_bonus)).otherwise(base)
    outside = (hits == 0) & ~hint
    off = contains_any(q, list(p.off_topic)) & outside
    short = (F.length(F.replace(q, F.lit(" "), F.lit(""))) <= p.short_most) & outside
    talk = small_talk(text, p)
    score = F.when(talk, 0.0).when(off, F.greatest(F.lit(0.0), base - p.off_topic_penalty)).when(short, F.greatest(F.lit(0.0), base - p.short_penalty)).otherwise(base)
    reason = F.when(talk, "small_talk").when(off, "offtopic").when(short, "short_non_domain").otherwise("scored")
    return F.struct(score.alias("score"), (~talk & ~off & ~short & (base >= p.threshold)).alias("in_scope"), reason.alias("reason"))


def relevance(text: Column, p: Profile, from_history: Column | None = None, has_module: Column | None = None) -> Column:
    return gate(text, p, from_history, has_module)["score"]


def incident_detail(text: Column) -> Column:
    """Whether a text gives a detail of an incident: such a word, a number or a time."""
    q = normalize(text)
    return contains_any(q, list(DETAIL_WORDS)) | q.rlike(r"(?U)\d")


def generic_trouble(text: Column, p: Profile) -> Column:
    """Whether a text asks how to look for trouble, without telling of any."""
    q = normalize(text)
    return contains_any(q, [w.lower() for w in p.trouble]) & contains_any(q, list(METHOD_WORDS)) & ~incident_detail(text)


def intent(text: Column, p: Profile, scope: Column | None = None) -> Column:
    """code_generation, issue_analysis, knowledge_qa; out_of_scope where `scope` (what gate returns) says so."""
    q = normalize(text)
    trouble = contains_any(q, [w.lower() for w in p.trouble]) & ~generic_trouble(text, p)
    route = F.when(asks_for_code(text), "code_generation").when(q.rlike(ISSUE_PATTERN) | trouble, "issue_analysis").otherwise("knowledge_qa")
    return route if scope is None else F.when(~scope["in_scope"], "out_of_scope").otherwise(route)


def asks_for_place(text: Column, p: Profile) -> Column:
    return contains_any(normalize(text), [w.lower() for w in p.places])


def flags(text: Column, p: Profile) -> Column:
    q = normalize(text)
    return F.struct(contains_any(q, list(p.metric)).alias("metric"), contains_any(q, list(p.pipeline)).alias("pipeline"), contains_any(q, list(p.architecture)).alias("architecture"), contains_any(q, list(p.trouble)).alias("troubleshoot"), contains_any(q, list(p.code_words)).alias("code"), asks_for_place(text, p).alias("code_location"))


def module_scores(text: Column, p: Profile) -> Column:
    """array<struct<by_symbol, score, order, name>>, one for each module of the profile."""
    q = normalize(text)
    each = []
    for m in p.modules:
        words = count_hits(q, [w.lower() for w in (*m.keywords, *m.aliases)])
        symbols = count_hits(q, [s.lower() for s in m.symbols])
        each.append(F.struct((symbols > 0).alias("by_symbol"), words.alias("words"), symbols.alias("symbols"), F.lit(-m.priority).alias("order"), F.lit(m.name).alias("name")))
    return F.array(*each)


def module(text: Column, p: Profile) -> Column:
    """By symbol first, then by words, ties to the lower priority number; the default where nothing matches."""
    if not p.modules:
        return F.lit(p.default_module)
    all_ = F.filter(module_scores(text, p), lambda m: m["by_symbol"] | (m["words"] > 0))
    best = F.array_max(F.transform(all_, lambda m: F.struct(m["by_symbol"], F.when(m["by_symbol"], 0).otherwise(m["words"]).alias("w"), m["order"], m["name"])))
    return F.coalesce(best["name"], F.lit(p.default_module))


def related_modules(text: Column, p: Profile, most: int = 2) -> Column:
    scored = F.transform(module_scores(text, p), lambda m: F.struct((-(m["words"] + 2 * m["symbols"])).alias("s"), (-m["order"]).alias("p"), m["name"].alias("name")))
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda m: m["s"] < 0)), 1, most), lambda m: m["name"])


def module_table(p: Profile, spark: SparkSession) -> DataFrame:
    """The modules as a small dimension: (name, hint, aliases, doc_hints, priority, is_default)."""
    rows = [(m.name, m.hint, list(m.aliases), list(m.doc_hints), m.priority, m.name == p.default_module) for m in p.modules]
    return spark.createDataFrame(rows, "name string, hint string, aliases array<string>, doc_hints array<string>, priority int, is_default boolean")


def module_hint(name: Column, p: Profile) -> Column:
    known = {m.name: m.hint for m in p.modules}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), name), F.lit("")) if known else F.lit("")


def alias_queries(name: Column, p: Profile) -> Column:
    """A module's other names; none for a module that the profile lacks."""
    out = F.array().cast("array<string>")
    for m in p.modules:
        out = F.when(name == m.name, F.array(*map(F.lit, m.aliases)).cast("array<string>")).otherwise(out)
    return out


def _each(condition: Column, items: tuple[str, ...]) -> Column:
    return F.when(condition, F.array(*map(F.lit, items)).cast("array<string>")).otherwise(F.array().cast("array<string>"))


def symbol_queries(text: Column, p: Profile) -> Column:
    """Symbols that stand for phrases in the text."""
    low = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    return F.concat(F.array().cast("array<string>"), *[_each(F.contains(low, F.lit(phrase)), names) for phrase, names in p.symbol_aliases.items()])


def template_queries(text: Column, p: Profile) -> Column:
    low = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    out = [F.array().cast("array<string>")]
    for t in p.templates:
        met = F.lit(True)
        for w in t.all_of:
            met = met & F.contains(low, F.lit(w.lower()))
        if t.any_of:
            met = met & contains_any(low, [w.lower() for w in t.any_of])
        out.append(_each(met, t.queries))
    return F.concat(*out)


def expand(base: Column, text: Column, p: Profile, most: int = 20) -> Column:
    """The base queries, and after them: for each synonym group with a name in the text all its names, and what each
    abbreviation in the base queries is short for. White space is collapsed; of queries alike but for case the first stays."""
    low, merged = F.trim(F.lower(F.coalesce(text, F.lit("")))), F.lower(F.array_join(base, " "))
    synonyms = [_each(contains_any(low, [anchor, *names]), (anchor, *names)) for anchor, names in p.synonyms.items()]
    short = [_each(F.contains(merged, F.lit(a)), (full,)) for a, full in p.abbreviations.items()]
    return distinct_queries(F.concat(base, *synonyms, *short), most)


#: What is asked besides the question itself.
ISSUE_QUERIES = ("%s 异常日志", "%s 排查案例", "%s 联调排障")
PLAIN_QUERY, DESIGN_QUERY = "%s 业务说明", "%s 设计背景 业务口径"
RETRY_WIKI = ("%m 核心链路 关键指标", "%m 业务口径 常见问题", "%q 指标 口径 流程")
RETRY_CODE = ("%m 实现 入口 函数", "%m 关键参数 校验", "%q 代码位置 文件路径")


def _named(template: str, name: Column) -> Column:
    before, after = template.split("%s")
    return F.concat(F.lit(before), name, F.lit(after))


def base_queries(text: Column, route: Column, name: Column, related: Column, p: Profile) -> Column:
    """What is searched for, before expansion. An issue asks for the module's logs and cases too, and by its other names where
    the text is about a flow or a design; other questions ask by symbols, templates and two other names of the module, or
    for its description where the text says nothing else. Related modules (an array of names) add theirs, two each."""
    f = flags(text, p)
    none = F.array().cast("array<string>")
    others = F.coalesce(F.flatten(F.transform(F.slice(F.coalesce(related, none), 1, 2), lambda m: F.concat(F.array(m), F.slice(alias_queries(m, p), 1, 2)))), none)
    issue = F.concat(F.array(text, *[_named(t, name) for t in ISSUE_QUERIES]), F.when(f["pipeline"] | f["architecture"], alias_queries(name, p)).otherwise(none), others)
    some = f["pipeline"] | f["architecture"] | f["metric"] | f["troubleshoot"] | f["code"] | f["code_location"]
    plain = F.concat(
        F.array(text), symbol_queries(text, p), template_queries(text, p), F.when(some, F.slice(alias_queries(name, p), 1, 2)).otherwise(none), others,
        F.when(~some, F.array(_named(PLAIN_QUERY, name))).otherwise(none), F.when(route == "code_generation", F.array(_named(DESIGN_QUERY, name))).otherwise(none),
    )
    return F.when(F.coalesce(route == "issue_analysis", F.lit(False)), issue).otherwise(plain)


def retry_queries(queries: Column, text: Column, name: Column, templates: tuple[str, ...] = RETRY_WIKI) -> Column:
    """Queries for a second search: those of the first, and the templates with the module (%m) and the question (%q)."""
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("%m"), F.trim(F.coalesce(name, F.lit("")))), F.lit("%q"), F.trim(F.coalesce(text, F.lit(""))))
    return distinct_queries(F.concat(queries, F.array(*map(fill, templates))))


def code_paths(name: Column, p: Profile) -> Column:
    """Where a module's generated code goes."""
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{module_name}"), name), F.lit("{profile_id}"), F.lit(p.profile_id))
    return F.array(*map(fill, p.file_templates))


#: Words of a question for documents, the depths of each strategy, the weights and quotas of sources.
WIKI_WORDS = ["架构", "流程", "阶段", "指标", "口径", "规则", "原理", "背景", "说明"]
DEPTHS = {"hybrid": (4, 4, 2, 6), "wiki_first": (6, 2, 1, 6), "code_first": (2, 7, 1, 6)}
SOURCE_WEIGHTS = {"wiki": 1.0, "code": 1.0, "case": 0.6}
QUOTAS = {"wiki": 4, "code": 4, "case": 1}


def retrieval_plan(text: Column, route: Column, p: Profile) -> Column:
    """struct(strategy, wiki_top_k, code_top_k, case_top_k, final_top_k, weights, quotas, reasons) for each query. Questions
    for a place in code, or for code and nothing else, go to code first; those for documents only to documents first. The
    analysis of an issue looks deeper and weighs code more. Null texts count as empty."""
    q, f = normalize(text), flags(text, p)
    wiki = f["architecture"] | f["pipeline"] | f["metric"] | contains_any(q, WIKI_WORDS)
    code, issue = f["code"], F.coalesce(route == "issue_analysis", F.lit(False))
    code_first = f["code_location"] | (code & ~wiki)
    wiki_first = ~code_first & wiki & ~code

    def pick(of_code: object, of_wiki: object, of_both: object) -> Column:
        return F.when(code_first, F.lit(of_code)).when(wiki_first, F.lit(of_wiki)).otherwise(F.lit(of_both))

    def depth(i: int) -> Column:
        return pick(DEPTHS["code_first"][i], DEPTHS["wiki_first"][i], DEPTHS["hybrid"][i])

    w, n = SOURCE_WEIGHTS, QUOTAS
    code_weight = pick(max(w["code"], 1.2), min(w["code"], 0.9), w["code"])
    weights = F.struct(
        pick(min(w["wiki"], 0.9), max(w["wiki"], 1.15), w["wiki"]).alias("wiki"),
        F.when(issue, F.greatest(code_weight, F.lit(1.15))).otherwise(code_weight).alias("code"),
        F.lit(w["case"]).alias("case"),
    )
    quotas = F.struct(pick(min(n["wiki"], 2), n["wiki"], n["wiki"]).alias("wiki"), pick(max(n["code"], 4), n["code"], n["code"]).alias("code"), F.lit(n["case"]).alias("case"))
    reasons = F.array(pick("query_prefers_code", "query_prefers_wiki", "query_is_hybrid"))
    return F.struct(
        pick("code_first", "wiki_first", "hybrid").alias("strategy"),
        F.when(issue, F.greatest(depth(0), F.lit(3))).otherwise(depth(0)).alias("wiki_top_k"),
        F.when(issue, F.greatest(depth(1), F.lit(6))).otherwise(depth(1)).alias("code_top_k"),
        depth(2).alias("case_top_k"),
        depth(3).alias("final_top_k"),
        weights.alias("weights"),
        quotas.alias("quotas"),
        F.when(issue, F.array_append(reasons, F.lit("issue_analysis_bias_code"))).otherwise(reasons).alias("reasons"),
    )


#: Words of questions for a formula, a reason, a list.
FORMULA_WORDS = ("公式", "怎么算", "如何计算", "计算方式", "calculate", "formula", "bid")
REASON_WORDS = ("为什么", "为何", "原因", "how to", "why")
LIST_QUESTION_WORDS = ("有哪些", "哪些", "包括什么", "包含什么", "分别是", "列出", "清单")


def question_type(text: Column, p: Profile | None = None) -> Column:
    q = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    formula = [*FORMULA_WORDS, *(p.bid_terms if p else ())]
    return F.when(contains_any(q, formula), "formula").when(contains_any(q, list(REASON_WORDS)), "reason").when(contains_any(q, list(LIST_QUESTION_WORDS)), "list").otherwise("general")


def with_previous(turns: DataFrame) -> DataFrame:
    """User turns with the conversation's user text before them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.where(F.col("role") == "user").withColumn("previous", F.lag("text").over(w))


def last_where(turns: DataFrame, condition: Column) -> DataFrame:
    """The last turn of each conversation for which the condition holds."""
    return turns.where(condition).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


NO_HISTORY = "暂无历史用户提问"


def history_summary(turns: DataFrame, most: int = 4, chars: int = 24) -> DataFrame:
    """The last questions of each conversation, cut and side by side; a fixed text for conversations without any."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.where(F.col("role") == "user").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    by = last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("t")))), lambda x: x["t"]), " / ").alias("summary"))
    return turns.select("conv_id").distinct().join(by, "conv_id", "left").fillna({"summary": NO_HISTORY})


def leans_on_history(text: Column, p: Profile) -> Column:
    """Whether a text looks like a short question about what was asked before."""
    q = normalize(text)
    compact = F.length(F.replace(q, F.lit(" "), F.lit("")))
    anchored = contains_any(q, list(CODE_ANCHORS)) & contains_any(q, list(WHERE_ANCHORS)) & (compact <= 16)
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), list(PRONOUNS)) | ((compact > 0) & (asks_for_place(text, p) | anchored))


def has_target(text: Column, p: Profile) -> Column:
    """Whether a text itself names a module or code."""
    named = (module(text, p) != p.default_module) | (F.size(related_modules(text, p, 1)) > 0) if p.modules else F.lit(False)
    return named | F.coalesce(text, F.lit("")).rlike(CODE_HINT)


#: What is put after the question before, by what a follow-up asks for: (words of a thing, words of a place, text).
ACTIONS = (
    (("文件", "路径"), ("哪里", "在哪"), "对应的文件路径在哪里"),
    (("函数",), ("哪里", "在哪", "哪个"), "对应的函数在哪里"),
    (("实现",), ("哪里", "在哪"), "对应的代码实现在哪里"),
    (("代码",), ("哪里", "在哪"), "对应的代码在哪里"),
)


def follow_up(text: Column, previous: Column, p: Profile, most: int = 24) -> Column:
    """A question for a place in code that names no target of its own is put after the question before it, if it is short or
    refers to it; all others stay."""
    raw, q = F.trim(F.coalesce(text, F.lit(""))), normalize(text)
    target = F.regexp_replace(F.trim(F.coalesce(previous, F.lit(""))), r"[，,。.!！?？；;]+$", "")
    short = F.length(F.replace(q, F.lit(" "), F.lit(""))) <= most
    refers = contains_any(q, list(FOLLOW_UP_WORDS)) | contains_any(F.lower(raw), list(PRONOUNS))
    action = raw
    for things, places, said in reversed(ACTIONS):
        action = F.when(contains_any(q, list(things)) & contains_any(q, list(places)), said).otherwise(action)
    rewrite = asks_for_place(text, p) & ~has_target(text, p) & (short | refers) & (target != "") & (action != "")
    return F.when(rewrite, F.concat(target, F.lit("，"), action)).otherwise(raw)


def merge_related(before: Column, now: Column, primary: Column, most: int = 2) -> Column:
    """Related modules of the conversation, then those of the text, without the primary one, each once."""
    none = F.array().cast("array<string>")
    all_ = F.filter(F.transform(F.concat(F.coalesce(before, none), F.coalesce(now, none)), lambda m: F.trim(m)), lambda m: (m != "") & (F.lower(m) != F.lower(F.trim(primary))))
    return F.slice(first_of_each(all_, lambda a, b: F.lower(a) == F.lower(b)), 1, most)


def carry_over(turns: DataFrame, p: Profile) -> DataFrame:
    """User turns with their topic. turns: (conv_id, turn, role, kind, intent, text, module, related), where the last two are
    what an answer's analysis was about. The module of the last analysed issue, else of the last answer, is active; a
    question that leans on it keeps it, with the related modules last seen, others take their own. Adds question (rewritten
    where it is a follow-up), module_name, module_hint, related_modules and topic_source."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    answer = F.col("role") == "assistant"
    last = lambda condition, value: F.last(F.when(answer & condition, value), ignorenulls=True).over(w)
    issue = last((F.col("kind") == "issue_analysis") & F.col("module").isNotNull(), F.col("module"))
    qa = last(F.col("intent") == "knowledge_qa", F.coalesce("module", F.lit("")))
    before = F.last(F.when((F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != ""), F.trim("text")), ignorenulls=True).over(w)
    seen = turns.withColumns({"_active": F.coalesce(issue, qa, F.lit("")), "_before": before, "_related": last(F.size(F.coalesce("related", F.array().cast("array<string>"))) > 0, F.col("related"))})
    asked = seen.where(F.col("role") == "user").withColumn("question", follow_up(F.col("text"), F.col("_before"), p))
    own = module(F.col("question"), p)
    keep = (F.col("_active") != "") & (leans_on_history(F.col("question"), p) | (asks_for_place(F.col("question"), p) & (own == p.default_module)))
    asked = asked.withColumn("_keep", keep).withColumn("module_name", F.when(F.col("_keep"), F.col("_active")).otherwise(own))
    related = related_modules(F.col("question"), p, len(p.modules)) if p.modules else F.array().cast("array<string>")
    mine = merge_related(F.array().cast("array<string>"), related, F.col("module_name"))
    asked = asked.withColumn("related_modules", F.when(F.col("_keep"), merge_related(F.col("_related"), mine, F.col("module_name"))).otherwise(mine))
    asked = asked.withColumn("module_hint", module_hint(F.col("module_name"), p)).withColumn("topic_source", F.when(F.col("_keep"), "history_memory").otherwise("current_query"))
    return asked.drop("_active", "_before", "_related", "_keep", "module", "related")


def match_skill(queries: DataFrame, triggers: DataFrame, text: str = "text") -> DataFrame:
    """The first skill (by ord) with a trigger in the text: triggers (skill, keyword, pattern, ord, enabled), of which the last
    three columns but ord may lack. A keyword is contained in the normalised text, a pattern matches the text. Triggers are a
    dimension in one row, whose size is that of the catalogue."""
    have = set(triggers.columns)
    on = triggers.where(F.coalesce("enabled", F.lit(True))) if "enabled" in have else triggers
    pattern = F.col("pattern") if "pattern" in have else F.lit(None).cast("string")
    rows = F.broadcast(on.agg(F.collect_list(F.struct("ord", "skill", F.lower("keyword").alias("keyword"), pattern.alias("pattern"))).alias("ts")))
    met = lambda t: F.coalesce((t["keyword"] != "") & F.contains(normalize(F.col(text)), t["keyword"]), F.lit(False)) | F.coalesce(F.regexp_like(F.col(text), t["pattern"]), F.lit(False))
    return queries.join(rows).withColumn("skill", F.array_min(F.filter("ts", met))["skill"]).drop("ts")
