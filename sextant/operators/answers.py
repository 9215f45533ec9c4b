"""Answer assembly and text analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import contains_any, normalize
from sextant.operators.fusion import by_source, evidence, output, source_key, source_kind

#: What names a request, a time and a signal of trouble in a question.
IDENTIFIER = r"(?iU)\b(?:request_id|trace_id|campaign_id|job_id|task_id|order_id)\s*[:=]\s*([A-Za-z0-9_\-]+)\b"
TIME_HINT = r"(?iU)(\b\d{1,2}:\d{2}\b|\b\d{4}-\d{1,2}-\d{1,2}\b|\b近\d+\s*(?:分钟|小时|天)\b)"
SIGNAL = r"(?iU)(报错|错误|异常|失败|超时|timeout|exception|traceback|告警|报警|\b[45]\d{2}\b)"


def strip_item(text: Column) -> Column:
    """A line without its list mark and the marks around it; empty for headings."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s*(?:[-*]\s+|\d+[.)、]\s+)(.+)$", "$1"))
    return F.when(F.startswith(plain, F.lit("#")), "").otherwise(F.regexp_replace(plain, r"^[ \t\-*：:]+|[ \t\-*：:]+$", ""))


def distinct_items(items: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(items, strip_item), lambda x: x != "")), 1, most)


def symptoms(text: Column) -> Column:
    """struct(ids, times, signals, excerpt): distinct in order, 4, 4 and 5 at most. Null counts as empty."""
    text = F.trim(F.coalesce(text, F.lit("")))
    found = lambda pattern, most: distinct_items(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), most)
    return F.struct(found(IDENTIFIER, 4).alias("ids"), found(TIME_HINT, 4).alias("times"), found(SIGNAL, 5).alias("signals"), F.substring(text, 1, 140).alias("excerpt"))


def anchors(hits: Column) -> Column:
    """Names by which an answer can mention its evidence: path, file name, title, section and symbol of three letters or
    more. hits is an array of structs with those fields."""
    each = F.transform(hits, lambda h: F.array(h["path"], F.element_at(F.split(h["path"], "/"), -1), h["title"], h["section"], h["symbol_name"]))
    return F.array_distinct(F.filter(F.transform(F.flatten(each), lambda a: F.lower(F.coalesce(a, F.lit("")))), lambda a: F.length(a) >= 3))


def mentions(answer: Column, names: Column) -> Column:
    return F.exists(names, lambda a: F.contains(F.lower(answer), a))


def confidence(best: Column, sources: Column, hits: Column) -> Column:
    return F.when((best >= 0.75) & (sources >= 2), "high").when((best >= 0.6) & (hits >= 2), "medium").otherwise("low")


#: The titles of appended lists, and what tells that a model has written down its reasoning.
LIST_TITLES = {"list": "要点清单", "reason": "主要原因", "formula": "公式与关键变量"}
REASONING = ["chain of thought", "reasoning", "思考过程", "推理过程", "analysis:"]


def as_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def numbered(text: Column, kind: Column, most: int = 4) -> Column:
    """The answer to a question for a list, a reason or a formula with its first sentences as a numbered list below, unless it
    has a list already; other answers as they are."""
    text = F.coalesce(text, F.lit(""))
    parts = F.filter(F.transform(F.split(text, r"[。\n,，!?！？]"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    title = F.try_element_at(F.create_map(*[F.lit(x) for p in LIST_TITLES.items() for x in p]), kind)
    plain = (text == "") | title.isNull() | text.rlike(r"(?mU)^\s*(?:\d+\.|[-*])\s+") | (F.size(parts) == 0)
    return F.when(plain, text).otherwise(F.concat(text, F.lit("\n\n**"), title, F.lit("**\n"), as_list(F.slice(parts, 1, most))))


def reasoning_dump(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), REASONING)


def rejected(answer: Column) -> Column:
    """Why a model's answer can't be used: empty_answer, empty_answer:reasoning_dump, or null if it can."""
    empty = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)\s+", "") == ""
    return F.when(empty, "empty_answer").when(reasoning_dump(answer), "empty_answer:reasoning_dump")


def valid(answer: Column, names: Column) -> Column:
    """Usable, and naming some evidence."""
    return rejected(answer).isNull() & F.coalesce(mentions(answer, names), F.lit(False))


def choose(answer: Column, names: Column, fallback: Column) -> Column:
    return F.when(valid(F.coalesce(answer, F.lit("")), names), answer).otherwise(fallback)


def evidence_block(hits: Column, most: int = 6) -> Column:
    """Hits as a prompt shows them, a line for each thing known; none without hits."""
    line = lambda name, x: F.concat(F.lit(f"- {name}: "), F.coalesce(x.cast("string"), F.lit("")))

    def one(h: Column, i: Column) -> Column:
        code = source_kind(h["source_type"]) == "code"
        known = [F.concat(F.lit("[evidence_"), (i + 1).cast("string"), F.lit("]")), line("source_type", source_key(h["source_type"]))]
        known += [line(c, h[c]) for c in ("title", "path", "section", "score")]
        more = [F.when(F.trim(F.coalesce(h["excerpt"], F.lit(""))) != "", line("excerpt", F.trim(h["excerpt"]))), F.when(code, line("symbol_name", h["symbol_name"]))]
        lines = F.concat(F.coalesce(h["start_line"].cast("string"), F.lit("")), F.lit("-"), F.coalesce(h["end_line"].cast("string"), F.lit("")))
        return F.array_compact(F.array(*known, *more, F.when(code & (lines != "-"), F.concat(F.lit("- line_range: "), lines))))

    shown = F.flatten(F.transform(F.slice(hits, 1, most), one))
    return F.when(F.size(shown) > 0, F.array_join(shown, "\n")).otherwise("none")


def judged(text: Column) -> Column:
    """struct(score, passed, risk, reason) of a judge's JSON: the text, or what is between its first and last brace. Without
    text, or without JSON, the score is 0, the risk 1, and the reason says so."""
    text = F.trim(F.coalesce(text, F.lit("")))
    inner = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
    read = F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(inner, F.lit(""))))
    field = lambda name, kind: F.try_variant_get(read, f"$.{name}", kind)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    why = F.when(text == "", "empty_llm_output").when(read.isNull(), "invalid_llm_json").otherwise(F.trim(F.coalesce(field("reason", "string"), F.lit(""))))
    return F.struct(
        unit(field("score", "double")).alias("score"), F.coalesce(field("pass", "boolean"), F.lit(False)).alias("passed"),
        F.when(read.isNull(), 1.0).otherwise(unit(field("hallucination_risk", "double"))).alias("risk"), why.alias("reason"),
    )


def judge_score(text: Column) -> Column:
    """The score of a judge's JSON, clamped to 0..1; 0 where there is none."""
    return judged(text)["score"]


def sections(text: Column, names: list[str]) -> Column:
    """map(name -> lines under the heading of that name)."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    heading = lambda x: F.regexp_replace(normalize(x), r"^[#*\s]+|[:：*\s]+$", "")
    start = F.struct(F.lit("").alias("at"), F.array().cast("array<struct<s:string,l:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        head = heading(x)
        item = F.regexp_replace(x, r"^\s*([-*+]|\d+[.)])\s+", "")
        keep = (acc["at"] != "") & (item != "")
        return F.when(head.isin(*names), F.struct(head.alias("at"), acc["out"].alias("out"))).otherwise(F.struct(acc["at"].alias("at"), F.when(keep, F.array_append(acc["out"], F.struct(acc["at"].alias("s"), item.alias("l")))).otherwise(acc["out"]).alias("out")))

    rows = F.aggregate(lines, start, step, lambda acc: acc["out"])

    def under(name: str) -> Column:
        return F.transform(F.filter(rows, lambda r: r["s"] == name), lambda r: r["l"])

    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(under, names)))


#: What headings of an issue's analysis begin with, and how many items each list keeps.
HEADINGS = {
    "root_cause": ["根因判断", "根因", "结论"],
    "risks": ["风险提示", "风险"],
    "fix_plan": ["修复建议", "修复方案", "处理建议", "建议"],
    "verification_steps": ["验证步骤", "验证", "回归验证"],
}
MOST_ITEMS = {"risks": 3, "fix_plan": 4, "verification_steps": 3}
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def issue_sections(text: Column) -> Column:
    """struct(root_cause, risks, fix_plan, verification_steps) read from a model's analysis of an issue. A line that begins with
    a heading opens its section, and what follows on that line is its first item. The first item of the root cause counts; its
    later lines, and lines before any heading, are spare sentences, which fill what was not found: the first is the root
    cause, those after it risks and plan, the last two the checks. Lists are distinct in order and bounded (MOST_ITEMS); what
    isn't found is an empty string or list. Null counts as empty. The work is linear in the text's lines."""
    label = "^(" + "|".join(x for labels in HEADINGS.values() for x in labels) + ")"
    section = F.create_map(*[F.lit(x) for name, labels in HEADINGS.items() for x in (v for one in labels for v in (one, name))])
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda x: strip_item(strip(x))), lambda x: x != "")

    def row(item: Column, found: Column) -> Column:
        rest = strip(F.regexp_replace(F.substr(item, F.length(found) + 1), "^[：:]+", ""))
        return F.struct(F.try_element_at(section, found).alias("section"), F.when(found == "", item).otherwise(rest).alias("text"))

    rows = F.transform(items, lambda x: _let(F.regexp_extract(x, label, 1), lambda found: row(x, found)))
    heads = lambda r: F.filter(F.transform(r, lambda x, i: F.struct(i.alias("at"), x["section"].alias("section"))), lambda x: x["section"].isNotNull())

    def parts(r: Column, h: Column) -> Column:
        until = lambda k: F.coalesce(F.get(h, k)["at"], F.size(r))
        each = F.transform(h, lambda x, k: F.struct(x["section"].alias("section"), F.slice(r, x["at"] + 1, until(k + 1) - x["at"]).alias("rows")))
        return F.struct(F.slice(r, 1, until(F.lit(0))).alias("lead"), each.alias("each"))

    def of(p: Column, name: str) -> Column:
        return F.filter(F.flatten(F.transform(F.filter(p["each"], lambda s: s["section"] == name), lambda s: s["rows"])), lambda x: x["text"] != "")

    words = lambda r: F.transform(r, lambda x: x["text"])

    def read(p: Column, cause: Column) -> Column:
        later = F.filter(F.slice(cause, 2, F.size(cause)), lambda x: x["section"].isNull())
        lists = [distinct_items(words(of(p, name)), most).alias(name) for name, most in MOST_ITEMS.items()]
        return F.struct(F.get(cause, F.lit(0))["text"].alias("root_cause"), distinct_items(F.concat(words(p["lead"]), words(later)), 8).alias("spare"), *lists)

    def filled(a: Column) -> Column:
        spare, n = a["spare"], F.size(a["spare"])
        instead = {"risks": F.slice(spare, 2, 2), "fix_plan": F.slice(spare, 2, 3), "verification_steps": F.when(n > 2, F.slice(spare, F.greatest(n - 1, F.lit(1)), 2)).otherwise(F.slice(spare, 1, 0))}
        lists = [F.when(F.size(a[name]) > 0, a[name]).otherwise(other).alias(name) for name, other in instead.items()]
        return F.struct(F.coalesce(a["root_cause"], F.get(spare, F.lit(0)), F.lit("")).alias("root_cause"), *lists)

    return _let(rows, lambda r: _let(heads(r), lambda h: _let(parts(r, h), lambda p: _let(of(p, "root_cause"), lambda cause: _let(read(p, cause), filled)))))


HIT = "struct<source_type:string,path:string,title:string,section:string,symbol_name:string,start_line:int,end_line:int,excerpt:string,score:double>"


def _or(x: Column, other: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit("")), other if isinstance(other, Column) else F.lit(other))


def line_range(hit: Column) -> Column:
    start, end = hit["start_line"].cast("string"), hit["end_line"].cast("string")
    return F.coalesce(F.concat(start, F.lit("-"), end), start, F.lit("unknown"))


def anchor(hit: Column, missing: str = "unknown_section") -> Column:
    """A hit's place, for people to read."""
    symbol = _or(hit["symbol_name"], _or(hit["section"], missing))
    return F.concat(F.lit("`"), _or(hit["path"], "unknown_path"), F.lit("` -> `"), symbol, F.lit("` (line: "), line_range(hit), F.lit(")"))


#: The texts of answers that are made from evidence where no model's answer can be used.
TEXTS = {
    "no_cause": "当前更可能与 `%s` 相关，但缺少可直接佐证根因的证据。建议先补充关键日志片段、错误堆栈或具体函数名。",
    "signals": " 已观测到异常信号：%s。",
    "code_cause": "高概率问题集中在 %s 所在逻辑分支，需重点核查输入边界、异常路径与状态更新链路。%s",
    "other_cause": "高概率与 `%s` 描述的业务流程或规则执行有关，需结合模块 `%s` 的实现路径做交叉核对。%s",
    "evidence": "证据文档",
    "risk_ids": "需沿 `%s` 串联日志与链路节点，否则可能误判故障传播路径。",
    "risk_times": "需在 `%s` 对齐监控窗口与发布/配置变更时间，避免把历史噪声当成本次根因。",
    "risk_versions": "代码实现与文档口径可能存在版本差异，若不比对当前线上版本，修复动作可能偏离真实故障点。",
    "risk_cases": "历史案例仅能提供相似场景参考，若直接套用处理方案，可能忽略本次上下游差异。",
    "risk_narrow": "当前证据覆盖面较窄，若直接实施修复可能带来误改风险。",
    "risk_rollback": "若未先做灰度与回滚预案，修复动作可能在高峰流量下放大影响面。",
    "fix_code": "先检查 %s，补齐输入校验、异常分支保护与关键状态写入条件。",
    "fix_rules": "对照 `%s` 的业务规则，核对 `%s` 当前实现与规则是否一致。",
    "document": "业务文档",
    "fix_logs": "在修复分支中增加结构化日志字段（trace_id/request_id/关键参数），确保后续可快速复盘。",
    "fix_tests": "补充针对本次症状的回归用例，并覆盖异常重试与边界输入场景。",
    "check_ids": "使用 `%s` 复现并回放问题请求，确认核心异常不再出现。",
    "check_path": "按原故障触发路径复现一次，并记录修复前后关键日志差异。",
    "check_times": "对比 `%s` 前后监控指标，确认故障指标恢复且未引入新波动。",
    "check_windows": "连续观察 1-2 个监控窗口，确认错误率、时延和队列积压恢复到正常区间。",
    "check_anchor": "抽样核对证据锚点（如 %s）相关分支在生产流量下按预期执行。",
    "check_logs": "补充 `%s` 链路的关键日志后再做二次验证，避免“看起来恢复”但缺少证据。",
    "code_place": "代码位置：%s",
    "code_excerpt": "代码摘要：%s",
    "unnamed": "未命名证据",
    "no_points": "当前问题主要落在 `%s`。 模块说明：%s。 当前没有命中足够证据，建议补充更具体的业务词、字段名或代码符号后重试。",
    "no_code_1": "当前问题主要落在 `%s`。",
    "no_code_2": "当前模块说明：%s。",
    "no_code_3": "暂无可直接定位的代码证据，建议补充函数名、文件名或调用链关键词后重试。",
    "out_of_scope": "这轮输入在领域判定阶段被识别为与当前系统无关，因此没有进入后续的知识问答、问题分析或代码生成链路。你可以继续提业务规则、模块设计、接口流程、报错排查或修复方案相关的问题。",
}


def _say(name: str, *values: Column) -> Column:
    parts = TEXTS[name].split("%s")
    return F.concat(*[x for p, v in zip(parts, [*values, F.lit("")]) for x in (F.lit(p), v)])


def _when(condition: Column, *items: Column) -> Column:
    return F.when(condition, F.array(*items)).otherwise(F.array().cast("array<string>"))


def issue_fallback(module: Column, symptom: Column, hits: Column) -> Column:
    """struct(root_cause, risks, fix_plan, verification_steps, need_user_confirmation) from evidence alone. symptom is what
    `symptoms` returns, hits an array of HIT, the best first."""
    parts = by_source(hits)
    some, top = F.size(hits) > 0, F.get(hits, F.lit(0))
    named = lambda items, n: F.array_join(F.slice(items, 1, n), ", ")
    has = lambda name: F.size(symptom[name]) > 0
    signals = F.when(has("signals"), _say("signals", named(symptom["signals"], 2))).otherwise("")
    title = lambda hit, text: _or(hit["title"], _or(hit["path"], TEXTS[text]))
    other = _say("other_cause", title(top, "evidence"), module, signals)
    cause = F.when(~some, _say("no_cause", module)).when(source_kind(top["source_type"]) == "code", _say("code_cause", anchor(top), signals)).otherwise(other)
    code, wiki = F.size(parts["code"]) > 0, F.size(parts["wiki"]) > 0
    risks = F.concat(
        _when(has("ids"), _say("risk_ids", named(symptom["ids"], 3))), _when(has("times"), _say("risk_times", named(symptom["times"], 2))),
        _when(code & wiki, _say("risk_versions")), _when(F.size(parts["case"]) > 0, _say("risk_cases")),
    )
    risks = F.when(F.size(risks) == 0, F.array(_say("risk_narrow"))).otherwise(risks)
    risks = F.when(F.size(risks) < 2, F.array_append(risks, _say("risk_rollback"))).otherwise(risks)
    fixes = F.concat(
        F.transform(F.slice(parts["code"], 1, 2), lambda h: _say("fix_code", anchor(h))),
        _when(wiki, _say("fix_rules", title(F.get(parts["wiki"], F.lit(0)), "document"), module)), F.array(_say("fix_logs"), _say("fix_tests")),
    )
    checks = F.array(
        F.when(has("ids"), _say("check_ids", named(symptom["ids"], 2))).otherwise(_say("check_path")),
        F.when(has("times"), _say("check_times", named(symptom["times"], 2))).otherwise(_say("check_windows")),
        F.when(some, _say("check_anchor", anchor(top))).otherwise(_say("check_logs", module)),
    )
    return F.struct(
        cause.alias("root_cause"), distinct_items(risks, 3).alias("risks"), distinct_items(fixes, 4).alias("fix_plan"),
        distinct_items(checks, 3).alias("verification_steps"), (F.size(hits) < 2).alias("need_user_confirmation"),
    )


def filled(parsed: Column, fallback: Column) -> Column:
    """What a model's answer gave, and the fallback for each field that it left empty."""
    some = lambda name: F.when(F.size(F.coalesce(parsed[name], F.array().cast("array<string>"))) > 0, parsed[name]).otherwise(fallback[name]).alias(name)
    cause = _or(parsed["root_cause"], fallback["root_cause"]).alias("root_cause")
    return F.struct(cause, *[some(n) for n in ("risks", "fix_plan", "verification_steps")])


def points(hits: Column, most: int = 6) -> Column:
    """What hits say: the place and the excerpt of code, the title and the excerpt of others."""
    short = lambda h: F.substring(F.trim(F.regexp_replace(F.coalesce(h["excerpt"], F.lit("")), r"(?U)\s+", " ")), 1, 140)

    def each(h: Column) -> Column:
        title = _or(h["title"], _or(h["path"], TEXTS["unnamed"]))
        code = F.concat(F.array(_say("code_place", anchor(h, "unknown_symbol"))), _when(short(h) != "", _say("code_excerpt", short(h))))
        other = F.array(F.when(short(h) != "", F.concat(title, F.lit("："), short(h))).otherwise(title))
        return F.when(source_kind(h["source_type"]) == "code", code).otherwise(other)

    return F.slice(F.flatten(F.transform(hits, each)), 1, most)


def qa_fallback(module: Column, hint: Column, kind: Column, hits: Column) -> Column:
    """An answer from evidence alone: a numbered list for questions for lists, reasons and formulas, else one line."""
    p = points(hits)
    none = _say("no_points", module, _or(hint, "--"))
    return F.when(F.size(p) == 0, none).when(kind == "list", as_list(F.slice(p, 1, 5))).when(kind.isin("reason", "formula"), as_list(F.slice(p, 1, 4))).otherwise(F.array_join(F.slice(p, 1, 3), "；"))


def place_fallback(module: Column, hint: Column, code_hits: Column) -> Column:
    """An answer to a question for a place in code: the first three places, or what to ask instead."""
    none = F.array(_say("no_code_1", module), _say("no_code_2", _or(hint, "--")), _say("no_code_3"))
    return as_list(F.when(F.size(code_hits) > 0, F.transform(F.slice(code_hits, 1, 3), lambda h: anchor(h, "unknown_symbol"))).otherwise(none))


def names_code(answer: Column, hits: Column, most: int = 6) -> Column:
    """Whether an answer names a path, a file or a symbol of the first hits."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    lower = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    named = lambda n: (n != "") & F.contains(low, n)
    return F.exists(F.slice(hits, 1, most), lambda h: named(lower(h["path"])) | named(F.element_at(F.split(lower(h["path"]), "/"), -1)) | named(lower(h["symbol_name"])))


#: What a route is called on screen.
SCENES = {"out_of_scope": "领域外问题"}


def finalize(turns: DataFrame, debug: bool = False) -> DataFrame:
    """turns (trace_id, route, kind, status, answer, citations, wiki_hits, case_hits, code_hits, ...) as messages: out of scope
    turns give no evidence, others their citations or all hits, each once and 4 at most. With debug, a struct of what the
    turn knows about itself."""
    out = F.coalesce((F.col("kind") == "out_of_scope") | (F.col("route") == "out_of_scope") | (F.col("status") == "out_of_scope"), F.lit(False))
    none = F.array().cast(f"array<{HIT}>")
    lists = [F.coalesce(F.col(c).cast(f"array<{HIT}>"), none) for c in ("citations", "wiki_hits", "code_hits", "case_hits")]
    kinds = ("", "wiki", "code", "case")
    named = lambda kind: lambda h: h.withField("source_type", source_key(_or(h["source_type"], kind)))
    typed = [F.transform(hits, named(kind)) for hits, kind in zip(lists, kinds)]
    hits = F.when(out, none).otherwise(output(evidence(typed[0], *typed[1:])))
    kept = [
        "trace_id", F.lit("assistant").alias("role"), F.coalesce("kind", "route", F.lit("unknown")).alias("kind"), F.coalesce("route", F.lit("unknown")).alias("intent"),
        F.coalesce("status", F.lit("completed")).alias("status"), F.when(out & F.col("answer").isNull(), TEXTS["out_of_scope"]).otherwise(F.coalesce("answer", F.lit(""))).alias("content"), hits.alias("citations"),
    ]
    known = [c for c in ("domain_relevance", "module_name", "retrieval_queries") if debug and c in turns.columns]
    messages = turns.select(*kept, *known)
    if not debug:
        return messages
    scene = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SCENES.items() for x in p]), F.col("kind")), F.col("kind"))
    why = F.when(F.col("intent") == "knowledge_qa", "llm_status_missing").otherwise("no_llm_in_route")
    extra = F.struct(scene.alias("scene_label"), F.lit("not_invoked").alias("llm_status"), why.alias("llm_reason"), F.size("citations").alias("evidence_count"), *known)
    return messages.withColumn("debug", extra).drop(*known)
