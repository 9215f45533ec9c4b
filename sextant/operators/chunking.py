"""Chunking and parsing: documents to chunks, code to parents and children."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import excerpt, normalize
from sextant.storage import stored

SIZE, OVERLAP = 520, 80
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", "。", "；", " ", "")
CHILD_LINES, CHILD_OVERLAP = 36, 8
FLOW_WORDS = ("流程", "步骤", "flow", "pipeline", "step")


def title(text: Column, stem: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)), F.lit("")), stem)


def section(text: Column, fallback: Column) -> Column:
    deep = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#{2,4}\s+(.+)$", 1)), F.lit(""))
    lead = F.nullif(F.trim(F.regexp_extract(text, r"^\s*#+\s*(.+)", 1)), F.lit(""))
    return F.coalesce(deep, lead, fallback)


def chunk_type(text: Column) -> Column:
    """code, list, table, flow or paragraph, in this order."""
    flow = F.lit(False)
    for w in FLOW_WORDS:
        flow = flow | F.contains(F.lower(text), F.lit(w))
    return (
        F.when(F.contains(text, F.lit("```")), "code")
        .when(text.rlike(r"(?m)^\s*([-*+]|\d+\.)\s+"), "list")
        .when(text.rlike(r"(?m)^\s*\|.*\|"), "table")
        .when(flow, "flow")
        .otherwise("paragraph")
    )


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_no, content): windows of `size` characters, each `overlap` into the one before; none for empty texts."""
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.ceil((n - overlap) / step).cast("int"), F.lit(1)) - 1
    each = docs.where(n > 0).select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return each.select(key, "chunk_no", F.substr(F.col(text), F.col("chunk_no") * step + 1, F.lit(size)).alias("content"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Splits at the first separator that occurs, keeps it with what follows, splits what is still too long at the next
    one, and joins neighbours up to `size`, repeating up to `overlap` of what went before."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p for p in [text.split(sep)[0], *(sep + x for x in text.split(sep)[1:])] if p]
    out: list[str] = []
    held: list[str] = []
    total = 0

    def flush() -> None:
        if (joined := "".join(held).strip()) != "":
            out.append(joined)

    for p in parts:
        if len(p) > size and rest:
            flush()
            held, total = [], 0
            out += split_text(p, size, overlap, rest)
            continue
        if held and total + len(p) > size:
            flush()
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    flush()
    return out


def recursive_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_no, content) by `split_text`: merging pieces greedily needs a loop, so this runs in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c) for k, t in zip(pdf[key], pdf[text]) for i, c in enumerate(split_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "content"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_no int, content string")


def describe(chunks: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Adds title, section, chunk_type and normalised text."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    named = chunks.withColumn("title", title(F.col(content), stem))
    return named.withColumn("section", section(F.col(content), F.col("title"))).withColumn("chunk_type", chunk_type(F.col(content))).withColumn("normalized_text", normalize(F.col(content)))


def export(chunks: DataFrame) -> DataFrame:
    """For each path: chunks, and histograms of sections and types."""
    by = chunks.groupBy("path", "section", "chunk_type").agg(F.count("*").alias("n"))
    kinds = by.groupBy("path", "chunk_type").agg(F.sum("n").alias("n")).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_type", "n")))).alias("types"))
    places = by.groupBy("path", "section").agg(F.sum("n").alias("n")).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n")))).alias("sections"), F.sum("n").alias("chunks"))
    return places.join(kinds, "path")


PARENTS = "path string, chunk_type string, symbol_name string, signature string, start_line int, end_line int, content string"


def _parents(path: str, source: str) -> list[tuple]:
    lines = source.splitlines()
    whole = (path, "file", "", "", 1, max(1, len(lines)), source)
    if not path.endswith(".py"):
        return [whole]
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [whole]
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            if kind == "class":
                head = f"class {node.name}({', '.join(map(ast.unparse, node.bases))})" if node.bases else f"class {node.name}"
            else:
                head = f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
            found.append((path, kind, node.name, head, node.lineno, node.end_lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno])))
    return [*sorted(found, key=lambda x: (x[4], x[5])), whole]


def code_parents(files: DataFrame) -> DataFrame:
    """(path, content) to classes, functions and the file itself; only a parser can do that, so it runs in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in _parents(p, c or "")]
            yield pd.DataFrame(rows, columns=["path", "chunk_type", "symbol_name", "signature", "start_line", "end_line", "content"])

    found = files.select("path", "content").mapInPandas(run, PARENTS)
    return found.withColumn("parent_id", F.md5(F.concat_ws("::", "path", "chunk_type", "symbol_name", F.col("start_line").cast("string"), F.col("end_line").cast("string"))))


def children(parents: DataFrame, key: str, content: str = "content", size: int = CHILD_LINES, overlap: int = CHILD_OVERLAP, start: Column | None = None) -> DataFrame:
    """(key, child_no, start_line, end_line, content): windows of lines, the last one reaches the end."""
    step = size - overlap
    lines = F.split(content, "\n")
    counted = parents.select(key, lines.alias("lines"), F.size(lines).alias("n"), (start if start is not None else F.lit(1)).alias("first"))
    last = F.greatest(F.ceil((F.col("n") - size) / step), F.lit(0)).cast("int")
    each = counted.select(key, "lines", "n", "first", F.explode(F.sequence(F.lit(0), last)).alias("child_no"))
    begin = F.col("child_no") * step
    return each.select(
        key, "child_no", (F.col("first") + begin).alias("start_line"), (F.col("first") + F.least(begin + size, F.col("n")) - 1).alias("end_line"),
        F.array_join(F.slice("lines", begin + 1, F.lit(size)), "\n").alias("content"),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def highlight(content: Column, words: Column, radius: int = 2, most: int = 18, first_line: Column | None = None) -> Column:
    """struct(text, lines, hits): at most `most` lines from `radius` before the first line with one of the words (two characters
    or more; the first line that isn't blank, where none has any). lines are struct(line_no, content, is_hit), hits the
    numbers of hit lines; text shows them with `>>` before hits and dots where lines are left out. Empty without content."""
    first = first_line if first_line is not None else F.lit(1)
    words = F.filter(F.transform(words, normalize), lambda w: F.length(w) >= 2)
    raw = F.split(F.regexp_replace(F.coalesce(content, F.lit("")), r"\n\z", ""), "\n")
    empty = F.coalesce(content, F.lit("")) == ""
    dots = lambda condition: F.when(condition, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))
    number = lambda x: F.when(F.length(x["line_no"].cast("string")) < 4, F.lpad(x["line_no"].cast("string"), 4, " ")).otherwise(x["line_no"].cast("string"))

    def of_words(keys: Column) -> Column:
        held = lambda x: _let(normalize(x), lambda n: F.exists(keys, lambda w: F.contains(n, w)))
        return _let(F.transform(raw, lambda x, i: F.struct(i.alias("at"), F.regexp_replace(x, r"(?U)\s+$", "").alias("content"), held(x).alias("hit"))), of_lines)

    def of_lines(marked: Column) -> Column:
        at = F.transform(F.filter(marked, lambda x: x["hit"]), lambda x: x["at"])
        shown = F.transform(F.filter(marked, lambda x: x["content"] != ""), lambda x: x["at"])
        return _let(F.coalesce(F.get(at, F.lit(0)), F.get(shown, F.lit(0)), F.lit(0)), lambda lead: of_lead(marked, lead))

    def of_lead(marked: Column, lead: Column) -> Column:
        start = F.greatest(lead - radius, F.lit(0))
        hit = lambda x: (x["hit"] | (x["at"] == lead)) & (x["content"] != "")
        lines = F.transform(F.slice(marked, start + 1, F.lit(most)), lambda x: F.struct((x["at"] + first).alias("line_no"), x["content"].alias("content"), hit(x).alias("is_hit")))
        return _let(lines, lambda lines: of_shown(lines, start, start + most < F.size(marked)))

    def of_shown(lines: Column, start: Column, more: Column) -> Column:
        rows = F.transform(lines, lambda x: F.concat(F.when(x["is_hit"], ">> ").otherwise("   "), number(x), F.lit(": "), x["content"]))
        text = F.trim(F.array_join(F.concat(dots(start > 0), rows, dots(more)), "\n"))
        hits = F.transform(F.filter(lines, lambda x: x["is_hit"]), lambda x: x["line_no"])
        return F.struct(F.when(empty, "").otherwise(text).alias("text"), F.when(empty, F.slice(lines, 1, 0)).otherwise(lines).alias("lines"), F.when(empty, F.slice(hits, 1, 0)).otherwise(hits).alias("hits"))

    return _let(words, of_words)


def snapshot(chunks: DataFrame) -> DataFrame:
    """All chunks in the order of their documents, with their place in the document and in all, and their length.

    Places in all are prefix sums on two levels: documents, a small row each, are dealt to parts by ranges of their paths, each
    part sums up its own, and what is before a part is a number for each part. So no task sees all documents."""
    spark = chunks.sparkSession
    w = Window.partitionBy("path").orderBy("chunk_no")
    placed = chunks.withColumn("doc_chunk_index", F.row_number().over(w)).withColumn("content_length", F.length("content"))
    sizes = chunks.groupBy("path").agg(F.count("*").alias("n")).repartitionByRange(F.col("path").asc())
    # Written, as ranges that are drawn from a sample may differ when they are drawn again.
    sizes = stored(sizes.withColumn("part", F.spark_partition_id()), "snapshot")
    parts = sorted((r.part, r.n) for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts = [(part, sum(n for _, n in parts[:i])) for i, (part, _) in enumerate(parts)]
    start = F.broadcast(spark.createDataFrame(starts, "part int, start bigint"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("path")) - F.col("n")
    before = sizes.withColumn("within", within).join(start, "part").select(F.col("path").alias("path2"), (F.col("start") + F.col("within")).alias("before"))
    joined = placed.join(before, F.col("path").eqNullSafe(F.col("path2"))).withColumn("index", F.col("before") + F.col("doc_chunk_index"))
    return joined.drop("before", "path2").orderBy("path", "chunk_no")


def previews(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("preview", excerpt(F.col("content")))
