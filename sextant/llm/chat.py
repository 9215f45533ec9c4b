"""Chat formatting with typed content parts. DataFrame operations only.

A turn is a list of typed parts: text, image, audio or document. A visitor flattens it: text is escaped and kept, any other
part becomes the placeholder of its type, and its reference and the number of tokens that the placeholder stands for are
recorded, in order. The template marks turns as

    <|turn|>role\\ntext<|end|>

Control strings inside texts and roles, the template's and those of other common templates, are escaped: a backslash goes
between a control string's first character and the rest, and where backslashes stand there already, one more. Taking one
away undoes it, so every text can be read back, and no control string is left in the escaped text.

Offsets and lengths are in code points. The loss mask is the list of spans (start, length) of the assistant's texts.

Defined results: null texts count as empty, null roles as an empty role. Turns are ordered by turn (nulls first), then role,
then text; repeated turns stay. A null conv_id is a conversation of its own. Parts of unknown type become document
placeholders; null parts are skipped. A conversation is one output row and so must fit into one string; texts are taken
whole. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END, BREAK = "<|turn|>", "<|end|>", "<|nl|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Control strings without their first character. Fixed values.
_REST = r"(\|(?:turn|end|nl|image|audio|document|im_start|im_end|endoftext|system|user|assistant|eot_id|begin_of_text|end_of_text|start_header_id|end_header_id)\|>|/?s>|/?INST\]|/?SYS>>|bos>|eos>|pad>|unk>|start_of_turn>|end_of_turn>)"
_ESCAPE, _UNESCAPE = r"([<\[])(\\*)" + _REST, r"([<\[])\\(\\*)" + _REST

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of a part: a tile of TILE x TILE pixels, a frame of audio, a page. Unknown sizes count as one such unit.
TILE, FRAMES_A_SECOND, TOKENS_A_PAGE = 28, 25, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def _tokens(p: Column) -> Column:
    tiles = F.ceil(F.coalesce(p["width"], F.lit(1)) / TILE) * F.ceil(F.coalesce(p["height"], F.lit(1)) / TILE)
    return (
        F.when(p["type"] == "image", tiles)
        .when(p["type"] == "audio", F.greatest(F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * FRAMES_A_SECOND), F.lit(1)))
        .otherwise(F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * TOKENS_A_PAGE)
        .cast("bigint")
    )


def visit(parts: Column) -> Column:
    """Parts to struct(text, attachments, expanded): the flattened text, struct(type, ref, tokens) of each placeholder in
    order, and the sum of their tokens."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    is_text = lambda p: p["type"].eqNullSafe("text")
    mark = lambda p: F.when(p["type"] == "image", PLACEHOLDERS["image"]).when(p["type"] == "audio", PLACEHOLDERS["audio"]).otherwise(PLACEHOLDERS["document"])
    # Texts side by side are one text: it is escaped as a whole, as a control string may begin in one and end in the next.
    fold = lambda acc, p: F.when(is_text(p), F.struct(acc["shown"].alias("shown"), F.concat(acc["open"], F.coalesce(p["text"], F.lit(""))).alias("open"))).otherwise(F.struct(F.concat(acc["shown"], escape(acc["open"]), mark(p)).alias("shown"), F.lit("").alias("open")))
    shown = F.aggregate(parts, F.struct(F.lit("").alias("shown"), F.lit("").alias("open")), fold, lambda acc: F.concat(acc["shown"], escape(acc["open"])))
    others = F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    return F.struct(shown.alias("text"), others.alias("attachments"), F.aggregate(others, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded"))


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def format_chats(turns: DataFrame, parts: Column | None = None) -> DataFrame:
    """(conv_id, formatted, loss, attachments, expanded_tokens) from rows (conv_id, turn, role, text). parts is an array of
    PART in place of the text."""
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), visit(parts if parts is not None else text_part(F.col("text"))).alias("v"))
    head = F.concat(F.lit(TURN), _escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", head.alias("head"), F.col("v.text").alias("text"), F.col("v.attachments").alias("attachments"), F.col("v.expanded").alias("expanded"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    size = F.length("head") + F.length("text") + len(END)
    placed = rows.withColumn("at", F.row_number().over(w)).withColumn("start", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    turn = F.struct("at", F.concat("head", "text", F.lit(END)).alias("piece"), (F.col("role") == "assistant").alias("trained"), "start", F.length("text").cast("bigint").alias("length"), "attachments")
    all_ = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum("expanded").alias("expanded_tokens"))
    return all_.select(
        "conv_id",
        F.array_join("turns.piece", "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
        F.flatten("turns.attachments").alias("attachments"),
        "expanded_tokens",
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.split(formatted, r"<\|end\|>")
    bodies = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(TURN) + 1)))

    def one(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(bodies, one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("trained"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


SPECIAL_TEXT = "</s>[INST] ok [/INST]"


def with_special(turns: DataFrame) -> DataFrame:
    """turns and conversation -7, whose texts hold control strings."""
    extra = turns.sparkSession.createDataFrame([(-7, 0, "user", SPECIAL_TEXT), (-7, 1, "assistant", SPECIAL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)REST', '\1\\\2\3', 'g')) + length(regexp_replace(regexp_replace(role, '([<\[])(\\*)REST', '\1\\\2\3', 'g'), '\n', '<|nl|>', 'g')) + 16 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".replace("REST", _REST)
