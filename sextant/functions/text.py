"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The script range of han characters that term extraction knows.
HAN = "一-鿿"
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "cpp": "cpp", "c": "c", "h": "c", "sql": "sql", "sh": "shell", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown"}


def normalize(text: Column) -> Column:
    """Lower case, runs of (Unicode) white space as one space, trimmed. Null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def squeeze(text: Column) -> Column:
    """For matching: lower case without white space and punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\p{Punct}，。；：、！？（）【】《》“”‘’]+", "")


def tokens(text: Column) -> Column:
    """Words of the normalised text, separated by spaces."""
    return F.array_remove(F.split(normalize(text), " "), "")


def terms(text: Column, stop: list[str] | None = None, most: int = 48) -> Column:
    """Latin words and han runs, in order of first occurrence, without stop words, `most` at most."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"([a-z][a-z0-9_+\-]+)"), F.lit(1)), F.regexp_extract_all(low, F.lit(f"([{HAN}]{{2,10}})"), F.lit(1))))
    return F.slice(F.array_except(found, F.array(*map(F.lit, stop))) if stop else found, 1, most)


def code_tokens(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"([a-z_][a-z0-9_]+)"), F.lit(1)), F.regexp_extract_all(low, F.lit(f"([{HAN}]{{2,8}})"), F.lit(1))))


def path_tokens(path: Column) -> Column:
    return F.array_remove(F.split(F.lower(path), r"[\\/._-]+"), "")


def excerpt(text: Column, most: int = 220) -> Column:
    """The text on one line, cut after `most` characters with three dots."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("..."))).otherwise(line)


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, suffix), F.lit("text"))


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs without overlap."""
    return F.when(part == "", 0).otherwise((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def count_hits(text: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))) if words else F.lit(0)


def with_default(value: Column, kind: str, default: object, least: float | None = None) -> Column:
    """A cast that never fails, with a default and a least value."""
    out = F.coalesce(value.try_cast(kind), F.lit(default).cast(kind))
    return out if least is None else F.greatest(out, F.lit(least).cast(kind))


def identifier(name: Column, default: str) -> Column:
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), name).otherwise(F.lit(default))


def iso_seconds(value: Column) -> Column:
    """A timestamp text to seconds, Z understood; what can't be read is kept."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00")), "yyyy-MM-dd'T'HH:mm:ss"), value)


#: Fixed value: the parts of a URI as RFC 3986, appendix B, takes them apart. It reads any text, valid or not.
URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"


def url_parts(url: Column) -> dict[str, Column]:
    """scheme and host in lower case, port, path, query, and params: the (name, value) pairs of the query in their order,
    decoded, those without a value left out. What a URL lacks is empty; a null URL gives nulls, a code that can't be decoded leaves
    its pair as it is."""
    part = lambda n: F.regexp_extract(url, URI, n)
    host = F.regexp_replace(part(2), r"^.*@", "")
    read = lambda x: F.coalesce(F.try_url_decode(x), x)
    cut = lambda p: F.struct(read(F.substring_index(p, "=", 1)).alias("name"), read(F.regexp_replace(p, r"^[^=]*=?", "")).alias("value"))
    return {
        "scheme": F.lower(part(1)), "host": F.lower(F.regexp_replace(host, r":[0-9]*$", "")), "port": F.regexp_extract(host, r":([0-9]+)$", 1),
        "path": part(3), "query": part(4), "params": F.filter(F.transform(F.split(part(4), "&"), cut), lambda p: p["value"] != ""),
    }
