"""Benchmark decontamination with a distributed positional inverted index. DataFrame operations only.

Index: `build_index` stores a posting (row, number, position) for each place of a term of the vocabulary in the corpus, and an
end posting for each row, whose position is the row's number of words. The corpus is read once; all that follows reads the
postings, which lie by rows, so that no list is ever gathered in one task.

Phrases: each window of the test items starts from its rarest term, by the count of postings. A posting of that anchor puts
the item beside the row, at an offset. The postings near it are then adjusted by that offset: those whose term is the item's
at the adjusted place are in the intersection. It is kept as bits around the anchor; a run of bits as long as a window is an
occurrence. Anchors' postings meet the others by the row and by stretches of STRETCH positions, so that the work grows with
the postings of anchors, whatever a row's length.

Proximity: the rarest term's postings are the centres; all terms, as often as the phrase has them, must lie in one span.

Defined results: null texts and texts without words have no words: n_words, n_hit and n_items are 0, the digest is that of
an empty string, contaminated is false. Items without words match nothing; items of fewer than WINDOW words are one window.
Repeated documents get a row each; several rows of one item_id count as one item with all their windows. Null item ids
match but aren't listed or counted. Texts of any length are taken whole. Empty tables give no rows, an empty benchmark no
hits. Extra columns are ignored, whatever their names; `clean` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import fresh, lower_ascii, stored

WINDOW = 13
#: What lies between words; a word is a run of [^\x00-\x2F\x3A-\x60\x7B-\x7F].
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: So many terms of the test items, or anchors, and so many places of anchors in the corpus (four numbers each) are broadcast;
#: more are joined by a shuffle, with salt where a frequent term is the key.
MOST_BROADCAST, MOST_PLACED = 100_000, 1_000_000
SALT = 32
STRETCH = 32
#: The number of an end posting.
END = -1
#: Windows of more words have no bits around their anchor.
LONGEST_WINDOW = 32


def words(text: Column) -> Column:
    # Splitting at the gaps costs a ninth of extracting all words.
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


@dataclass(frozen=True)
class Index:
    """vocabulary: (term, number); postings: (row, doc_id, number, position), doc_id only in end postings."""

    vocabulary: DataFrame
    postings: DataFrame

    def counts(self) -> DataFrame:
        """(number, n) of the terms that occur."""
        n = self.postings.where(F.col("number") != END).groupBy("number").agg(F.count("*").alias("n"))
        return F.broadcast(n) if _few(self.vocabulary) else n


def _few(df: DataFrame) -> bool:
    return df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def build_index(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> Index:
    """The stored index of docs for distinct terms (term), or for all terms of docs."""
    listed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), words(F.col(text)).alias("words"))
    if terms is None:
        terms = listed.select(F.explode("words").alias("term")).distinct()
    vocabulary = stored(terms.select("term", F.monotonically_increasing_id().alias("number")), "vocabulary")
    # The last place of the array, an empty word that no vocabulary has, is the end posting. Words are looked up by a number,
    # which costs a fifth of a look-up by text, and compared then, in a form that isn't taken for another key.
    end = F.lit("")
    places = listed.select("row", "doc_id", F.posexplode(F.array_append("words", end)).alias("position", "word")).withColumn("key", F.xxhash64("word"))
    known = vocabulary.unionByName(vocabulary.sparkSession.range(1).select(end.alias("term"), F.lit(END).cast("bigint").alias("number"))).withColumn("key", F.xxhash64("term"))
    known = F.broadcast(known) if _few(vocabulary) else known
    same = F.startswith("word", "term") & (F.octet_length("word") <= F.octet_length("term"))
    found = places.join(known, "key").where(same)
    doc_id = F.when(F.col("number") == END, F.col("doc_id"))
    return Index(vocabulary, stored(found.select("row", doc_id.alias("doc_id"), "number", F.col("position").cast("int").alias("position")), "postings"))


def _numbered(items: DataFrame, index: Index) -> DataFrame:
    """items (item_id, text) as (item, item_id, m, numbers): the numbers of the m words, null for those that the index lacks."""
    listed = items.select(F.monotonically_increasing_id().alias("item"), "item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    known = F.broadcast(index.vocabulary) if _few(index.vocabulary) else index.vocabulary
    places = listed.select("item", "item_id", F.size("words").alias("m"), F.posexplode("words").alias("at", "term")).join(known, "term", "left")
    by = places.groupBy("item", "item_id", "m").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("number", F.lit(END - 1)).alias("number")))).alias("places"))
    return by.select("item", "item_id", "m", F.transform("places", lambda p: F.nullif(p["number"], F.lit(END - 1))).alias("numbers"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rarest term of each window of numbered items: (number, item_id, item, at, need, near). near holds the numbers of the
    item's words from window - 1 before the anchor to window - 1 after it; need is the length of a match. A window with a
    term that the index lacks can't occur."""
    starts = items.select("item", "numbers", "m", F.explode(F.sequence(F.lit(0), F.greatest(F.col("m") - window, F.lit(0)))).alias("start"))
    places = starts.select("item", "start", F.posexplode(F.slice("numbers", F.col("start") + 1, F.lit(window))).alias("offset", "number"))
    rare = (
        places.join(counts, "number", "left")
        .groupBy("item", "start")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("offset"), F.col("number"))).alias("rare"))
        .where(F.col("rare.n") > 0)
        .select("item", (F.col("start") + F.col("rare.offset")).alias("at"), "rare.number")
        .distinct()
    )
    near = F.transform(F.sequence(F.lit(1 - window), F.lit(window - 1)), lambda d: F.when(F.col("at") + d >= 0, F.get("numbers", F.col("at") + d)))
    return rare.join(items, "item").select("number", "item_id", "item", "at", F.least("m", F.lit(window)).alias("need"), near.alias("near"))


def occurrences(index: Index, rare: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, item_id, item, at, centre, low, high): the runs of matching words around anchors that hold a whole window, from
    word `low` to word `high` of the row; the anchor is word `at` of the item and word `centre` of the row."""
    if not 1 <= window <= LONGEST_WINDOW:
        raise ValueError(f"a window has 1 to {LONGEST_WINDOW} words")
    spark = rare.sparkSession
    rare = stored(rare.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    postings = index.postings.where(F.col("number") != END).select("row", "number", "position")
    heads = rare.select("number", "anchor")
    if _few(heads):
        placed = postings.join(F.broadcast(heads), "number")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
        placed = postings.withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int")).join(heads.select("number", "anchor", salt), ["number", "salt"])
    placed = stored(placed.select("row", "anchor", F.col("position").alias("centre")), "placed")
    # Each placed anchor is met by the postings of the stretches that it reaches.
    reach = window - 1
    first, last = F.floor(F.greatest(F.col("centre") - reach, F.lit(0)) / STRETCH), F.floor((F.col("centre") + reach) / STRETCH)
    stretch = lambda row, number: F.xxhash64(row, number.cast("bigint"))
    spread = F.explode(F.sequence(first, last)).alias("s")
    wanted = placed.select(F.col("row").alias("held"), "anchor", "centre", spread).withColumn("key", stretch(F.col("held"), F.col("s"))).drop("s")
    met = postings.withColumn("key", stretch(F.col("row"), F.floor(F.col("position") / STRETCH)))
    met = met.join(F.broadcast(wanted) if placed.limit(MOST_PLACED + 1).count() <= MOST_PLACED else wanted, "key")
    place = F.col("position") - F.col("centre") + reach
    met = met.where((F.col("row") - F.col("held") == 0) & place.between(0, 2 * reach)).select("row", "anchor", "centre", "number", place.alias("place"))
    details, few = rare.select("anchor", "item_id", "item", "at", "need", "near"), _few(rare)
    hint = F.broadcast if few else (lambda df: df)
    fitting = met.join(hint(details.select("anchor", "near")), "anchor").where(F.get("near", F.col("place")) == F.col("number"))
    bits = fitting.groupBy("row", "anchor", "centre").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place"))).alias("bits"))
    # The runs of set bits below and above the anchor's, in the middle.
    text = F.lpad(F.bin("bits"), 2 * reach + 1, "0")
    run = lambda part: F.length(F.substring_index(part, "0", 1))
    below, above = run(F.substring(text, reach + 2, reach)), run(F.reverse(F.substring(text, 1, reach)))
    runs = bits.select("row", "anchor", "centre", below.alias("below"), above.alias("above"))
    runs = runs.join(hint(details.drop("near")), "anchor").where(F.col("below") + F.col("above") + 1 >= F.col("need"))
    return runs.select("row", "item_id", "item", "at", "centre", (F.col("centre") - F.col("below")).alias("low"), (F.col("centre") + F.col("above")).alias("high"))


def _covered(spans: Column) -> Column:
    """Positions in the union of (low, high) structs."""
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        gain = F.greatest(s["high"] - F.greatest(s["low"] - 1, acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], s["high"]).alias("end"), (acc["n"] + gain).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = benchmark.select("item_id", "text")
    index = build_index(docs, items.select(F.explode(words(F.col("text"))).alias("term")).distinct())
    found = occurrences(index, anchors(stored(_numbered(items, index), "items"), index.counts(), window), window)
    by_row = found.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    each = index.postings.where(F.col("number") == END).select("row", "doc_id", F.col("position").cast("long").alias("n_words")).join(by_row, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("spans")))
    return each.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items_of), ","), 256).alias("items_sha256"),
    ).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents (rows that share a contaminated row's doc_id go with it)."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(key := fresh(docs, "_bad")[0])).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(key)), "left_anti")


def search(index: Index, queries: DataFrame, slop: int | None = None) -> DataFrame:
    """(query_id, doc_id, starts): queries is (query_id, phrase). Without slop the phrase's terms follow each other exactly; starts
    are the positions of its first term. A phrase of more than LONGEST_WINDOW terms is cut into parts of so many, the last one
    at its end, and starts where all parts start at their offsets. With slop all its terms, as often as
    the phrase has them, occur within a span of `slop` positions, in any order; starts are the positions of the rarest term
    that are in such a span. A phrase with a missing term, or no terms, matches nothing; nor does a null text or phrase. Query ids are
    distinct; repeated rows of documents each match; empty tables give no rows."""
    ends = index.postings.where(F.col("number") == END).select("row", "doc_id")
    if slop is None:
        each = queries.select("query_id", words(F.col("phrase")).alias("ws")).withColumn("last", F.size("ws") - LONGEST_WINDOW)
        offsets = F.when(F.col("last") <= 0, F.array(F.lit(0))).otherwise(F.array_union(F.sequence(F.lit(0), F.col("last"), F.lit(LONGEST_WINDOW)), F.array("last")))
        parts = each.select("query_id", "ws", F.size(offsets).alias("parts"), F.explode(offsets).alias("offset"))
        asked = parts.select(F.struct("query_id", "offset", "parts").alias("item_id"), F.array_join(F.slice("ws", F.col("offset") + 1, F.lit(LONGEST_WINDOW)), " ").alias("text"))
        items = stored(_numbered(asked, index), "phrases")
        # A whole part is one window, so that its anchor is its rarest term.
        rare = anchors(items, index.counts(), LONGEST_WINDOW)
        found = occurrences(index, rare, LONGEST_WINDOW).select("row", "item_id.*", (F.col("centre") - F.col("at") - F.col("item_id.offset")).alias("start"))
        whole = found.groupBy("query_id", "row", "start").agg(F.count_distinct("offset").alias("n"), F.max("parts").alias("parts")).where("n = parts")
        by = whole.groupBy("query_id", "row").agg(F.sort_array(F.collect_list("start")).alias("starts"))
        return by.join(ends, "row").select("query_id", "doc_id", "starts")
    asked = queries.select(F.col("query_id").alias("item_id"), F.col("phrase").alias("text"))
    items = stored(_numbered(asked, index), "phrases")
    whole = items.where(~F.exists("numbers", lambda x: x.isNull()))
    terms = whole.select("item", "item_id", F.explode("numbers").alias("number")).groupBy("item", "item_id", "number").agg(F.count("*").alias("times"))
    ranked = terms.join(index.counts(), "number").withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy("n", "number")))
    asked = ranked.groupBy("item").agg(F.count("*").alias("kinds"))
    lists = index.postings.where(F.col("number") != END).join(ranked.select("item", "item_id", "number", "nth", "times"), "number")
    lists = lists.groupBy("item", "item_id", "row", "nth", "times").agg(F.sort_array(F.collect_list("position")).alias("p"))
    per = lists.groupBy("item", "item_id", "row").agg(F.sort_array(F.collect_list(F.struct("nth", "times", "p"))).alias("all"))
    per = per.join(asked, "item").where(F.size("all") == F.col("kinds"))

    def within(s: Column, c: Column) -> Column:
        """The span from s holds c and every list as often as it must."""
        return (s <= c) & (c < s + slop) & F.forall("all", lambda x: F.size(F.filter(x["p"], lambda p: (p >= s) & (p < s + slop))) >= x["times"])

    ok = F.filter(F.col("all")[0]["p"], lambda c: F.exists(F.sequence(c - (slop - 1), c), lambda s: within(s, c)))
    return per.select(F.col("item_id").alias("query_id"), "row", ok.alias("starts")).where(F.size("starts") > 0).join(ends, "row").select("query_id", "doc_id", "starts")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM b WHERE len(w) > 0)
), k AS (
  SELECT DISTINCT k FROM win
), dw AS (
  SELECT doc_id, k, s, array_to_string(w[s + 1 : s + k], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, k WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, dw.s, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
