"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores a posting (document, position, term) for each training token that some test window can
ask for.  Every window then looks up its rarest terms by corpus frequency; the offsets of the terms in the item
are taken off their positions, so that postings of one occurrence meet on (document, item, diagonal), and only
diagonals with all of a window's rarest terms are kept.  The windows left are compared word by word with the
document's tokens, which makes the phrase matches exact.  ``near_matches`` intersects the same lists for terms
in any order within a span.

Of the texts only those in a slot (of ``MARKS``) with a candidate are shuffled for that comparison.  The slots bound the broadcast, not
the work: with many more candidate documents than slots, nearly all texts are.

A window is ``WINDOW`` consecutive words of an item, or all of an item that has fewer.

Defined cases: null text has no words; an item without words or without an item_id is ignored; rows that share
an item_id are one item; rows that share a doc_id are judged apart, by their own texts; a null doc_id is kept;
empty tables give no matches; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.llm._shared import ascii_lower, small, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Rarest terms of a window whose lists are intersected before the words are compared.
RAREST = 2
#: A document is contaminated if its hit words times this reach its words.
SHARE = 20
#: Slots of the table that says which documents have candidates.
MARKS = 1 << 18
MATCHES = "array<struct<start:int,item_id:string,n:int>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def test_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, first, words): the different windows of every item; rows of one item_id may have several at one ``first``."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("all"))
    items = items.where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - width, F.lit(0)))
    windows = items.select("item_id", F.explode(F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice("all", s + 1, width).alias("words")))).alias("w"))
    return windows.select("item_id", "w.first", "w.words").distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Stored postings (doc_id, text_key, pos, term); with a vocabulary (term), the lists of its terms only."""
    tokens = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("text_key"), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    if vocabulary is not None:
        tokens = tokens.join(small(vocabulary.select("term").distinct()), "term")
    return written(tokens.select("doc_id", "text_key", "pos", "term"), "postings")


def _rarest(index: DataFrame, windows: DataFrame, rarest: int) -> DataFrame:
    """``windows`` that can occur, with ``probe``: the offsets (in the item) of their rarest terms."""
    counts = index.groupBy("term").count()
    terms = windows.select("item_id", "first", "words", F.posexplode("words").alias("offset", "term")).join(counts, "term")
    by_window = terms.groupBy("item_id", "first", "words").agg(F.sort_array(F.collect_list(F.struct("count", "offset", "term"))).alias("ranked"))
    joined = by_window.where(F.size("ranked") == F.size("words"))  # a term the corpus lacks rules a window out
    return joined.select("item_id", "first", "words", F.transform(F.slice("ranked", 1, rarest), lambda x: F.struct((x["offset"] + F.col("first")).alias("at"), x["term"].alias("term"))).alias("probe"))


def candidates(index: DataFrame, windows: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(doc_id, text_key, item_id, start, words): places where a window's rarest terms stand at the right distances."""
    windows = written(_rarest(index, windows, rarest), "windows")
    probes = windows.select("item_id", F.explode("probe").alias("p")).select("item_id", "p.at", "p.term").distinct()
    met = index.join(small(probes), "term").groupBy("doc_id", "text_key", "item_id", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("met"))
    asked = windows.select("item_id", "first", "words", F.transform("probe", lambda x: x["at"]).alias("ats"))
    found = met.join(small(asked), "item_id").where(F.size(F.array_except("ats", "met")) == 0)
    return found.select("doc_id", "text_key", "item_id", (F.col("diagonal") + F.col("first")).alias("start"), "words").where(F.col("start") >= 0)


def phrase_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` with ``n_words`` and ``matches``: array of (start, item_id, n), the exact occurrences."""
    windows = written(test_windows(benchmark, width), "test")
    index = build_index(docs, windows.select(F.explode("words").alias("term")))
    places = candidates(index, windows)
    by_doc = written(places.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "item_id", "words")).alias("places")), "places")
    by_doc = by_doc.withColumnRenamed("doc_id", "of").withColumnRenamed("text_key", "of_text")
    # Only documents whose slot holds a candidate are shuffled.  There are MARKS slots whatever the data, so they can be broadcast.
    marks = F.broadcast(by_doc.select(_mark(F.col("of"), F.col("of_text")).alias("mark")).distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"), F.col("text").alias("body"))
    packed = packed.withColumn("mark", _mark(F.col("id"), F.col("key")))
    clear = packed.join(marks, "mark", "left_anti").select("row", F.size(words_of(F.col("body"))).cast("long").alias("n_words"), F.array().cast(MATCHES).alias("matches"))
    joined = packed.join(marks, "mark", "left_semi").join(by_doc.hint("merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_text")), "left")
    joined = joined.select("row", words_of(F.col("body")).alias("tokens"), "places")
    same = F.filter("places", lambda x: F.slice("tokens", x["start"] + 1, F.size(x["words"])) == x["words"])
    exact = F.when(F.col("places").isNotNull(), F.transform(same, lambda x: F.struct(x["start"].alias("start"), x["item_id"].alias("item_id"), F.size(x["words"]).alias("n"))))
    return clear.unionByName(joined.select("row", F.size("tokens").cast("long").alias("n_words"), F.array_sort(F.array_distinct(F.coalesce(exact, F.array()))).cast(MATCHES).alias("matches")))


def _mark(doc_id: Column, key: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, key), F.lit(MARKS)).cast("int")


def covered(matches: Column) -> Column:
    """Words inside any of the matches, which are sorted by start."""
    step = lambda acc, m: F.struct(
        (acc["n"] + F.greatest(F.lit(0), m["start"] + m["n"] - F.greatest(m["start"], acc["end"]))).cast("long").alias("n"),
        F.greatest(acc["end"], m["start"] + m["n"]).cast("int").alias("end"),
    )
    return F.aggregate(matches, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end")), step, lambda acc: acc["n"])


def judge(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``row`` (all columns of the document), n_words, n_hit, items (ids of items that occur), contaminated."""
    found = phrase_matches(docs, benchmark, width)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    judged = found.select("row", "n_words", covered(F.col("matches")).alias("n_hit"), items.alias("items"))
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def near_matches(docs: DataFrame, benchmark: DataFrame, span: int = 2 * WINDOW, width: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, item_id, first, start): windows all of whose distinct terms stand within ``span`` words, in any order.

    ``start`` is the first such place.  Stretches of 2 * span words that overlap by half are the candidates, so each place lies in one of
    them: the lists of the rarest term choose the stretches, the other lists are intersected with those, and the positions that are left
    decide on the span itself.
    """
    windows = written(test_windows(benchmark, width), "near")
    index = build_index(docs, windows.select(F.explode("words").alias("term")))
    ranked = _rarest(index, windows, 1).select("item_id", "first", F.array_distinct("words").alias("words"), F.col("probe")[0]["term"].alias("rare")).distinct()
    blocks = index.select("doc_id", "text_key", "term", "pos", F.explode(F.array(F.expr(f"pos div {span}"), F.expr(f"pos div {span} - 1"))).alias("block"))
    blocks = blocks.groupBy("doc_id", "text_key", "block", "term").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    seeds = blocks.join(small(ranked.select("item_id", "first", "words", F.col("rare").alias("term"))), "term").select("doc_id", "text_key", "block", "item_id", "first", "words")
    wanted = seeds.select("*", F.explode("words").alias("term"))
    met = wanted.join(blocks, ["doc_id", "text_key", "block", "term"]).groupBy("doc_id", "text_key", "block", "item_id", "first", "words").agg(F.collect_list("at").alias("lists"))
    met = met.where(F.size("lists") == F.size("words"))
    # A place starts at some term's position p, and each list has a position in [p, p + span).
    starts = F.filter(F.array_sort(F.array_distinct(F.flatten("lists"))), lambda p: F.forall("lists", lambda at: F.exists(at, lambda x: (x >= p) & (x < p + span))))
    placed = met.select("doc_id", "text_key", "item_id", "first", F.try_element_at(starts, F.lit(1)).alias("start")).where(F.col("start").isNotNull())
    return placed.groupBy("doc_id", "text_key", "item_id", "first").agg(F.min("start").alias("start"))
