"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

1. The index: postings (document, position, term) of every term that the benchmark uses, stored once by
   one pass over the texts. Counts of the terms come from the postings.
2. Windows of the benchmark's words, each once, their terms in order of rarity. Windows with a term that
   no document has cannot occur.
3. The postings of a window's rarest term, moved by its offset, are where it may start. They are
   intersected with the offset-adjusted postings of its second rarest term, and then with those of all
   others: an exact phrase is a start that every list has. Proximity matches (`near`) take positions
   within a distance instead.

The smaller side of a join is broadcast only if its measured size is below a bound (BLOCK_BYTES); beyond
it both are shuffled, on keys that have one row for each place in a document.

Defined results: null and empty texts have no words and are not contaminated; null or empty items
have no window; repeated rows each get a row; rows that share a doc_id are told apart by their
texts; a null item_id has windows and counts as hit words, but is not listed; empty tables are
fine; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WorkTables, lower_ascii

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # words: what stands between runs of these
BLOCK_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    """The words, in order; the first and the last may be empty (where the text begins or ends with other characters)."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, -1)


def _bytes(df: DataFrame, size: Column | int) -> int:
    """The rows' sizes, added up."""
    return df.agg(F.coalesce(F.sum(F.lit(size) if isinstance(size, int) else size), F.lit(0))).first()[0]


def _sized(df: DataFrame, size: Column | int) -> DataFrame:
    """To be broadcast if that is below the bound."""
    return F.broadcast(df) if _bytes(df, size) <= BLOCK_BYTES else df


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """window (its words), items (ids): all runs of `size` words; an item with fewer is one window."""
    rows = items.select("item_id", F.filter(words_of(F.col("text")), lambda w: w != "").alias("words")).where("size(words) > 0")
    runs = F.expr(f"transform(sequence(0, greatest(size(words) - {size}, 0)), s -> slice(words, s + 1, {size}))")
    return rows.select("item_id", F.explode(runs).alias("window")).groupBy("window").agg(F.collect_set("item_id").alias("items"))


def index_of(docs: DataFrame, vocabulary: DataFrame, work: WorkTables) -> DataFrame:
    """doc_id, h (the text's hash), n_words, pos, term (its number): the postings of the vocabulary (term, word), stored.

    Every text also has a row at position 0, whose term may be null: those rows are the list of documents.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    n_words = F.size("words") - (F.element_at("words", 1) == "").cast("int") - ((F.element_at("words", -1) == "") & (F.size("words") > 1)).cast("int")
    tokens = rows.select("doc_id", "h", n_words.cast("long").alias("n_words"), F.posexplode("words").alias("pos", "word"))
    found = tokens.join(_sized(vocabulary, F.length("word") * 2 + 60), "word", "left").where("term is not null or pos = 0")
    return work.save(found.select("doc_id", "h", "n_words", "pos", "term"), "postings")


@dataclass
class Search:
    """The postings, and the windows that may occur: window (number), items, terms (n, at, term) from the rarest."""

    postings: DataFrame
    windows: DataFrame
    work: WorkTables

    def __post_init__(self):
        self.small = _bytes(self.windows, F.size("terms") * 24 + F.size("items") * 16 + 60) <= BLOCK_BYTES

    def documents(self) -> DataFrame:
        return self.postings.where("pos = 0").select("doc_id", "h", "n_words")

    def _window(self, *columns: str) -> DataFrame:
        rows = self.windows.selectExpr("window", *columns)
        return F.broadcast(rows) if self.small else rows

    def _starts(self) -> DataFrame:
        """doc_id, h, window, start: where each window would begin (before the text, even) by the postings of its rarest term."""
        anchors = _sized(self.windows.selectExpr("window", "terms[0].term as term", "terms[0].at as at"), 60)
        return self.work.save(self.postings.join(anchors, "term").selectExpr("doc_id", "h", "window", "pos - at as start").distinct(), "starts")

    def _lists(self, asked: DataFrame, place: str) -> DataFrame:
        """asked: doc_id, h, window, start, term and more, as s; joined by the postings (p) in that document of that term for which the place holds."""
        lists = self.postings
        for keys, size in ((["term"], 16), (["doc_id", "h"], 40)):  # only the lists and documents that are asked for, where these are few
            some = asked.select(*keys).distinct()
            if _bytes(some, size) <= BLOCK_BYTES:
                lists = lists.alias("p").join(F.broadcast(some).alias("s"), F.expr(" and ".join(f"p.{k} <=> s.{k}" for k in keys)), "left_semi")
        return lists.alias("p").join(_sized(asked, 80).alias("s"), F.expr(f"p.term = s.term and p.doc_id <=> s.doc_id and p.h = s.h and {place}"))

    def _stand(self, starts: DataFrame) -> DataFrame:
        """Of the starts those where every term of the window has a posting: first the second rarest's lists, then all others'."""
        for first, most in ((2, 1), (3, 1 << 20)):
            asked = starts.join(self._window(f"slice(terms, {first}, {most}) as terms"), "window")
            asked = asked.select("doc_id", "h", "window", "start", F.size("terms").alias("n"), F.explode("terms").alias("t")).selectExpr("*", "t.term", "t.at", "start + t.at as pos").drop("t")
            found = self._lists(asked, "p.pos = s.pos").groupBy("s.doc_id", "s.h", "s.window", "s.start", "s.n").agg(F.countDistinct("s.at").alias("met"))
            short = starts.join(self._window(f"size(terms) < {first} as done").where("done"), "window", "left_semi")  # no further term
            starts = self.work.save(found.where("met = n").select("doc_id", "h", "window", "start").unionByName(short.select("doc_id", "h", "window", "start")), f"starts-{first}")
        return starts

    def exact(self) -> DataFrame:
        """doc_id, h, start, length, items: each place where a window stands."""
        return self._stand(self._starts()).join(self._window("size(terms) as length", "items"), "window").select("doc_id", "h", "start", "length", "items")

    def near(self, slop: int) -> DataFrame:
        """doc_id, h, start, length, items, exact: where all of a window's terms stand, in any order, within its length and slop more words around its rarest; start and length are those of the words met."""
        starts = self._starts()
        asked = starts.join(self._window("terms[0].at as first", "size(terms) as size", "array_distinct(terms.term) as terms"), "window")
        asked = asked.select("doc_id", "h", "window", "start", "first", "size", F.size("terms").alias("n"), F.explode("terms").alias("term"))
        spans = self._lists(asked, f"abs(p.pos - s.start - s.first) < s.size + {slop}").groupBy("s.doc_id", "s.h", "s.window", "s.start", "s.n")
        spans = spans.agg(F.countDistinct("s.term").alias("met"), F.min("p.pos").alias("low"), F.max("p.pos").alias("high")).where("met = n").alias("a")
        stand = self._stand(starts).withColumn("exact", F.lit(True)).alias("b")
        spans = spans.join(stand, F.expr("a.doc_id <=> b.doc_id and a.h = b.h and a.window = b.window and a.start = b.start"), "left").select("a.*", F.expr("b.exact is not null").alias("exact"))
        return spans.join(self._window("items"), "window").selectExpr("doc_id", "h", "low as start", "high - low + 1 as length", "items", "exact")


def search(docs: DataFrame, items: DataFrame, size: int, work: WorkTables) -> Search:
    """The index of the documents for the items' windows of `size` words."""
    windows = work.save(windows_of(items, size).select(F.monotonically_increasing_id().alias("window"), F.col("window").alias("words"), "items"), "windows")
    words = windows.select("window", "items", F.posexplode("words").alias("at", "word"))
    vocabulary = work.save(words.select("word").distinct().select(F.monotonically_increasing_id().alias("term"), "word"), "vocabulary")
    postings = index_of(docs, vocabulary, work)
    counts = postings.where("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    counts = work.save(vocabulary.join(counts, "term", "left").select("word", "term", F.coalesce("n", F.lit(0)).alias("n")), "counts")
    terms = words.join(counts, "word").groupBy("window").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("terms"))
    live = windows.select("window", "items").join(terms.where("terms[0].n > 0"), "window")
    return Search(postings, work.save(live.select("window", "items", "terms"), "live"), work)


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, for every document."""
    index = search(docs, items, size, WorkTables(docs.sparkSession, "decontaminate"))
    found = index.exact().groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.expr(
        "aggregate(array_sort(spans), struct(0L as upto, 0L as n), (a, s) -> struct(greatest(a.upto, bigint(s.start + s.length)) as upto,"
        " a.n + greatest(0L, s.start + s.length - greatest(a.upto, bigint(s.start))) as n), a -> a.n)"
    )
    found = found.select("doc_id", "h", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").alias("ids"))
    found = _sized(index.work.save(found, "found"), F.length("ids") + 80)
    out = index.documents().alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.h = f.h"), "left")
    n_hit = F.coalesce("f.n_hit", F.lit(0).cast("long"))
    return out.select(
        "d.doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents in which no window stands, all columns as they were."""
    index = search(docs, items, size, WorkTables(docs.sparkSession, "decontaminate"))
    hit = _sized(index.work.save(index.exact().select("doc_id", "h").distinct(), "hit"), 40)
    rows = docs.withColumn("__h", F.xxhash64("text"))
    return rows.alias("d").join(hit.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.__h = f.h"), "left_anti").select(*docs.columns)
