"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame operations only.

Base spans of four kinds are found by regular expressions. They are the seeds: the words around
them are lexical patterns (two words before, two after, one on each side). A pattern's confidence
is the share of seeds among the different identifier-like strings seen in it; an instance's is one
less the product of its patterns' doubts. Strings found with confidence are seeds of the next
round, until a round finds nothing new. What the last patterns find are spans of kind `context`.

Regular expressions here have no repeated groups (on Java each repetition of a group costs stack,
and a long text would overflow it) and look back to a run's first character, so that a text is read
in time proportional to its length. Where a character must not count (a dot or separator that
nothing follows) an equally long copy of the text has another there, so positions hold.

Positions: matches and the pieces between them (`split`) have lengths, in code points, that add up.

Defined results: null and empty texts have no spans; repeated rows each get a row; rows that share a
doc_id are told apart by their texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WorkTables

KINDS = ["email", "ip", "card", "phone", "context"]
LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]{11,}"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
LIKE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{8,}+"
MIN_DIGITS = 4  # of an identifier-like string
CONTEXT = (60, 2000, 1 << 30)  # characters on each side in which its two words are sought, one after the other

SPAN = "array<struct<s:int,k:int,e:int>>"


def _spans(m: str, g: str, k: int, valid: str) -> Column:
    """Spans of the matches (array column m; g: the pieces between them) for which `valid`, SQL over x, holds."""
    valid = re.sub(r"\bx\b", f"{m}[i]", valid)
    step = f"named_struct('at', a.at + length({g}[i]) + length({m}[i]), 'out', if({valid}, concat(a.out, array(named_struct('s', a.at + length({g}[i]), 'k', {k}, 'e', a.at + length({g}[i]) + length({m}[i])))), a.out))"
    return F.expr(f"if(coalesce(size({m}), 0) < 1, cast(array() as {SPAN}), aggregate(sequence(0, size({m}) - 1), named_struct('at', 0, 'out', cast(array() as {SPAN})), (a, i) -> {step}, a -> a.out))")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


#: Luhn's sum over the digits from the right, every second one doubled (less 9 if over 9).
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (t, p) -> t + if(p % 2 = 1, int(substr({d}, length({d}) - p + 1, 1)),"
    " int(substr({d}, length({d}) - p + 1, 1)) * 2 - if(int(substr({d}, length({d}) - p + 1, 1)) > 4, 9, 0))) % 10 = 0"
)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), base spans, and seen: base and identifier-like strings with the words around them."""
    t = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("t"))
    copies = {
        "email": F.when(F.col("t").contains("@"), F.regexp_replace("t", r"\.(?![A-Za-z0-9-])", "_")),
        "ip": F.when(F.col("t").rlike(r"[0-9]\.[0-9]"), F.col("t")),
        "card": F.when(F.col("t").rlike(r"[0-9][0-9 -]{11}"), F.regexp_replace("t", r"[ -](?![0-9])|(?<![0-9])[ -]", "x")),
        "phone": F.when(F.col("t").contains("+"), F.col("t")),
        "like": F.when(F.col("t").rlike("[0-9]"), F.col("t")),
    }
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "like": LIKE}
    t = t.select("*", *(c.alias(f"t_{n}") for n, c in copies.items()))
    t = t.select("doc_id", "h", "t", *(x for n, p in patterns.items() for x in (F.regexp_extract_all(f"t_{n}", F.lit(p), 0).alias(f"m_{n}"), F.split(f"t_{n}", p, -1).alias(f"g_{n}"))))
    part = "regexp_extract(x, '([0-9]+)[.]([0-9]+)[.]([0-9]+)[.]([0-9]+)', {})"
    small = " and ".join(f"({part.format(k)} rlike '^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')" for k in (1, 2, 3, 4))
    d = _digits("x")
    t = t.select(
        "doc_id", "h", "t",
        F.array_sort(F.concat(_spans("m_email", "g_email", 0, "true"), _spans("m_ip", "g_ip", 1, small), _spans("m_card", "g_card", 2, f"length({d}) between 12 and 19 and {_LUHN.format(d=d)}"), _spans("m_phone", "g_phone", 3, f"length({d}) between 9 and 15"))).alias("base"),
        _spans("m_like", "g_like", 4, f"length({d}) >= {MIN_DIGITS}").alias("like"),
    )
    before, after = _around(CONTEXT)
    seen = F.expr(f"transform(concat(base, like), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'value', substr(t, x.s + 1, x.e - x.s), 'l', {before}, 'r', {after}))")
    return t.select("doc_id", "h", "base", seen.alias("seen"))


def _around(sizes: tuple[int, ...]) -> tuple[str, str]:
    """SQL for the last two words before x and the first two after it. A part of the text will do if it has three (the outermost may be cut) or reaches the text's end."""
    n, more = sizes[0], sizes[1:]
    left = f"filter(split(lower(substr(t, greatest(x.s - {n}, 0) + 1, least(x.s, {n}))), '\\\\s+'), w -> w <> '')"
    right = f"filter(split(lower(substr(t, x.e + 1, {n})), '\\\\s+'), w -> w <> '')"
    last, first = f"slice({left}, -least(2, size({left})), 2)", f"slice({right}, 1, 2)"
    last = f"if(size({left}) = 0, {left}, {last})"
    if not more:
        return last, first
    further = _around(more)
    return f"if(x.s <= {n} or size({left}) > 2, {last}, {further[0]})", f"if(length(t) - x.e <= {n} or size({right}) > 2, {first}, {further[1]})"


def _patterns() -> Column:
    """The lexical patterns of l and r, the words before and after: null where a text ends first."""
    return F.expr(
        "array_compact(array(if(size(l) > 1, concat('< ', l[size(l) - 2], ' ', l[size(l) - 1]), null),"
        " if(size(r) > 1, concat('> ', r[0], ' ', r[1]), null),"
        " if(size(l) > 0 and size(r) > 0, concat('= ', l[size(l) - 1], ' ', r[0]), null)))"
    )


def bootstrap(seen: DataFrame, work: WorkTables, rounds: int | None = None, min_seeds: int = 2, min_confidence: float = 0.8) -> DataFrame:
    """Values (of kind `context`) found by patterns that enough different seeds induce: value, with its place doc_id, h, s, e.

    seen: doc_id, h, s, k, e, value, l, r. The graph's edges are the different (pattern, value) pairs, so
    a passage that many documents share counts once.
    """
    known = f"k < {KINDS.index('context')}"
    placed = seen.select("doc_id", "h", "s", "e", "value", F.expr(known).alias("seed"), F.explode(_patterns()).alias("pattern"))
    edges = work.save(placed.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    found = None
    for at in count():
        before = found
        now = edges if found is None else edges.join(found.withColumn("more", F.lit(True)), "value", "left").select("pattern", "value", F.expr("seed or coalesce(more, false)").alias("seed"))
        scores = now.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.count("*").alias("n"))
        # Laplace's rule keeps a pattern with few seeds from certainty.
        scores = scores.where(f"seeds >= {min_seeds}").selectExpr("pattern", "(seeds + 1) / (n + 2) as confidence")
        scores = scores.where("confidence >= 0.5")
        doubts = edges.where("not seed").join(scores, "pattern").groupBy("value").agg(F.sum(F.log(1 - F.col("confidence"))).alias("doubt"))
        sure = doubts.where(1 - F.exp("doubt") >= min_confidence).select("value")
        found = work.save(sure if found is None else sure.union(found).distinct(), f"found-{at}")
        if at + 1 == rounds or found.count() == (before.count() if before is not None else 0):
            break  # as many as the round before: nothing new, as none is ever lost
    new = placed.where("not seed").select("doc_id", "h", "s", "e", "value").distinct().join(found, "value")
    return new.select("doc_id", "h", "s", "e")


def _clear(seen: DataFrame) -> DataFrame:
    """Without identifier-like strings that overlap a base span of the same text."""
    before = Window.partitionBy("doc_id", "h").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id", "h").orderBy("s", "k").rowsBetween(1, Window.unboundedFollowing)
    base = F.expr("k < 4")
    rows = seen.select("*", F.max(F.when(base, F.col("e"))).over(before).alias("ended"), F.min(F.when(base, F.col("s"))).over(after).alias("begins"))
    return rows.where("k < 4 or ((ended is null or ended <= s) and (begins is null or begins >= e))").drop("ended", "begins")


def personal_data(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id, h, base (spans of the four kinds) and added (those found by context), for every document."""
    work = WorkTables(docs.sparkSession, "pii")
    scanned = work.save(scan(docs), "scanned")
    seen = scanned.select("doc_id", "h", F.explode("seen").alias("x")).select("doc_id", "h", "x.*").dropDuplicates(["doc_id", "h", "s", "k"])  # repeated rows count once
    new = bootstrap(work.save(_clear(seen), "seen"), work, rounds)
    added = new.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.expr("named_struct('s', s, 'k', 4, 'e', e)"))).alias("added"))
    out = scanned.select("doc_id", "h", "base").alias("d").join(added.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.h = f.h"), "left")
    return out.select("d.doc_id", "d.h", "base", F.coalesce("added", F.expr(f"cast(array() as {SPAN})")).alias("added"))


def _written(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")


def span_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = personal_data(docs).withColumn("all", F.array_sort(F.concat("base", "added")))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("all").alias("spans"))


def redacted(text: str, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first replaces and the rest of the next goes with it."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    step = f"named_struct('at', greatest(a.at, x.e), 'out', if(x.s < a.at, a.out, concat(a.out, array(substr({text}, a.at + 1, x.s - a.at), array({names})[x.k]))))"
    return F.expr(f"if(size({spans}) = 0, {text}, aggregate({spans}, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> {step}, a -> concat(array_join(a.out, ''), substr({text}, a.at + 1))))")


def without_personal_data(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """All documents with their spans redacted and n_chars (if they have it) counted anew, all other columns as they were."""
    found = personal_data(docs, rounds).where("size(base) + size(added) > 0").select("doc_id", "h", F.array_sort(F.concat("base", "added")).alias("spans")).distinct()
    rows = docs.select(*(F.col(f"`{c}`").alias(f"d{k}") for k, c in enumerate(docs.columns)), F.xxhash64("text").alias("__h"))
    text, doc_id = (f"d{docs.columns.index(c)}" for c in ("text", "doc_id"))
    rows = rows.alias("d").join(found.alias("f"), F.expr(f"d.{doc_id} <=> f.doc_id and d.__h = f.h"), "left")
    new = F.when(F.col("spans").isNull(), F.col(text)).otherwise(redacted(text, "spans"))
    rows = rows.withColumn("__text", new)
    put = {"text": F.col("__text"), "n_chars": F.when(F.col("spans").isNull(), F.col(f"d{docs.columns.index('n_chars')}")).otherwise(F.length("__text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    return rows.select(*(put.get(c, F.col(f"d{k}")).alias(c) for k, c in enumerate(docs.columns)))
