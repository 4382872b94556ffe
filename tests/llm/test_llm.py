"""The operators against plain versions, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

pytestmark = pytest.mark.filterwarnings("ignore")
SF = "/root/testdata/sf0.001"

#: Columns whose names the operators use inside.
CLASHING = "length, offset, score, h, k, lo, n, v, list, block, part, words, window, term, start, spans, base, value, rank, fp, least, root, label, __id"


@pytest.fixture(scope="module")
def vocab():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark, texts, ids=None):
    """documents with more columns, whose names clash."""
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), *(F.lit(7).alias(c) for c in CLASHING.split(", ")))


def prose(rng, n):
    syllables = "the an er ti on re ha st en ou lo me ka ru".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


EDGES = [None, "", "   \n\t ", "word", "Ünï çödé ÉÈ", "a" * 50_000, "1" * 30_000, "." * 20_000, "a@" * 9_000, "x" + " y" * 30_000, "same text here", "same text here", "\x00\x1f odd\u2028bytes"]


# Packing and token files


def ids_of(vocab, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("seed", range(4))
def test_pack_counts_fills_whole_sequences(seed):
    from gridloom.llm.packing import pack_counts

    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    counts = {int(n): int(rng.integers(0, 40)) for n in rng.integers(1, size + 1, 30)}
    plan, total = pack_counts(counts, size)
    filled: dict = {}
    seen = dict.fromkeys(counts, 0)
    for length, a, b, per, seq, off in plan.tolist():
        assert a == seen[length]
        seen[length] = b
        for k in range(b - a):
            filled.setdefault(seq + k // per, []).append((off + k % per * length, length))
    assert seen == counts
    assert len(filled) == total
    for parts in filled.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= size
    tokens = sum(n * c for n, c in counts.items())
    large = sum(c for n, c in counts.items() if 2 * n > size)
    assert total <= max(1.25 * max(-(-tokens // size), large), 1)


def test_packing(spark, vocab):
    from gridloom.llm.packing import pack_documents, sequences

    rng = random.Random(1)
    texts = EDGES + [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    df = table(spark, texts)
    got = pack_documents(df, 64, vocab, 0).collect()
    want = ids_of(vocab, texts, 0)
    pieces = {(r["doc_id"], r["piece"]): r for r in got}
    filled: dict = {}
    for doc, ids in enumerate(want):
        cuts = [ids[a : a + 64] for a in range(0, len(ids), 64)]
        for k, part in enumerate(cuts):
            r = pieces.pop((doc, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (64 * k, len(part), crc(part))
            filled.setdefault(r["sequence_id"], []).append((r["offset"], part))
    assert not pieces
    for parts in filled.values():
        at = 0
        for off, part in sorted(parts):
            assert off == at
            at += len(part)
        assert at <= 64
    small = table(spark, texts[-5:])
    packed = pack_documents(small, 64, vocab, 0)
    rows = {r["sequence_id"]: r["ids"] for r in sequences(packed, small, vocab, 0).collect()}
    whole = ids_of(vocab, texts[-5:], 0)
    for r in packed.collect():
        assert rows[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def test_token_files(spark, vocab):
    from gridloom.llm.token_files import token_table

    texts = EDGES + ["one more"]
    ids = [*range(100, 100 + len(EDGES)), None]
    got = [tuple(r) for r in token_table(table(spark, texts, ids), vocab, 2).orderBy("start").collect()]
    order = sorted(range(len(ids)), key=lambda k: -1 if ids[k] is None else ids[k])
    at = 0
    want = []
    tokens = ids_of(vocab, texts, 2)
    for k in order:
        want.append((ids[k], at, len(tokens[k]), crc(tokens[k])))
        at += len(tokens[k])
    assert got == want


def test_repeated_rows_and_empty_tables(spark, vocab):
    from gridloom.llm.packing import pack_documents
    from gridloom.llm.token_files import token_table

    twice = table(spark, ["a b c"] * 3, [5, 5, 5])
    assert token_table(twice, vocab, 2).count() == 3
    got = pack_documents(twice, 8, vocab, 0).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3
    none = twice.limit(0)
    assert token_table(none, vocab, 2).count() == 0
    assert pack_documents(none, 8, vocab, 0).count() == 0


def test_word_cache_is_exact(vocab):
    from gridloom.llm.tokens import WordEncoder

    rng = random.Random(3)
    marks = list("aAbZéÉİıſßÇ'’.,!?#* \n\t\u2028\x01ćΣσς٣漢") + ["<|endoftext|>", "'s", "don't", "I'LL", "\u00a0", "e\u0301"]
    enc = WordEncoder(vocab, cached_words=50)
    for _ in range(800):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 14)))
        assert enc.encode([text])[0] == enc._whole(text), repr(text)


# Neighbours


def test_neighbours(spark):
    from gridloom.llm.neighbours import nearest

    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 24))
    x[200:500] = x[200]  # a third are one vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] + [1.0] * 23), (9004, [None] + [1.0] * 23), (9005, [float("inf")] + [1.0] * 23), (9006, [1.0]), (None, [1.0] * 24), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("block", F.lit(2))
    got: dict = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 900, 50))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, ranks in got.items():
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(900), -s.round(12)))[:5]
        assert sorted(ranks) == [1, 2, 3, 4, 5]
        if 200 <= q < 500:
            assert [ranks[k][0] for k in range(1, 6)] == [v for v in range(200, 206) if v != q][:5]
        hits += len({v for v, _ in ranks.values()} & set(best.tolist()))
        for v, score in ranks.values():
            assert abs(score - s[v]) < 1e-12
    assert hits >= 0.9 * 5 * len(got)
    few = df.where("vec_id < 3 or vec_id > 9000")
    assert nearest(few, F.col("vec_id") == 0, 5).count() == 2
    assert nearest(df.limit(0), F.col("vec_id") == 0, 5).count() == 0


def test_neighbours_beyond_small_lists(spark, monkeypatch):
    from gridloom.llm import neighbours

    monkeypatch.setattr(neighbours, "centroids", lambda x, lists: np.eye(3))
    monkeypatch.setattr(neighbours, "lists_to_probe", lambda x, c, k: 1)
    rows = [(v, [1.0, 0.01 * v, 0.0]) for v in range(3)] + [(v, [0.2, 1.0, 0.01 * v]) for v in range(3, 40)] + [(v, [0.1, 0.01 * v, 1.0]) for v in (40, 41)] + [(0, [1.0, 0.0, 0.0])] * 4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_ids(neighbours.nearest(df, F.col("vec_id").isin(0, 41), 5))
    assert {q: len(v) for q, v in got.items()} == {0: 5, 41: 5}
    assert set(got[0]) >= {1, 2} and 40 in got[41]


def nearest_ids(found):
    out: dict = {}
    for r in found.collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


# Personal data


def test_base_spans(spark):
    from gridloom.llm.pii import span_table

    rng = random.Random(5)
    parts = ["a@b.c", "a.@b.c.d", "x@y.com_foo@z.org", "@b.c", "a@b..c", "a@-.c", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "4111111111111111", "79927398713", "6011000990139424-", "+1 (724) 555-7058", "+1 (724) 555", "+12345678901234567", "+(1)", "é", " ", " ", ".", "-", "9", "@", "+", "\n", "x"]
    texts = EDGES + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    got = {r["doc_id"]: r for r in span_table(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        if t in (EDGES[5], EDGES[6], EDGES[8]):  # the plain expressions need minutes there
            continue
        want, r = brute.base_spans(t), got[k]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, r["spans"])
        assert [r[f"n_{kind}"] for kind in brute.BASE] == [sum(s.startswith(kind) for s in want) for kind in brute.BASE]
    assert span_table(table(spark, [""]).limit(0)).count() == 0


def test_contexts_find_more(spark):
    from gridloom.llm.pii import span_table, without_personal_data

    texts = [f"number {k} then the account holder reached at user{k}@mail.example.com for all further questions" for k in range(12)]
    texts.append("then the account holder reached at QX77-8812-KK for all further questions")
    texts.append("a plain part number AB12345678 in a list of parts")
    df = table(spark, texts)
    got = {r["doc_id"]: r["spans"] for r in span_table(df).collect()}
    assert got[12] == f"context:{texts[12].index('QX77')}:{texts[12].index(' for all')}"
    assert got[13] == ""
    clean = {r["doc_id"]: r for r in without_personal_data(df).collect()}
    assert clean[12]["text"] == "then the account holder reached at [CONTEXT] for all further questions"
    assert "[EMAIL]" in clean[0]["text"] and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[13]["text"] == texts[13] and clean[0].asDict().keys() == set(df.columns)
    nulls = without_personal_data(table(spark, EDGES + [None])).collect()
    assert sum(r["text"] is None for r in nulls) == 2


# Classifiers


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def harsh(rng, k):
    """(text, toxic): some texts hold one of two insults, plain, gapped or stuffed."""
    w = prose(rng, 60).split()
    if k % 3 == 0:
        for _ in range(3):
            insult = rng.choice(["zorbwit", "grumplex"])
            shape = rng.choice([insult, insult, insult[:3] + "x" + insult[3:], ".".join(insult), " ".join(insult), insult + "ish"])
            w.insert(rng.randrange(len(w)), shape)
    return " ".join(w), int(k % 3 == 0)


def test_toxicity_learns_and_holds_out(spark):
    from gridloom.llm.toxicity import toxicity, without_toxic

    rng = random.Random(7)
    rows = [harsh(rng, k) for k in range(500)]
    df = table(spark, [t for t, _ in rows])
    marks = labels(spark, [(k, 1, y) for k, (_, y) in enumerate(rows)] + [(3, None, None), (None, 1, 1)])
    got = {r["doc_id"]: r for r in toxicity(df, marks).collect()}
    assert len(got) == 500
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    out = [k for k, r in got.items() if r["held_out"]]
    assert np.mean([got[k]["predicted"] == rows[k][1] for k in out]) > 0.95
    # Labels of rows that are held out change nothing.
    other = labels(spark, [(k, 1, 1 - y if got[k]["held_out"] else y) for k, (_, y) in enumerate(rows)])
    again = {r["doc_id"]: r["score"] for r in toxicity(df, other).collect()}
    assert all(abs(again[k] - got[k]["score"]) < 1e-9 for k in got)
    kept = without_toxic(df, marks)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["predicted"]}


def test_classifiers_on_corners(spark):
    from gridloom.llm.quality import quality
    from gridloom.llm.toxicity import toxicity

    df = table(spark, EDGES + ["null id"], [*range(len(EDGES)), None])
    one_class = labels(spark, [(1, 1, 0), (2, 1, 0)])
    both = labels(spark, [(k, k % 2, k % 2) for k in range(len(EDGES))])
    for f, none in ((toxicity, 0.0), (quality, 0.5)):
        assert {r["score"] for r in f(df, one_class).collect()} == {none}
        got = f(df, both).collect()
        assert len(got) == len(EDGES) + 1 and all(0 <= r["score"] <= 1 for r in got)
        assert f(df.limit(0), both).count() == 0


def test_quality_learns(spark):
    from gridloom.llm.quality import quality

    rng = random.Random(9)
    junk = [lambda t: "!! ".join(t.upper().split()), lambda t: " ".join([t.split()[0]] * 60), lambda t: "### ".join(t.split())]
    rows = [(t := prose(rng, 60), 1) if k % 3 else (rng.choice(junk)(prose(rng, 60)), 0) for k in range(400)]
    got = {r["doc_id"]: r for r in quality(table(spark, [t for t, _ in rows]), labels(spark, [(k, y, 0) for k, (_, y) in enumerate(rows)])).collect()}
    out = [k for k, r in got.items() if r["held_out"]]
    assert np.mean([got[k]["predicted"] == rows[k][1] for k in out]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


# Near duplicates


def test_simhash_components(spark):
    from gridloom.llm.simhash import near_duplicates

    rng = random.Random(11)
    texts = list(EDGES)
    for _ in range(25):
        w = prose(rng, rng.randint(3, 200)).split()
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v).replace("the", "THE"))
    ids = list(range(1000, 1000 + len(texts)))
    prints = [brute.simhash(t, 3) for t in texts]
    for radius in (0, 1, 2):
        got = {r["doc_id"]: r for r in near_duplicates(table(spark, texts, ids), 3, radius).collect()}
        roots = brute.classes(prints, lambda a, b, radius=radius: bin(a ^ b).count("1") <= radius)
        assert [(got[i]["fingerprint"], got[i]["component_id"]) for i in ids] == [(f"{p:016x}", ids[r]) for p, r in zip(prints, roots)]
    assert near_duplicates(table(spark, [""]).limit(0)).count() == 0


def test_null_ids_link(spark):
    from gridloom.llm.simhash import near_duplicates, one_of_each

    df = table(spark, ["a b c d e f", "a b c d e f", "z y x w v u", "z y x w v u", "z y x w v u"], [None, 4, None, None, None])
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(df, 3).collect()), key=str)
    assert got == [(4, 4), (None, 4), (None, None), (None, None), (None, None)]
    kept = one_of_each(df).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, "z y x w v u"), (4, "a b c d e f")]


def test_long_chains_are_one_component(spark, tmp_path):
    from gridloom.llm.common import WorkTables
    from gridloom.llm.components import components

    n = 300
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 1001), (1001, 1001)], "a long, b long"))
    got = components(links.sample(1.0, seed=1), WorkTables(spark, "test")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(k, 0) for k in range(n)} | {(1000, 1000), (1001, 1000)}


def test_one_of_each_group_stays(spark):
    from gridloom.llm.simhash import one_of_each

    rng = random.Random(13)
    texts, family = [], []
    for f in range(40):
        w = prose(rng, 300).split()
        for c in range(1 + f % 4):
            v = list(w)
            if c:
                for _ in range(2 * c):  # at 300 words, 2 to 6 changes keep the similarity above 0.8
                    v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
            family.append(f)
    df = table(spark, texts)
    kept = [r["doc_id"] for r in one_of_each(df).collect()]
    assert one_of_each(df).columns == df.columns
    assert {family[k] for k in kept} == set(range(40))  # none of a family's all go
    extra = [k for k in kept if any(brute.jaccard(texts[k], texts[o], 5) >= 0.8 for o in kept if o < k and family[o] == family[k])]
    assert len(extra) <= 0.05 * (len(texts) - 40)
    edges = one_of_each(table(spark, EDGES)).collect()
    assert sum(r["text"] == "same text here" for r in edges) == 1


def groups_of(spark, texts, family):
    """The families that each group of similar documents has, a family for each member."""
    from gridloom.llm.simhash import similar_documents

    groups: dict = {}
    for r in similar_documents(table(spark, texts)).collect():
        groups.setdefault(r["group"], []).append(family[r["doc_id"]])
    return sorted(tuple(sorted(g)) for g in groups.values())


def with_changes(words, n):
    """Every change takes five of the shingles, where the words are many."""
    return " ".join("changed%d" % k if k in range(10, 10 + 30 * n, 30) else w for k, w in enumerate(words))


def test_crowded_family_is_compared_whole(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(50_000)]
    passage, texts, family = rng.choices(words, k=150), [], []
    for f in range(1500):  # a third of all shingles are the passage's, and each text has one copy at 0.8 or more
        own = rng.choices(words, k=150)
        texts += [" ".join(own + passage), with_changes(own + passage, 2 + f % 4)]
        family += [f, f]
    assert all(brute.jaccard(texts[a], texts[a + 1], 5) >= 0.8 for a in range(0, 80, 2))
    assert groups_of(spark, texts, family) == [(f, f) for f in range(1500)]


def test_all_pairs_at_the_similarity_are_found(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(50_000)]
    texts, family = [], []
    for f in range(400):
        w = rng.choices(words, k=300)
        texts += [" ".join(w), with_changes(w, 6)]
        family += [f, f]
    assert all(0.8 <= brute.jaccard(texts[a], texts[a + 1], 5) < 0.83 for a in range(0, 80, 2))
    assert groups_of(spark, texts, family) == [(f, f) for f in range(400)]


def test_less_similar_documents_stay_apart(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(50_000)]
    texts, family = [], []
    for f in range(400):
        w = rng.choices(words, k=300)
        texts += [" ".join(w), with_changes(w, 7)]
        family += [f, f]
    assert all(0.77 <= brute.jaccard(texts[a], texts[a + 1], 5) < 0.8 for a in range(0, 80, 2))
    assert groups_of(spark, texts, family) == sorted((f,) for f in family)


# URL filters


def test_url_rules(spark):
    from gridloom.llm.queries import RULES
    from gridloom.llm.url_filters import judge

    urls = [
        None, "", "no scheme/en/", "http://", "http://com/en/x", "https://A.Example.COM/en/7/x?y#z", "http://example.com/en/8", "http://notexample.com/en/7", "http://.com/en/", "http://com.evil.org/en/", "x://y://com/en/",
        "http://b.net/de/1", "http://example.net/de/8", "http://a.example.net/de/88", "http://org/es", "http://a.org/es/#f", "http://a.org?/es/", "http://ÄÉ.org/es/", "http://com:80/en/", "http://com/en/\nx", "http://" + "a." * 3000 + "org/es/" + "z" * 5000,
    ]
    rows = [(k, u) for k, u in enumerate(urls * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: r for r in judge(df, rules).collect()}
    import re

    for k, u in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(brute.LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, rule, verdict), u
    assert judge(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge(df, rules.limit(0)).collect()} == {"allow"}


def test_large_list_goes_through_the_filter(spark):
    from gridloom.llm.url_filters import judge

    rules = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".com/x")).alias("url"))
    got = judge(pages, rules).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"block": 5000, "allow": 15000}


# Repeated substrings


@pytest.mark.parametrize("threshold", [8, 20])
def test_repeated_substrings(spark, threshold):
    from gridloom.llm.suffix_dedup import remove_repeated

    rng = random.Random(threshold)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    shared = [word(rng.randint(5, 60), "abcdefghij") for _ in range(6)]
    texts = [None, "", "short", "é" * 30, "ab" * 40, "a" * 300, "abc" * 25, "same text of some length", "same text of some length"]
    for _ in range(60):
        texts.append(word(rng.randint(0, 90), "abcdefghijklmnopqrstuvwxyz ") + rng.choice(shared) + word(rng.randint(0, 40), "ab é") + rng.choice(["", rng.choice(shared)]))
    got = {r["doc_id"]: r for r in remove_repeated(table(spark, texts), threshold).collect()}
    for k, (t, mask) in enumerate(zip(texts, brute.repeated(texts, threshold))):
        raw = (t or "").encode()
        kept = bytes(c for c, m in zip(raw, mask) if not m)
        runs = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["kept_sha256"]) == (len(raw), sum(mask), runs, kept, hashlib.sha256(kept).hexdigest()), t
    assert remove_repeated(table(spark, [""]).limit(0), threshold).count() == 0


def test_texts_longer_than_a_segment(monkeypatch):
    from gridloom.llm import suffix_dedup as S

    monkeypatch.setattr(S, "SEGMENT", 64)
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdef") for _ in range(500))
    got = sorted((int(p), int(n)) for of, lo, size, *_ in S.runs([text, b"x" * 5, text], 16) for t, p, n in zip(of, lo, size) if t == 2)
    assert got[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and sum(got[-1]) == 500 - 15


def test_repeated_rows_are_repeated_texts(spark):
    from gridloom.llm.suffix_dedup import remove_repeated

    got = remove_repeated(table(spark, ["0123456789abcdef"] * 2, [1, 1]), 8).collect()
    assert [r["n_removed"] for r in got] == [16, 16]


# Decontamination


def test_contamination(spark):
    from gridloom.llm.decontaminate import clean_documents, contamination

    rng = random.Random(17)
    items = [(1, prose(rng, 25)), (2, "Three little words"), (3, None), (4, " .. "), (10, prose(rng, 10)), (10, prose(rng, 12)), (None, "unnamed item of five words")]
    texts = list(EDGES) + ["the the the"]
    for _ in range(40):
        w = prose(rng, rng.randint(0, 60)).split()
        source = rng.choice(items)[1] or ""
        part = source.split()[rng.randrange(3) :]
        at = rng.randrange(len(w) + 1)
        texts.append(rng.choice([" ", ", ", "\n"]).join(w[:at] + part + w[at:]).upper())
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1)).withColumn("words", F.lit(2))
    df = table(spark, texts)
    got = {r["doc_id"]: r for r in contamination(df, bench).collect()}
    want = brute.contamination(texts, items, 10)
    for k, (n, hit, ids) in enumerate(want):
        listed = ",".join(sorted(str(i) for i in ids if i is not None))
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(ids - {None}), hashlib.sha256(listed.encode()).hexdigest(), hit > 0), texts[k]
    assert any(h for _, h, _ in want)
    kept = clean_documents(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, (_, h, _) in enumerate(want) if not h}
    assert contamination(df.limit(0), bench).count() == 0
    assert contamination(df, bench.limit(0)).where("contaminated").count() == 0
    twice = contamination(table(spark, ["three little words"] * 2, [None, None]), bench).collect()
    assert [r["n_hit"] for r in twice] == [3, 3]


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    from gridloom.llm import decontaminate as D

    rng = random.Random(19)
    items = [(k, prose(rng, 20)) for k in range(20)]
    texts = [f"{prose(rng, 5)} {items[k][1]} {prose(rng, 5)}" for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in D.contamination(table(spark, texts), bench).collect())
    monkeypatch.setattr(D, "BLOCK_BYTES", -1)
    assert sorted(tuple(r) for r in D.contamination(table(spark, texts), bench).collect()) == whole


def test_proximity(spark):
    from gridloom.llm.common import WorkTables
    from gridloom.llm.decontaminate import search

    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    texts = ["x alpha beta gamma delta y", "delta so gamma then beta alpha", "alpha beta x x x x x x x x gamma delta", "alpha beta gamma"]
    index = search(table(spark, texts), bench, 10, WorkTables(spark, "near"))
    assert {(r["doc_id"], r["start"], r["length"], r["exact"]) for r in index.near(2).collect()} == {(0, 1, 4, True), (1, 0, 6, False)}
    # From the rarest term on.
    assert [t["n"] for t in index.windows.first()["terms"]] == [3, 4, 4, 4]


# Pipeline


def test_pipeline(spark, vocab):
    import corpus_pipeline as P
    from gridloom.llm.common import documents_of

    docs = documents_of(spark, SF)
    columns, seen = docs.columns, docs
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, seen, SF)
        if name == "packing":
            break
        assert out.columns == columns
        out = out.cache()
        left = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(left) <= set(rows)
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in documents_of(spark, SF, "benchmark").collect()]
            hit = brute.contamination(rows.values(), items, 10)
            assert set(left) == {d for d, (_, h, _) in zip(rows, hit) if not h}
        if name == "personal_data":
            assert set(left) == set(rows) and not any(brute.base_spans(t) for t in left.values())
        if name == "near_duplicates":
            gone = set(rows) - set(left)
            assert all(max(brute.jaccard(rows[d], t, 5) for o, t in rows.items() if o != d) > 0.6 for d in gone)
        seen, rows = out, left
    got = out.collect()
    tokens = dict(zip(rows, ids_of(vocab, list(rows.values()), 0)))
    total: dict = {}
    for r in got:
        part = tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == crc(part)
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {d: len(t) for d, t in tokens.items()}
    assert P.run(spark, SF).count() == len(got)


def test_queries_have_unique_names_and_sql_that_fits():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and "pipeline" in names


def test_balls_give_candidates_of_the_similar_stage(spark, tmp_path):
    from gridloom.llm.common import WorkTables
    from gridloom.llm.simhash import _met_in_balls

    classes = spark.createDataFrame([(1, 0), (2, 0), (3, 3), (4, 255), (5, 254), (6, 1 << 40 | 7 << 50)], "c long, f0 long")
    got = {tuple(sorted(r)) for r in _met_in_balls(classes, WorkTables(spark, "balls")).collect()}
    assert got == {(1, 2), (1, 3), (4, 5)}
