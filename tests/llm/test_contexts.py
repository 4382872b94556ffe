"""The bootstrap of personal data against a plain version, and whole words and identifiers of any length."""

import math
import random

import pytest
from test_llm import table


def plain_bootstrap(seen, min_seeds=2, min_confidence=0.8):
    edges, places = {}, {}
    for doc, s, k, e, value, left, right in seen:
        patterns = ([f"< {left[-2]} {left[-1]}"] if len(left) > 1 else []) + ([f"> {right[0]} {right[1]}"] if len(right) > 1 else []) + ([f"= {left[-1]} {right[0]}"] if left and right else [])
        for p in patterns:
            edges[p, value] = edges.get((p, value), False) or k < 4
        if k == 4:
            places.setdefault(value, set()).add((doc, s, e, bool(patterns)))
    found = set()
    while True:
        confidence = {}
        for p in {p for p, _ in edges}:
            own = [(v, seed or v in found) for (q, v), seed in edges.items() if q == p]
            seeds = sum(s for _, s in own)
            if seeds >= min_seeds and (c := (seeds + 1) / (len(own) + 2)) >= 0.5:
                confidence[p] = c
        doubt = {}
        for (p, v), seed in edges.items():
            if not seed and p in confidence:
                doubt[v] = doubt.get(v, 0) + math.log(1 - confidence[p])
        new = found | {v for v, d in doubt.items() if 1 - math.exp(d) >= min_confidence}
        if new == found:
            return {(doc, s, e) for v in found for doc, s, e, known in places.get(v, ()) if known}
        found = new


@pytest.mark.parametrize("seed", range(3))
def test_bootstrap_equals_the_plain_version(spark, seed):
    from gridloom.llm.common import WorkTables
    from gridloom.llm.pii import bootstrap

    rng = random.Random(seed)
    word = lambda: rng.choice("call mail id no ref user at is".split())
    seen = []
    for k in range(150):
        kind = rng.choice([0, 1, 4, 4, 4])
        seen.append((k % 40, 100 * k, kind, 100 * k + 9, f"{kind < 4}{rng.randrange(30)}", [word() for _ in range(rng.randrange(3))], [word() for _ in range(rng.randrange(3))]))
    rows = [(d, 0, s, k, e, v, a, b) for d, s, k, e, v, a, b in seen]
    df = spark.createDataFrame(rows, "doc_id long, h long, s int, k int, e int, value string, l array<string>, r array<string>")
    got = {(r["doc_id"], r["s"], r["e"]) for r in bootstrap(df, WorkTables(spark, "boot")).collect()}
    want = plain_bootstrap(seen)
    assert got == want
    if seed == 0:
        assert want


def test_long_identifiers_and_context_words(spark):
    from gridloom.llm.pii import span_table

    far, near = "w" * 100, "v" * 3000
    texts = [f"{k} words {far} {near} user{k}@mail.example.com {near} {far} more {k}" for k in range(12)]
    secret = "QX77-" + "A1" * 33 + "-Z"
    assert len(secret) > 72 - 2
    texts += [f"other {far} {near} {secret} {near} {far} end"] * 2
    texts += [f"other x{far} {near} {secret[:-2]}-Y {near} {far}x end"]
    got = {r["doc_id"]: r["spans"] for r in span_table(table(spark, texts)).collect()}
    at = texts[12].index(secret)
    assert got[12] == got[13] == f"context:{at}:{at + len(secret)}"
