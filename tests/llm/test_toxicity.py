"""The string kernel against a plain version, and what sentences, letters and corners do."""

import random
from collections import Counter

import numpy as np
import pytest
from test_llm import labels, prose, table


def counted(window):
    """Subsequences of three letters with up to two skipped, and of four with up to one, by weight."""
    from itertools import combinations

    out = Counter()
    for letters, skipped in ((3, 2), (4, 1)):
        for span in range(letters, letters + skipped + 1):
            for at in range(len(window) - span + 1):
                for inner in combinations(range(1, span - 1), letters - 2):
                    out["".join(window[at + k] for k in (0, *inner, span - 1))] += 0.5 ** (span - letters)
    return out


def occurrences(window):
    total = 0.0
    for letters, skipped in ((3, 2), (4, 1)):
        for gap in range(skipped + 1):
            ways = {(3, 0): 1, (3, 1): 2, (3, 2): 3, (4, 0): 1, (4, 1): 3}[letters, gap]
            total += max(0, len(window) - letters - gap + 1) * ways * 0.25**gap
    return np.sqrt(total)


def kernel(u, v):
    x, y = counted(u), counted(v)
    return sum(w * y[s] for s, w in x.items()) / (occurrences(u) * occurrences(v))


def test_kernel_and_folded_table_equal_the_plain_kernel():
    from gridloom.llm import toxicity as T

    rng = random.Random(3)
    letters = "abcdeéжд語"
    windows = [f" {''.join(rng.choice(letters) for _ in range(rng.randint(1, 12)))} " for _ in range(20)]
    windows += [" idi ot ", " idiot ", " ididid ", " a b "]
    marks = list(dict.fromkeys(w for w in windows[:8] + windows[-4:] if len(w) > 3))
    k = T.Kernel(marks)
    plain = np.array([[kernel(w, m) for m in marks] for w in windows if len(w) > 2])
    assert np.allclose(k.near([w for w in windows if len(w) > 2]), plain, atol=1e-9)
    # The machine of features and the folded table give one score.
    beta = np.random.default_rng(0).normal(size=k.root.shape[1])
    machine = T.Machine(k.cols, k.fold(beta), 0.0, np.zeros(2))
    text = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(40)) + ". Next idi ot"
    s = T.stream([T.prepared(text)])
    each = [s.window(j) for j in range(len(s.start))]
    assert np.allclose(T.table_sums(s, machine.table()) / T.norms(s.size), k.features(each) @ beta, atol=1e-5)


def test_gapped_and_parted_words_stay_near():
    from gridloom.llm import toxicity as T

    assert kernel(" idiot ", " idi ot ") > 0.3 and kernel(" idiot ", " idxiot ") > 0.3 and kernel(" idiot ", " banana ") == 0
    windows = lambda t: {w for s in [T.stream([T.prepared(t)])] for w in (s.window(k) for k in range(len(s.start)))}
    assert " idiot " in windows("You I.D.I.O.T there") & windows("so i d i o t now") & windows("id-iot")
    assert " drop dead " in windows("now drop dead, you") and " drop dead " not in windows("Drop. Dead.")
    # Letters of any script are told apart.
    table = T.of_windows([" абвг ", " дежз "])
    _, cols, _ = T.subsequences(table)
    assert len(set(cols.tolist())) > 20


def test_windows_of_long_texts_and_words():
    from gridloom.llm import toxicity as T

    text = "b" * 5000 + "zorbwit" + "c" * 5000
    s = T.stream([text])
    assert any("zorbwit" in s.window(k) for k in range(len(s.start)))
    long = " ".join(["word"] * 400_000) + " zorbwit end"
    got = list(T.pieces(long))
    assert max(map(len, got)) <= T.PIECE and sum(map(len, got)) < len(long) + 200 * len(got) and "zorbwit" in got[-1]


def test_learns_two_words_that_are_harmless_alone(spark):
    from gridloom.llm.toxicity import toxicity

    rng = random.Random(5)
    rows = []
    for k in range(600):
        w = prose(rng, 40).split()
        for _ in range(2):
            at = rng.randrange(len(w))
            w[at:at] = ["gradlok", "vumpish"] if k % 3 == 0 else rng.choice([["gradlok"], ["vumpish"], []])
        rows.append((" ".join(w), int(k % 3 == 0)))
    got = {r["doc_id"]: r for r in toxicity(table(spark, [t for t, _ in rows]), labels(spark, [(k, 1, y) for k, (_, y) in enumerate(rows)])).collect()}
    out = [k for k, r in got.items() if r["held_out"]]
    assert np.mean([got[k]["predicted"] == rows[k][1] for k in out]) > 0.95


@pytest.mark.parametrize("toxic,harmless", [([None, ""], ["some words", "more words"]), (["some words", "more words"], [None, ""]), ([None, "..."], ["", "12 34"])])
def test_classes_without_words(spark, toxic, harmless):
    from gridloom.llm.toxicity import toxicity, without_toxic

    texts = (toxic + harmless) * 10
    df, marks = table(spark, texts), labels(spark, [(k, 1, int(k % 4 < 2)) for k in range(len(texts))])
    assert {(r["score"], r["predicted"]) for r in toxicity(df, marks).collect()} == {(0.0, 0)}
    assert without_toxic(df, marks).count() == len(texts)


def test_repeated_rows_and_labels(spark):
    from gridloom.llm.toxicity import toxicity

    texts = ["a plain text of words", "you utter zorbwit there"] * 15
    df, marks = table(spark, texts), labels(spark, [(k, 1, k % 2) for k in range(30)])
    once = {r["doc_id"]: r["score"] for r in toxicity(df, marks).collect()}
    twice = [(r["doc_id"], r["score"]) for r in toxicity(df.union(df), marks.union(marks)).collect()]
    assert sorted(twice) == sorted([*once.items()] * 2)
