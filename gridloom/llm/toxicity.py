"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The unit is the sentence, read through windows of one and two words. The kernel of two windows sums, over
the letter subsequences that they share, the products of their weights: DECAY to the number of letters
skipped, up to two of them in three letters and one in four. A word's edge is a letter like any other and
can be skipped, so an insult that is gapped, stuffed or parted (idxiot, i.d.i.o.t, i d i o t, idi ot) still
meets the plain one, and so do two words that are harmless one by one. A window's features are divided by
the root of the sum of its squared weights. Landmarks are windows of the labelled sentences; the machine
is linear in K(Z,Z)^(-1/2) k(w,Z), and as k is a sum over subsequences, what it learnt folds into one
weight for each subsequence: a window's score is a sum of table entries, equal to the machine's.

Labels mark documents. A harmless document's sentences are harmless. Of a toxic document's sentences the
highest-scoring is toxic, the others are left out, and it is chosen anew after each training (multiple-
instance learning); a sentence's score is its highest window's. A document's score is a logistic
function, fitted to the learnt rows, of its highest sentence's.

The sample of labelled rows that is learnt from is bounded (MOST rows, LEARN_CHARS each, and NEGATIVES
windows to train on), so one task learns; the driver gets the folded table only. Scores read whole texts, some PIECE characters at a time.

Defined results: null and empty texts have no words and get the lowest score, that of a document without
sentences; repeated rows each get a row, repeated labels count once; without learnable documents of both
classes that have words every score is 0; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, worker_cache
from .labelled import held_out, learnable, sample

#: Labelled documents that are learnt from, at most, by class; only those of so many characters are.
MOST = {1: 2000, 0: 4000}
LEARN_CHARS = 8_000
#: Windows of harmless sentences that a round trains on besides the highest of each document, at most.
NEGATIVES = 6000
LANDMARKS = 160
ROUNDS = 4
THRESHOLD = 0.5
DECAY = 0.5
LONG, OVERLAP = 48, 16  # letters of a window in a very long word, and of those that two windows share
PIECE, AGAIN = 500_000, 64  # characters of a text at a time, and those of its end that the next piece reads again
FLOOR = -2.0

#: Offsets of the letters behind the first.
SHAPES = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)]
WEIGHTS = [DECAY ** (s[-1] - len(s)) for s in SHAPES]
PLAIN = [k for k, w in enumerate(WEIGHTS) if w == 1]
#: Bits of a subsequence's place where documents are counted, and in the folded table, of which little is filled.
COUNTED, FOLDED = 22, 20

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_MIX = np.uint32(0x2C1B3C6D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
EDGE = 32  # a word's edge, in place of white space
CODES = 0x32000  # code points that are told apart as letters; those beyond are none

_kinds: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """Of each code point: 1 letter, 2 white space, 3 an end of a sentence before white space, 4 a line's end, 0 other."""
    if not _kinds:
        k = np.zeros(CODES + 1, np.uint8)
        k[[c for c in range(CODES) if chr(c).isalpha()]] = 1
        k[[c for c in range(CODES) if chr(c).isspace()]] = 2
        k[[ord(c) for c in ".!?。！？"]] = 3
        k[[10, 13, 0x2028, 0x2029]] = 4
        _kinds.append(k)
    return _kinds[0]


def prepared(text: str | None) -> str:
    return (text or "").lower()


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of a bounded length; each reads the end of the one before again, from a white space on."""
    at = 0
    while len(text) - at > size:
        yield text[at : at + size]
        found = text.find(" ", at + size - AGAIN, at + size)
        at = found if found > at else at + size - AGAIN
    yield text[at:]


@dataclass
class Stream:
    """Letters and edges of many texts, and their windows: first letter, length, sentence."""

    code: np.ndarray
    start: np.ndarray
    size: np.ndarray
    sentence: np.ndarray
    text_of: np.ndarray  # of each sentence that has a window

    def window(self, k: int) -> str:
        return "".join(" " if c == EDGE else chr(c) for c in self.code[self.start[k] : self.start[k] + self.size[k]])


def _ones_joined(at: np.ndarray, edge: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Without the edges between letters that are set apart one by one, three or more of them."""
    edges = np.flatnonzero(edge)
    one = np.diff(edges) == 2
    of = sentence[at[edges[:-1] + 1]] if len(edges) > 1 else np.empty(0, np.int64)
    link = one[1:] & one[:-1] & (of[1:] == of[:-1])
    wide = np.r_[False, link, False]
    link &= wide[:-2] | wide[2:]
    return np.delete(at, edges[1:-1][link])


def stream(texts: list[str]) -> Stream:
    """Windows of one word, with its edges, and of two neighbours in a sentence; of a very long word, overlapping parts."""
    joined = "\n" + "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kind()[np.minimum(raw, CODES)]
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])  # the line's end before each text
    blank = (kind == 2) | (kind == 4)
    close = (kind == 4) | ((kind == 3) & np.r_[blank[1:], True])
    sentence = np.cumsum(close, dtype=np.int32)  # as of each character
    at = np.flatnonzero((kind == 1) | blank)
    edge = blank[at]
    at = at[np.r_[True, ~(edge[1:] & edge[:-1])]]  # one edge between words
    at = _ones_joined(at, blank[at], sentence)
    edge = blank[at]
    code = np.where(edge, np.uint32(EDGE), raw[at])
    edges = np.flatnonzero(edge)
    first, size = edges[:-1], np.diff(edges) + 1  # a word with both edges; the joined text begins and ends with one
    if not len(first):
        none = np.empty(0, np.int64)
        return Stream(code, none, none, none, none)
    of = sentence[at[first + 1]]
    text = np.searchsorted(ends, at[first + 1], "right") - 1
    short = size <= LONG + 2
    two = np.flatnonzero(short[1:] & short[:-1] & (of[1:] == of[:-1]))  # texts begin a sentence each
    long = np.flatnonzero(~short)
    parts = -(-(size[long] - OVERLAP) // (LONG - OVERLAP))
    shift = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * (LONG - OVERLAP)
    word = np.concatenate([np.flatnonzero(short), two, np.repeat(long, parts)])
    begin = np.concatenate([first[short], first[two], np.repeat(first[long], parts) + shift])
    length = np.concatenate([size[short], size[two] + size[two + 1] - 1, np.minimum(LONG, np.repeat(size[long], parts) - shift)])
    order = np.argsort(word, kind="stable")
    word, begin, length = word[order], begin[order], length[order]
    new = np.r_[True, of[word][1:] != of[word][:-1]]
    return Stream(code, begin.astype(np.int32), length.astype(np.int32), np.cumsum(new, dtype=np.int32) - 1, text[word][new])


def _keys(code: np.ndarray) -> list[np.ndarray]:
    return [code * m for m in _ODD]


def places(keys: list[np.ndarray], shape: tuple[int, ...], bits: int) -> np.ndarray:
    """The place of the subsequence of that shape at each letter that has one."""
    n = len(keys[0]) - shape[-1]
    if n <= 0:
        return np.empty(0, np.uint32)
    key = keys[0][:n] + keys[1][shape[0] : shape[0] + n]
    key += keys[2][shape[1] : shape[1] + n]
    if len(shape) == 3:
        key += keys[3][shape[2] : shape[2] + n]
    key ^= key >> np.uint32(15)
    key *= _MIX
    key >>= np.uint32(32 - bits)
    return key


def hashes(s: Stream) -> np.ndarray:
    """A 64-bit name of each window's letters."""
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(s.code), _STEP)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(s.code), _BACK)])
    upto = np.r_[np.uint64(0), np.cumsum((s.code.astype(np.uint64) * _BACK + np.uint64(1)) * power[:-1])]
    return (upto[s.start + s.size] - upto[s.start]) * back[s.start]


def norms(size: np.ndarray, shapes: list[int] | None = None, squared: bool = True) -> np.ndarray:
    """By a window's length, the root of the sum of its squared weights (or the number of its subsequences)."""
    out = np.zeros(len(size))
    for k in range(len(SHAPES)) if shapes is None else shapes:
        out += np.maximum(size - SHAPES[k][-1], 0) * (WEIGHTS[k] ** 2 if squared else 1)
    return np.sqrt(np.maximum(out, 1e-9)) if squared else np.maximum(out, 1)


def table_sums(s: Stream, table: np.ndarray, shapes: list[int] | None = None) -> np.ndarray:
    """Each window's weighted sum of table entries over its subsequences."""
    out, keys, bits = np.zeros(len(s.start)), _keys(s.code), len(table).bit_length() - 1
    shapes = list(range(len(SHAPES))) if shapes is None else shapes
    for last in sorted({SHAPES[k][-1] for k in shapes}):
        got = None
        for k in shapes:
            if SHAPES[k][-1] == last:
                x = table[places(keys, SHAPES[k], bits)]
                if WEIGHTS[k] != 1:
                    x *= np.float32(WEIGHTS[k])
                got = x if got is None else np.add(got, x, out=got)
        upto = np.zeros(len(s.code) + 1)
        np.cumsum(got, out=upto[1 : len(got) + 1], dtype=float)
        upto[len(got) + 1 :] = upto[len(got)]
        out += upto[np.maximum(s.start + s.size - last, s.start)] - upto[s.start]
    return out


def of_windows(windows: list[str]) -> Stream:
    """A stream of windows as they are (edges as spaces), each its own."""
    code = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in windows)])
    size = np.array([len(w) for w in windows], np.int64)
    return Stream(code, np.cumsum(size) - size, size, np.arange(len(size)), np.arange(len(size)))


def subsequences(s: Stream, shapes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place, weight) of all subsequences of windows that follow each other without a gap."""
    keys = _keys(s.code)
    of, rows, cols, weights = np.repeat(np.arange(len(s.size)), s.size), [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for k in range(len(SHAPES)) if shapes is None else shapes:
        at, last = places(keys, SHAPES[k], FOLDED).astype(np.int64), SHAPES[k][-1]
        ok = of[: len(at)] == of[last : last + len(at)]
        rows.append(of[: len(at)][ok])
        cols.append(at[ok])
        weights.append(np.full(int(ok.sum()), WEIGHTS[k]))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(weights)


@dataclass
class Machine:
    """What scoring needs: the folded table (of some thousand subsequences), the bias, and the logistic function."""

    cols: np.ndarray
    values: np.ndarray
    bias: float
    logistic: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(1 << FOLDED, np.float32)
        out[self.cols] = self.values
        return out


class Kernel:
    """Nystroem features of windows for given landmarks."""

    def __init__(self, landmarks: list[str]):
        s = of_windows(landmarks)
        row, col, weight = subsequences(s)
        self.cols, at = np.unique(col, return_inverse=True)
        self.by = np.zeros((len(self.cols), len(landmarks)))
        np.add.at(self.by, (at, row), weight / norms(s.size)[row])
        value, vector = np.linalg.eigh(self.by.T @ self.by)
        keep = value > 1e-6 * value[-1]
        self.root = vector[:, keep] / np.sqrt(value[keep])

    def near(self, windows: list[str]) -> np.ndarray:
        """The kernel of each window with each landmark."""
        out = np.zeros((len(windows), self.by.shape[1]))
        for k in range(0, len(windows), 500):
            s = of_windows(windows[k : k + 500])
            row, col, weight = subsequences(s)
            at = np.minimum(np.searchsorted(self.cols, col), len(self.cols) - 1)
            hit = self.cols[at] == col
            row, at, weight = row[hit], at[hit], (weight / norms(s.size)[row])[hit]
            order = np.argsort(row, kind="stable")
            row, at, weight = row[order], at[order], weight[order]
            if len(row):
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                out[k + row[first]] = np.add.reduceat(self.by[at] * weight[:, None], first, axis=0)
        return out

    def features(self, windows: list[str]) -> np.ndarray:
        return self.near(windows) @ self.root

    def fold(self, beta: np.ndarray) -> np.ndarray:
        """The table entries of self.cols for a machine linear in the features."""
        return self.by @ (self.root @ beta)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """L2-loss linear support vector machine by Newton's method on the primal; y is -1 or 1."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    beta, damp = np.zeros(x1.shape[1]), ridge * weight.sum() * np.eye(x1.shape[1])
    damp[-1, -1] *= 1e-3
    active = np.ones(len(x1), bool)
    for _ in range(rounds):
        xs, ws = x1[active], weight[active]
        beta = np.linalg.solve(damp + xs.T @ (xs * ws[:, None]), xs.T @ (ws * y[active]))
        now = y * (x1 @ beta) < 1
        if (now == active).all():
            break
        active = now
    return beta[:-1], float(beta[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (with the constant last) of a logistic regression."""
    x1, beta = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        step = np.linalg.solve(ridge * np.eye(len(beta)) + x1.T @ (x1 * (p * (1 - p))[:, None]), x1.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _highest(s: Stream, scores: np.ndarray) -> np.ndarray:
    """The window with the highest score of each sentence; the first of several."""
    if not len(scores):
        return np.empty(0, np.int64)
    begins = np.flatnonzero(np.r_[True, np.diff(s.sentence) > 0])
    top = np.flatnonzero(scores == np.maximum.reduceat(scores, begins)[s.sentence])
    return top[np.r_[True, np.diff(s.sentence[top]) > 0]]


def _parts(texts: list[str], size: int = 250_000) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars < size):
            chars += len(texts[to])
            to += 1
        yield at, to
        at = to


def log_odds(streams: list[Stream], y: np.ndarray) -> np.ndarray:
    """By place: how much likelier a toxic document has the subsequence (without gaps) than a harmless one."""
    counts, size = np.zeros((2, 1 << COUNTED)), 1 << COUNTED
    for s in streams:
        if not len(s.start):
            continue
        text = np.zeros(len(s.code), np.int64)
        text[s.start] = s.text_of[s.sentence]
        text = np.maximum.accumulate(text)
        keys = _keys(s.code)
        for k in PLAIN:
            at, last = places(keys, SHAPES[k], COUNTED), SHAPES[k][-1]
            same = text[: len(at)] == text[last : last + len(at)]
            key = np.sort((text[: len(at)][same] << COUNTED) + at[same])
            key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
            for c in (0, 1):
                counts[c] += np.bincount(key[y[key >> COUNTED] == c] & (size - 1), minlength=size)
    n = [int((y == c).sum()) for c in (0, 1)]
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    return (odds * (counts[1] / (counts[1] + 5))).astype(np.float32)  # rare ones prove little


class Windows:
    """How many texts of each class have a window, by its name."""

    def __init__(self, streams: list[Stream], y: np.ndarray):
        self.names, self.counts = [], []
        for c in (0, 1):
            each = []
            for s in streams:
                own = s.text_of[s.sentence]
                pick = y[own] == c
                name = hashes(s)[pick]
                each.append(name[np.unique(name + own[pick].astype(np.uint64) * _STEP, return_index=True)[1]])  # a text's once
            name, count = np.unique(np.concatenate(each), return_counts=True)
            self.names.append(name)
            self.counts.append(count / max(1, int((y == c).sum())))

    def share(self, c: int, windows: list[str]) -> np.ndarray:
        h = hashes(of_windows(windows))
        at = np.minimum(np.searchsorted(self.names[c], h), len(self.names[c]) - 1)
        return np.where(self.names[c][at] == h, self.counts[c][at], 0.0)


def fit(texts: list[str], y: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Machine | None:
    """A machine from prepared texts, in a fixed order, and their labels; None if a class has no text with words."""
    streams = []
    for a, b in _parts(texts):
        s = stream(texts[a:b])
        s.text_of = s.text_of + a
        streams.append(s)
    text_of = np.concatenate([s.text_of for s in streams] or [np.empty(0, np.int64)])
    if len(set(y[text_of].tolist())) < 2:
        return None
    odds, found = log_odds(streams, y), Windows(streams, y)
    score_of = lambda s: table_sums(s, odds, PLAIN) / norms(s.size, PLAIN, squared=False)
    rng, plain = np.random.default_rng(0), []
    for s in streams:  # windows of harmless texts, whichever
        pick = np.flatnonzero(y[s.text_of[s.sentence]] == 0)
        plain += [s.window(k) for k in rng.permutation(pick)[: -(-NEGATIVES // len(streams))]]
    held: dict[str, None] = dict.fromkeys(plain)
    machine = Machine(np.empty(0, np.int64), np.empty(0), 0.0, np.zeros(2))
    for turn in range(rounds + 1):
        scores, tops = [], []
        for s in streams:
            got = score_of(s)
            tops.append(_highest(s, got))
            scores.append(got[tops[-1]])
        scores, top, stream_of = np.concatenate(scores), np.concatenate(tops), np.repeat(np.arange(len(tops)), [len(t) for t in tops])
        by_text = np.lexsort((-scores, text_of))
        best = by_text[np.r_[True, np.diff(text_of[by_text]) > 0]]  # each document's highest sentence
        if turn == rounds:
            machine.logistic = logistic(np.maximum(scores[best], FLOOR)[:, None], y[text_of[best]].astype(float))
            return machine
        toxic, harmless = best[y[text_of[best]] == 1], best[y[text_of[best]] == 0]
        windows = {k: streams[stream_of[k]].window(top[k]) for k in best.tolist()}
        held |= dict.fromkeys(windows[k] for k in harmless)
        # What harmless texts have as well proves nothing.
        names = [windows[k] for k in toxic]
        clean = found.share(1, names) >= 10 * found.share(0, names)
        toxic = toxic[clean] if clean.any() else toxic
        witness = [windows[k] for k in toxic]
        often: dict[str, float] = {}
        for k in toxic:
            often[windows[k]] = often.get(windows[k], 0.0) + max(scores[k], 0)
        first = sorted(often, key=lambda w: (-often[w], w))
        chosen = [*first[: landmarks // 2], *(windows[k] for k in harmless[np.argsort(-scores[harmless], kind="stable")][: landmarks // 4]), *plain[: landmarks // 4]]
        kernel = Kernel(list(dict.fromkeys(chosen))[:landmarks])
        good = sorted({*held} - {*first})
        weight = np.r_[np.full(len(witness), 1 / len(witness)), np.full(len(good), 1 / max(1, len(good)))]
        beta, bias = svm(kernel.features([*witness, *good]), np.r_[np.ones(len(witness)), -np.ones(len(good))], weight * len(weight))
        machine = Machine(kernel.cols, kernel.fold(beta), bias, np.zeros(2))
        table = machine.table()
        score_of = lambda s, table=table, bias=bias: table_sums(s, table) / norms(s.size) + bias
    return machine


def score_texts(texts: list[str | None], machine: Machine, table: np.ndarray) -> np.ndarray:
    """The probability of each text."""
    top = np.full(len(texts), FLOOR)
    parts, of = [], []
    for k, t in enumerate(texts):
        for p in pieces(prepared(t)):
            if p:
                parts.append(p)
                of.append(k)
    of = np.array(of, np.int64)
    for a, b in _parts(parts, PIECE):
        s = stream(parts[a:b])
        if len(s.start):
            got = table_sums(s, table) / norms(s.size) + machine.bias
            begins = np.flatnonzero(np.r_[True, np.diff(s.text_of[s.sentence]) > 0])
            np.maximum.at(top, of[a + s.text_of[s.sentence[begins]]], np.maximum.reduceat(got, begins))
    slope, constant = machine.logistic
    return 1 / (1 + np.exp(-np.clip(slope * top + constant, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: dict[int, int] = MOST) -> Machine | None:
    """A machine fitted in one task to a bounded sample of labelled documents; None without both classes."""
    marked = docs.select("doc_id", "text").where(F.length("text") <= LEARN_CHARS).join(learnable(labels, "toxic"), "doc_id")
    chosen = sample(marked.select("doc_id", "y").distinct(), most)
    rows = docs.select("doc_id", "text").where(F.length("text") <= LEARN_CHARS).join(F.broadcast(chosen), "doc_id")  # at most sum(most) rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).withColumn("one", F.lit(0))
    schema = pa.schema([("cols", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("bias", pa.float64()), ("logistic", pa.list_(pa.float64()))])

    def run(marked: pa.Table) -> pa.Table:
        marked = marked.sort_by("doc_id")
        m = fit([prepared(t.as_py()) for t in marked.column("text")], marked.column("y").to_numpy().astype(np.int64))
        give_back()
        return pa.Table.from_pylist([{"cols": m.cols, "values": m.values, "bias": m.bias, "logistic": m.logistic}] if m else [], schema=schema)

    got = rows.groupBy("one").applyInArrow(run, "cols array<long>, values array<double>, bias double, logistic array<double>").collect()
    return Machine(np.array(got[0]["cols"], np.int64), np.array(got[0]["values"]), got[0]["bias"], np.array(got[0]["logistic"])) if got else None


def score(docs: DataFrame, machine: Machine | None, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns, and each text's score under a name that is none of theirs."""
    sent, mark = docs.sparkSession.sparkContext.broadcast(machine), uuid.uuid4().hex
    kept = docs.select(*columns, "text") if "text" not in columns else docs.select(*columns)
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_cache(("toxicity", mark), sent.value.table) if sent.value else None
        for b in batches:
            got = score_texts(b.column(at).to_pylist(), sent.value, table) if table is not None else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(got)], names=[*columns, name])
        give_back()

    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns)
    return kept.mapInArrow(run, f"{kinds}, {name} double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, for every document."""
    out = score(docs, train(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under the threshold, all columns as they were."""
    return score(docs, train(docs, labels), docs.columns, "__toxicity").where(F.col("__toxicity") < THRESHOLD).select(*docs.columns)
