"""Plain versions of the operators, for comparison on small inputs."""

import re

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out)]

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text, shingle):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(keys, linked):
    """Least reachable index of each key, where linked(a, b)."""
    root = list(range(len(keys)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            if linked(keys[a], keys[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(keys))]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(texts, items, size):
    """[(n_words, n_hit, items)] of each text."""
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, w[s : s + size]) for s in range(max(0, len(w) - size) + 1)] if w else []
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    ids.add(item)
        out.append((len(w), len(hit), ids))
    return out


def repeated(texts, threshold):
    """Which bytes of each text a repeated string of the threshold's length covers."""
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + threshold] for b in raw for i in range(len(b) - threshold + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for i in range(len(b) - threshold + 1):
            if seen[b[i : i + threshold]] > 1:
                mask[i : i + threshold] = b"\1" * threshold
        out.append(mask)
    return out


def jaccard(a, b, shingle):
    sets = []
    for t in (a, b):
        w = (t or "").translate(LOWER).split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])
