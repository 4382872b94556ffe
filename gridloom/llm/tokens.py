"""Token ids of whole texts by a public tokenizer, with a bounded cache of words.

White space always ends a pre-token of the word-level BPE, so the ids of a text are those of its
space-separated words, one after the other. Words that a batch needs and the cache lacks are encoded
together in one call; their ids part where a token ends a word.
"""

from __future__ import annotations

import os

import numpy as np

from .common import worker_cache

CACHED_WORDS = 700_000
END_OF_WORD = "</w>"
#: Marks after a word are tokens of their own; no apostrophe, which may join what follows.
MARKS = ".,:;!?#$%&*|)"


class WordEncoder:
    """text -> little-endian unsigned 32-bit ids, as bytes. Equal to encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.cache = Tokenizer.from_file(path), cached_words, {"": b""}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(END_OF_WORD)]] = True
        self.by_words = self._splits_at_spaces()

    def _splits_at_spaces(self) -> bool:
        """Byte-level tokenizers join a word with the space before it; those texts are encoded whole."""
        one, two = self._whole("w"), self._whole("w w")
        return bool(self.ends.any()) and two == one + one

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        """Adds the words to the cache. Plain words of Latin letters share an entry for any case and closing mark."""
        cache, base = self.cache, {}
        for w in new:
            stem = w.rstrip(MARKS)
            if stem.isalpha() and (stem.isascii() or (max(stem) <= "ſ" and "İ" not in stem)):
                base[w] = stem.lower()
            else:
                cache[w] = self._whole(w)
        plain = list(set(base.values()).difference(cache))
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
                cache.update((w, raw[a:b]) for w, a, b in zip(part, cuts, cuts[1:]))
            else:
                cache.update((w, self._whole(w)) for w in part)
        for w, b in base.items():
            mark = w[len(b) :]
            if mark and mark not in cache:
                cache[mark] = self._whole(mark)
            cache[w] = cache[b] + cache[mark]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return [self._whole(x or "") for x in texts]
        out, size = [], 2_000_000  # characters at a time, so that a batch of long texts has no third copy in memory
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars < size):
                chars += len(texts[to] or "")
                to += 1
            words = [(x or "").replace("\n", " ").split(" ") for x in texts[at:to]]
            new = set().union(*words).difference(self.cache)
            if new:
                if len(self.cache) + len(new) > self.room:
                    self.cache = {"": b""}
                    new = set().union(*words) - {""}
                self._learn(new)
            out += [b"".join(map(self.cache.__getitem__, w)) for w in words]
            at = to
        return out


def encoder(path: str) -> WordEncoder:
    """One a worker process."""
    return worker_cache(("encoder", path), lambda: WordEncoder(path))
