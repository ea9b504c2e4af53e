"""Token ids of whole texts by the tokenizers library, with a bounded memory of distinct words.

The vocabulary drops white space, so the ids of a text are the ids of its words one after another. Each distinct word is
encoded once per worker; a text is then a join of byte strings (unsigned 32-bit little-endian ids)."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

_PLAIN = re.compile(rb"[a-z\x80-\xff]+")
_TAILED = re.compile(rb"([a-z\x80-\xff]+)([!-/:-;=-@\[-`{-~]+)")
_held: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of words by a tokenizer whose pre-tokens never hold white space; at most ``most`` words are remembered."""

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.known = most, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_word_end = bool(self.ends.any())

    @classmethod
    def of(cls, path: str) -> "WordIds":
        if path not in _held:
            _held[path] = cls(path)
        return _held[path]

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text."""
        known = self.known
        # special strings are case-sensitive, so texts that may hold one keep their case
        split = [(t if b"<" in t else t.lower()).split() for t in texts]
        missing = set().union(*(set(w).difference(known) for w in split)) if split else set()
        if missing:
            found = self._words(missing)
            if len(known) + len(found) <= self.most:
                known.update(found)
            else:
                known = {w: known[w] for words in split for w in words if w in known} | found
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words not seen before: letters followed by punctuation are two pre-tokens, so each part is encoded once."""
        parts, whole, odd = {}, set(), []
        for w in words:
            if _PLAIN.fullmatch(w):
                (whole.add if _letters(w) else odd.append)(w)
            elif (m := _TAILED.fullmatch(w)) and b"'" not in w and _letters(m[1]):
                parts[w] = m.groups()
                whole.update(m.groups())
            else:
                odd.append(w)
        ids = self._single(sorted(whole.difference(self.known)))
        get = lambda w: ids[w] if w in ids else self.known[w]
        out = {w: self.encode(w.decode()) for w in odd} | {w: get(a) + get(b) for w, (a, b) in parts.items()}
        return out | ids

    def _single(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of one pre-token each: encoded together, cut after each id that ends a word."""
        out: dict[bytes, bytes] = {}
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            if self.by_word_end:
                ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(some):
                    flat, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                    out |= {w: flat[a:b] for w, a, b in zip(some, at, at[1:])}
                    continue
            out |= {w: self.encode(w.decode()) for w in some}
        return out


def _letters(word: bytes) -> bool:
    """Whether a word stays a run of letters under NFC and lower-casing; true only for Latin letters, where all agree."""
    if word.isascii():
        return word.isalpha()
    text = word.decode()
    return max(text) < "ɐ" and unicodedata.normalize("NFC", text).lower().isalpha()
