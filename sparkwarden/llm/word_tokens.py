"""Token ids of a word-level tokenizer of the ``tokenizers`` library, with one lookup per word instead of one run per text.

The vocabulary files meant here normalise (NFC, white space, lower case), split texts into runs of letters, single digits, runs of
other signs and English endings, and then merge inside each such word. So the ids of what stands between white space never depend
on what stands around it, and those met before come from a bounded cache; the new ones of a block are encoded in one batch.

Texts of signs that are classed and lower-cased alike by every Unicode version in use (those that Unicode 3.2 had, except the
capital sigma, whose lower case depends on its place, and four separators) are normalised here as a whole, and their new pieces are
split into words here; of other texts the pieces with other signs go to the library as they are. Strings of special tokens in a
text are ordinary text.

Defined results: null texts count as empty and have no ids. Very long texts are encoded in parts that end before white space.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache

import numpy as np

_PART = 1 << 18
_BLOCK = 1 << 20
_CACHED = 800_000
_LONGEST_CACHED = 48
_BREAK = re.compile(r"[ \t\n\r\f\v]")
_GAPS = re.compile(r"[ \t\n\r\f\v]+")
_STOPS = re.compile(r"[.,](?<=[a-z].)(?=\s)")  # led by a set of signs, which is searched for much faster than what stands before them


def _char_class(kept) -> str:
    """A regular expression class of the basic plane's code points that ``kept`` accepts."""
    points = [i for i in range(0x10000) if not 0xD800 <= i < 0xE000 and kept(chr(i))]
    edges = [i for i, p in enumerate(points) if i == 0 or points[i - 1] != p - 1] + [len(points)]
    return "".join(f"\\u{points[a]:04x}-\\u{points[b - 1]:04x}" for a, b in zip(edges, edges[1:]))


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Texts of settled signs only; the words of a normalised text of such signs."""
    old, now = unicodedata.ucd_3_2_0.category, unicodedata.category

    def settled(c: str) -> bool:
        return (old(c) == now(c) and old(c) != "Cn" and c != "Σ" and not "\x1c" <= c <= "\x1f") or c in " \t\n\r\f\v"

    letters, digits = _char_class(lambda c: now(c)[0] == "L"), _char_class(lambda c: now(c)[0] == "N")
    words = f"[{letters}]+|[{digits}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{letters}{digits}]+"
    return re.compile(f"[{_char_class(settled)}]*"), re.compile(words)


def parts(text: str) -> list[str]:
    """The text cut before white space, about every ``_PART`` signs where there is any."""
    out, start = [], 0
    while len(text) - start > _PART:
        gap = _BREAK.search(text, start + _PART)
        if gap is None:
            break
        out.append(text[start : gap.start()])
        start = gap.start()
    return [*out, text[start:]]


class WordTokenizer:
    """``encode`` gives arrays of ids, equal to the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        self._settled, self._words = _patterns()
        vocabulary = self._library.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.dtype = np.dtype("<u2" if self._library.get_vocab_size() <= 1 << 16 else "<u4")
        self._known: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        """Like ``_encoded`` for single words: one run over many of them, told apart by the ids that end a word."""
        out = []
        for start in range(0, len(words), 1000):
            some = words[start : start + 1000]
            ids = np.array(self._library.encode(" ".join(some), add_special_tokens=False).ids, self.dtype)
            ends = np.flatnonzero(self._ends_word[ids]) + 1
            if len(ends) != len(some):
                out += self._encoded(some)
                continue
            raw, size, at = ids.tobytes(), self.dtype.itemsize, 0
            for end in (ends * size).tolist():
                out.append(raw[at:end])
                at = end
        return out

    def _pieces(self, part: str) -> list[str]:
        """What stands between white space, normalised where that is settled; a full stop or comma after a word stands alone."""
        if self._settled.fullmatch(part):
            return _STOPS.sub(r" \g<0>", unicodedata.normalize("NFC", part).lower()).split()
        pieces = (p for p in _GAPS.split(part) if p)
        return [unicodedata.normalize("NFC", p).lower() if self._settled.fullmatch(p) else p for p in pieces]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces not known; short ones are kept."""
        single = [p for p in pieces if p.isalpha() and self._settled.fullmatch(p)]
        fresh = dict(zip(single, self._encoded_words(single)))
        words, whole = {}, []
        for piece in pieces:
            if piece in fresh:
                continue
            if self._settled.fullmatch(piece):
                words[piece] = self._words.findall(piece)
            else:
                whole.append(piece)
        known = self._known
        new = [w for w in {w for ws in words.values() for w in ws} if w not in known and w not in fresh]
        fresh.update(zip(new, self._encoded_words(new)))
        fresh.update({p: b"".join([known[w] if w in known else fresh[w] for w in ws]) for p, ws in words.items()})
        fresh.update(zip(whole, self._encoded(whole)))
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= _LONGEST_CACHED)
        return fresh

    def _joined(self, lists: list[list[str]]) -> list[bytes]:
        known = self._known
        new = [p for p in set().union(*lists) if p not in known]
        fresh = self._learn(new)
        if not any(len(p) > _LONGEST_CACHED for p in new):
            return [b"".join(map(known.__getitem__, pieces)) for pieces in lists]
        return [b"".join([known[p] if p in known else fresh[p] for p in pieces]) for pieces in lists]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self._known) > _CACHED:
            self._known.clear()
        out, lists = [[] for _ in texts], []
        owners: list[int] = []
        waiting = 0

        def flush() -> None:
            for owner, ids in zip(owners, self._joined(lists)):
                out[owner].append(ids)
            lists.clear(), owners.clear()

        for i, text in enumerate(texts):
            for part in parts(text or ""):
                lists.append(self._pieces(part))
                owners.append(i)
                waiting += len(part)
                if waiting > _BLOCK:
                    flush()
                    waiting = 0
        flush()
        return [np.frombuffer(b"".join(ids), self.dtype) for ids in out]


@cache
def tokenizer(path: str) -> WordTokenizer:
    """One per worker and file."""
    return WordTokenizer(path)
