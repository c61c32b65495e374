"""Token ids of whole texts under a word-level BPE file, one library call per distinct word.

The file's normaliser folds white space and case, and its splitter cuts a text
into words before any merge, so the ids of a text are those of its words in a
row. Texts that hold a special string or a character beyond the plain range go
through the library whole, since there the normaliser may do more.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Characters that NFC leaves alone and whose lower case is one character of the same ranges.
_RANGES = [*range(0x00, 0x1C), *range(0x20, 0x250), *range(0x2010, 0x2028)]
PLAIN = [c for c in _RANGES if len(chr(c).lower()) == 1 and ord(chr(c).lower()) in _RANGES]


def _members(test) -> str:
    return "".join(re.escape(chr(c)) for c in PLAIN if test(unicodedata.category(chr(c))))


_LETTER, _NUMBER = _members(lambda c: c[0] == "L"), _members(lambda c: c[0] == "N")
_BEYOND = re.compile("[^" + "".join(re.escape(chr(c)) for c in PLAIN) + "]")
_CONTROL = re.compile("[\x1c-\x1f]")
_SPECIAL = "<|"
# Fixed value: the splitter of the tokenizer file, for the plain range.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


def words_of(text: str) -> list[str] | None:
    """The words that the merges run within, or None when the library has to see the whole text."""
    if _SPECIAL in text or (_CONTROL if text.isascii() else _BEYOND).search(text):
        return None
    return _WORDS.findall(text.lower())


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, with a bounded cache of words."""

    def __init__(self, path: str, most_words: int = 700_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most_words = most_words
        pieces = self.library.get_vocab()
        self.closing = np.zeros(max(pieces.values()) + 1, bool)
        self.closing[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}

    def _encoded(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of the words one after another, and where each word's ids end; every word has one closing piece."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(words):  # a word that the library leaves out or splits
            each = [coded.ids for coded in self.library.encode_batch(words, add_special_tokens=False)]
            ids, ends = np.array([i for e in each for i in e], "<u4"), np.cumsum([len(e) for e in each])
        return ids.tobytes(), ends

    def _learn(self, words: list[str]) -> None:
        if len(self.cache) + len(words) > self.most_words:
            self.cache = {}
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            coded, ends = self._encoded(part)
            at = 0
            for word, end in zip(part, (4 * ends).tolist()):
                self.cache[word] = coded[at:end]
                at = end

    def _ids(self, text: str, words: list[str] | None) -> bytes:
        if words is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            distinct = set(words)
            self._learn([w for w in distinct if w not in self.cache])
            if any(w not in self.cache for w in distinct):  # the cache was full and began anew
                self._learn([w for w in distinct if w not in self.cache])
            return b"".join(map(self.cache.__getitem__, words))

    def ids_of_all(self, many: list[str]) -> list[bytes]:
        """Ids of many texts; the words they miss are learned in one go."""
        split = [words_of(text) for text in many]
        missing = {w for words in split if words for w in words if w not in self.cache}
        if len(missing) <= self.most_words // 2:
            self._learn(list(missing))
        return [self._ids(text, words) for text, words in zip(many, split)]

    def count(self, words: list[str]) -> np.ndarray:
        """Number of ids of each word, uncached."""
        sizes = [np.diff(self._encoded(words[k : k + 20_000])[1], prepend=0) for k in range(0, len(words), 20_000)]
        return np.concatenate(sizes) if sizes else np.zeros(0, np.int64)

    def count_text(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=4)
def tokenizer(path: str, most_words: int = 700_000) -> WordTokenizer:
    """One per Python worker, file and size of the cache."""
    return WordTokenizer(path, most_words)
