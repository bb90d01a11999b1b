"""Token ids of whole texts through the distinct pieces ("words") that a tokenizer's pattern cuts them into.

A text repeats few words many times, so each distinct word of a slice of texts is encoded once, and a text's ids are
joined from its words' ids. Words are remembered up to a bound, which concerns speed alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

import public_tokenizers
import regex

#: Words that a Python worker remembers with their ids (about 110 MB; workers live on between queries).
REMEMBERED = 500_000
#: Matches of one text that are held at once.
RUN = 1_000_000


#: The same pieces as ``public_tokenizers.PATTERN`` for texts without ``_ODD`` characters, by the faster ``re``: below
#: U+0250 its classes differ from the Unicode properties only for those named.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = re.compile("[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]")


class WordIds:
    """``encode`` turns a list of distinct words into their ids, each as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], pattern: str = public_tokenizers.PATTERN):
        self.encode, self.pattern, self.known = encode, regex.compile(pattern), {}
        self.plain = _PLAIN if pattern == public_tokenizers.PATTERN else None

    def words(self, text: str) -> list[str]:
        return self.plain.findall(text) if self.plain and not _ODD.search(text) else self.pattern.findall(text)

    def _learn(self, words: set[str]) -> None:
        new = list(words - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {w: self.known[w] for w in words if w in self.known}
        self.known.update(zip(new, self.encode(new), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        small = [self.words(t) if len(t) <= 4 * RUN else None for t in texts]
        self._learn(set().union(*(words for words in small if words)))
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) if words is not None else b"" for words in small]
        for i, words in enumerate(small):
            if words is None:
                out[i] = self._long(texts[i])
        return out

    def _long(self, text: str) -> bytes:
        parts, found = [], self.pattern.finditer(text)
        while words := [m[0] for m in islice(found, RUN)]:
            self._learn(set(words))
            parts.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(parts)
