"""Splitting a text into the pre-tokens of a byte-level tokenizer, as its own library splits it.

A text falls apart before every single space or line feed between two characters that are no white space: no pre-token spans
such a place, and what comes before it has no say in what follows. These chunks repeat far more than texts do, so each is
split into pre-tokens once per worker while it is remembered."""

from __future__ import annotations

import re

import regex

from tidemark.llm.wordcache import Remembered

#: fixed value: the byte-level pattern that parts words, numbers, signs and white space
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

_UNEVEN = re.compile(r"\s\s|[^\S \n]")
_EVEN_CHUNK = re.compile(r"[ \n]?\S+|[ \n]")
_PLACE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: where this pattern and the library surely agree on letters, numbers and white space
_COMMON = re.compile(r"[\n -~¡-ɏ]+")


class Splitter:
    def __init__(self, tokenizer, limit: int = 400_000):
        """``tokenizer``: a Tokenizer of the tokenizers library with a byte-level pre-tokenizer."""
        self.own = tokenizer.pre_tokenizer
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self._any = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Remembered(lambda chunks: [self.pretokens(c) for c in chunks], limit)

    def pretokens(self, chunk: str) -> tuple[str, ...]:
        if chunk in self.special:
            return (chunk,)
        if _COMMON.fullmatch(chunk):
            return tuple(PATTERN.findall(chunk))
        return tuple(chunk[a:b] for _, (a, b) in self.own.pre_tokenize_str(chunk))

    def chunks(self, text: str) -> list[str]:
        if self._any and any(s in text for s in self.special):
            return [c for part in self._any.split(text) if part for c in ([part] if part in self.special else self._chunks(part))]
        return self._chunks(text)

    def _chunks(self, text: str) -> list[str]:
        if _UNEVEN.search(text):
            return [c for c in _PLACE.split(text) if c]
        return _EVEN_CHUNK.findall(text)
