"""Texts cut into pieces that byte-level tokenizers treat independently of each other.

The pattern of the byte-level tokenizers never joins characters across a single space that has a
non-space on both sides: such a space always begins a new pre-token. So a text falls into pieces
at these spaces, and whatever holds for a piece (its pre-tokens, ids, counts) is worked out once
per distinct piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# The splitting pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRE_TOKENS = regex.compile(PATTERN)
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
# White space other than the space and the newline.
ODD_ASCII = [chr(c) for c in range(128) if chr(c).isspace() and chr(c) not in " \n"]
ODD = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
MAX_CACHED = 400_000


class Cache(dict):
    """Values by key, worked out when first asked for; emptied when it holds `limit` keys."""

    def __init__(self, make: Callable, limit: int = MAX_CACHED):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def split(text: str) -> list[str]:
    """The pieces of a text; joined by nothing they give the text again.

    All pieces but the first begin with their space.
    """
    parts = BETWEEN_WORDS.split(text)
    return [parts[0], *[" " + part for part in parts[1:]]]


def bare(text: str) -> list[str] | None:
    """The pieces without their leading space, or None where white space other than single spaces is near a space.

    Plain splitting is much faster than the regular expression. It is right where no space stands
    beside white space or at an end, which a few substring searches show.
    """
    if not text or "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
        return None
    if any(c in text for c in (ODD_ASCII if text.isascii() else ODD)):
        return None
    return text.split(" ")


def words_of(piece: str) -> list[str]:
    """The pre-tokens of a piece."""
    return PRE_TOKENS.findall(piece)


class Pieces:
    """Values of the pieces of texts, each made once per distinct piece by `make`."""

    def __init__(self, make: Callable[[str], object], limit: int = MAX_CACHED):
        self.whole = Cache(make, limit // 4)
        self.inner = Cache(lambda part: make(" " + part), limit)

    def values(self, text: str) -> list:
        parts = bare(text)
        if parts is None:
            return [self.whole[piece] for piece in split(text)] if text else []
        return [self.whole[parts[0]], *map(self.inner.__getitem__, parts[1:])]
