"""Splitting text into the pieces that byte-level BPE merges within.

Most texts hold only ASCII and Latin letters. For those the general pattern's classes are
plain character ranges, which the standard ``re`` module scans about twice as fast; any
other text goes through the ``regex`` module and the full Unicode classes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Fixed value: the split pattern that the character ranges below restate.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_BLANKS = r"\x20\t\n\r"
_outside = re.compile(rf"[^\t\n\r\x20-\x7e{_LETTERS}]").search
#: A piece of these characters alone is its own only match, whichever engine's classes are asked.
plain = re.compile(rf"[\x20-\x7e{_LETTERS}]+").fullmatch
_fast = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_BLANKS}0-9{_LETTERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
).findall


class Memo:
    """A bounded map from piece to what was made of it: when a generation is full, the one before it goes."""

    def __init__(self, make: Callable[[list[str]], list], size: int = 400_000):
        self.make, self.size = make, size
        self.new: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def all(self, pieces: list[str]) -> list:
        """What was made of each piece, in order."""
        new = self.new
        made = list(map(new.get, pieces))
        if None in made:
            old, missing = self.old, []
            for p in {p for p, m in zip(pieces, made) if m is None}:
                if p in old:
                    new[p] = old[p]
                else:
                    missing.append(p)
            new.update(zip(missing, self.make(missing) if missing else ()))
            made = list(map(new.__getitem__, pieces))
            if len(new) > self.size:
                self.old, self.new = new, {}
        return made


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that returns all matches of ``pattern`` in a text, in order."""
    general = regex.compile(pattern).findall
    if pattern != PATTERN:
        return general
    return lambda text: general(text) if _outside(text) else _fast(text)
