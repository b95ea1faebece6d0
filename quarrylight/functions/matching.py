"""Matching runs of a short string in a long one: longest first, then left and right of it, without comparing all pairs of characters."""

from __future__ import annotations

import numpy as np

#: From this length on, characters that make up over a hundredth of the text begin no run.
LONG, COMMON = 200, 100
#: Fixed value: runs shorter than this are chance.
LEAST_RUN = 3


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Runs:
    """The places in a text of each character of a quote; a character that is common in a long text has none."""

    def __init__(self, quote: str, text: str):
        self.quote, self.text = quote, text
        codes = _codes(text)
        most = len(text) // COMMON + 1 if len(text) >= LONG else len(text)
        places = {c: np.flatnonzero(codes == ord(c)) for c in set(quote)}
        self.places = {c: p for c, p in places.items() if 0 < len(p) <= most}
        self.lengths = np.zeros(len(text) + 1, np.int32)

    def longest(self, low: int, high: int, left: int, right: int) -> tuple[int, int, int]:
        """Begin in the quote, begin in the text and size of the longest run in quote[low:high] and text[left:right].

        Of equally long ones the first in the quote, then in the text. Lengths of runs that end at a place are kept for one
        character of the quote at a time, at its places alone. The run found is then drawn out over common characters.
        """
        lengths, before = self.lengths, np.zeros(0, np.int64)
        begin, place, size = low, left, 0
        for i in range(low, high):
            own = self.places.get(self.quote[i])
            if own is None:
                lengths[before + 1] = 0
                before = np.zeros(0, np.int64)
                continue
            own = own[np.searchsorted(own, left) : np.searchsorted(own, right)]
            runs = lengths[own] + 1
            lengths[before + 1] = 0
            lengths[own + 1] = runs
            before = own
            if len(runs) and (most := int(runs.max())) > size:
                size = most
                begin, place = i - size + 1, int(own[int(runs.argmax())]) - size + 1
        lengths[before + 1] = 0
        quote, text = self.quote, self.text
        while begin > low and place > left and quote[begin - 1] == text[place - 1]:
            begin, place, size = begin - 1, place - 1, size + 1
        while begin + size < high and place + size < right and quote[begin + size] == text[place + size]:
            size += 1
        return begin, place, size

    def all(self) -> list[tuple[int, int, int]]:
        """All runs, in order; runs that follow on one another in both strings are one."""
        found, parts = [], [(0, len(self.quote), 0, len(self.text))]
        while parts:
            low, high, left, right = parts.pop()
            begin, place, size = self.longest(low, high, left, right)
            if size:
                found.append((begin, place, size))
                if low < begin and left < place:
                    parts.append((low, begin, left, place))
                if begin + size < high and place + size < right:
                    parts.append((begin + size, high, place + size, right))
        joined: list[tuple[int, int, int]] = []
        for begin, place, size in sorted(found):
            if joined and joined[-1][0] + joined[-1][2] == begin and joined[-1][1] + joined[-1][2] == place:
                joined[-1] = (*joined[-1][:2], joined[-1][2] + size)
            else:
                joined.append((begin, place, size))
        return joined


def overlap(quote: str, text: str) -> float:
    """Share of a quote in matching runs of three or more characters of a text."""
    return sum(size for *_, size in Runs(quote, text).all() if size >= LEAST_RUN) / max(len(quote), 1)
