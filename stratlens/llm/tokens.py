"""Token ids of whole texts with a bounded cache of their pieces.

Merges never cross the pieces that the pre-tokeniser cuts, and pieces repeat, so most are looked up. Texts of
Latin letters, digits and ASCII marks without apostrophes, with single spaces and single line ends, are
the rule; there the pre-tokeniser's pattern comes down to PLAIN, which Python's re finds fast. Any other
text is odd and is split by the full pattern or encoded whole.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterable

ENTRIES = 250_000
LETTER, DIGIT, MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9", r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f" ?[{LETTER}]+| ?[{MARK}]+|\n| ?[{DIGIT}]+").findall
ODD = re.compile(f"[^{LETTER}{DIGIT}{MARK} \n]|  | \n|\n[ \n]| $").search


class Generations:
    """Lookup tables from strings to tuples of bytes, in two generations: a full young one becomes the old one.

    What is used again moves back to the young one, so frequent keys stay and at most about twice the
    entries, plus those of the batch at hand, are held.
    """

    def __init__(self, entries: int, width: int):
        self.entries, self.width = entries, width
        self.young: list[dict] = [{} for _ in range(width)]
        self.old = self.young

    def missing(self, keys: set[str]) -> set[str]:
        """Keys in neither generation; the others are in the young one afterwards."""
        if len(self.young[0]) > self.entries:
            self.old, self.young = self.young, [{} for _ in range(self.width)]
        new = keys - self.young[0].keys()
        back = new & self.old[0].keys()
        for young, old in zip(self.young, self.old, strict=True):
            young.update((key, old[key]) for key in back)
        return new - back

    def add(self, keys: Iterable[str], values: Iterable[tuple]) -> None:
        for young, column in zip(self.young, zip(*values, strict=True), strict=False):
            young.update(zip(keys, column, strict=True))

    def row(self, key: str) -> tuple:
        return tuple(young[key] for young in self.young)

    def join(self, keys: list[str]) -> list[bytes]:
        return [b"".join(map(young.__getitem__, keys)) for young in self.young]


class WordCache:
    """Joined bytes of texts, from an encoder that gives a tuple of bytes (ids first) for each piece.

    exact splits an odd text into pieces; without it such a text is encoded whole.
    """

    def __init__(
        self, encode: Callable[[list[str]], Iterable[tuple[bytes, ...]]], width: int = 1, entries: int = ENTRIES,
        exact: Callable[[str], list[str]] | None = None,
    ):
        self.encode, self.exact, self.known = encode, exact, Generations(entries, width)

    def joined(self, texts: list[str]) -> list[tuple[bytes, ...]]:
        split = [PLAIN(t) for t in texts]
        # What PLAIN leaves out, or two line ends in a row, makes a text odd.
        odd = [k for k, t in enumerate(texts) if sum(map(len, split[k])) != len(t) or "\n\n" in t]
        whole = {}
        for k in odd:
            split[k] = self.exact(texts[k]) if self.exact else []
        if odd and not self.exact:
            whole = dict(zip(odd, self.encode([texts[k] for k in odd]), strict=True))
        new = list(self.known.missing(set().union(*split)))
        self.known.add(new, self.encode(new))
        return [whole[k] if k in whole else tuple(self.known.join(pieces)) for k, pieces in enumerate(split)]


def packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()
