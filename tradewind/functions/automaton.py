"""All phrases of many lists found in a text in one pass, and the best phrase of a list among what was found."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(8)
def _automaton(entries: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    """Of (phrase, border); a phrase stands for the numbers of all its entries."""
    found: dict[tuple[str, str], list[int]] = {}
    for k, entry in enumerate(entries):
        found.setdefault(entry, []).append(k)
    out = ahocorasick.Automaton()
    for phrase in {p for p, _ in found}:
        out.add_word(phrase, (len(phrase), [(border, found[phrase, border]) for border in ("", "latin", "word") if (phrase, border) in found]))
    out.make_automaton()
    return out


def _latin(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def _word(c: str) -> bool:
    return c == "_" or c.isalnum()


_INSIDE: dict[str, Callable[[str], bool]] = {"latin": _latin, "word": _word}


def _bordered(text: str, start: int, end: int, border: str) -> bool:
    """Whether no character of the kind goes on beside a phrase that begins (ends) with one."""
    inside = _INSIDE[border]
    if start and inside(text[start]) and inside(text[start - 1]):
        return False
    return end == len(text) or not (inside(text[end - 1]) and inside(text[end]))


class Lexicon:
    """Numbered phrases of several lists; the same phrase may be in many of them."""

    def __init__(self, plain: Callable[[str], str]):
        self.plain = plain
        self.entries: list[tuple[str, str]] = []
        self.values: list[str] = []

    def add(self, aliases: Mapping[str, str], border: Callable[[str], str]) -> list[int]:
        """The numbers of a list of aliases and what they stand for; of aliases that are one when normalised, the last value counts.
        ``border`` tells what must not go on beside a phrase: nothing (""), Latin letters and digits (latin), or word characters."""
        known: dict[str, str] = {}
        for alias, value in aliases.items():
            known[self.plain(alias)] = value
        known.pop("", None)
        first = len(self.entries)
        self.entries += [(p, border(p)) for p in known]
        self.values += known.values()
        return list(range(first, len(self.entries)))

    def hits(self, text: Column) -> Column:
        """Numbers of the phrases in a text, longest first, then in their order."""
        entries = tuple(self.entries)

        def found(x: str | None) -> list[int]:
            at: set[tuple[int, int]] = set()
            for end, (size, kinds) in _automaton(entries).iter(x) if x else ():
                for border, numbers in kinds:
                    if not border or _bordered(x, end + 1 - size, end + 1, border):
                        at.update((-size, k) for k in numbers)
            return [k for _, k in sorted(at)]

        @F.pandas_udf("array<int>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(found)

        return run(text)

    def best(self, hits: Column, numbers: Iterable[int]) -> Column:
        """What the first hit stands for that is one of these numbers; null if none is."""
        own = sorted(numbers)
        if not own:
            return F.lit(None).cast("string")
        whole = own[-1] - own[0] + 1 == len(own)
        is_own = (lambda h: h.between(own[0], own[-1])) if whole else (lambda h: h.isin(*own))
        return F.get(F.lit(self.values), F.get(F.filter(hits, is_own), 0))
