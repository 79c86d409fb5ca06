"""Web-style text queries: words are required, "quoted words" are phrases, OR separates alternatives, -word excludes.

A query is parsed on the driver into alternatives, each a list of required and excluded phrases. Matching is a JVM expression.
The rank is cover density (Clarke, Cormack and Tudhope): each minimal stretch of the text that satisfies the query adds
0.1 / (1 + words in it that are not the query's). Queries of one word rank by the JVM; others by an Arrow function over the
rows that match.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHT = 0.1
_PART = re.compile(r'(-?)"([^"]*)"|(\S+)')
_WORD = re.compile(r"[^\W_]+")

Phrase = tuple[str, ...]


_EDGE = r"[\p{L}\p{N}]"


def _pattern(p: Phrase) -> str:
    """The phrase as whole words with anything but letters and digits between them; its words need no escapes."""
    return f"(?<!{_EDGE})" + r"[^\p{L}\p{N}]+".join(p) + f"(?!{_EDGE})"


@dataclass(frozen=True)
class TextQuery:
    """(required phrases, excluded phrases) of each alternative."""

    alternatives: tuple[tuple[tuple[Phrase, ...], tuple[Phrase, ...]], ...]

    @property
    def empty(self) -> bool:
        return not self.alternatives

    @property
    def words(self) -> frozenset[str]:
        """All words of its phrases, those of excluded ones too."""
        return frozenset(w for required, excluded in self.alternatives for p in (*required, *excluded) for w in p)

    @property
    def word(self) -> str | None:
        """The word, if the query is one word."""
        return next(iter(self.words)) if len(self.words) == 1 and self.alternatives == ((((next(iter(self.words)),),), ()),) else None

    def matches(self, text: Column) -> Column:
        """Whether a text satisfies the query; an empty query matches nothing."""
        lower = F.lower(text)

        def has(p: Phrase) -> Column:
            # plain substring tests first: most texts fail one of them, and are spared the pattern
            out = F.lit(True)
            for w in p:
                out &= F.contains(lower, F.lit(w))
            return out & F.rlike(lower, F.lit(_pattern(p)))

        out = F.lit(False)
        for required, excluded in self.alternatives:
            one = F.lit(True)
            for p in required:
                one &= has(p)
            for p in excluded:
                one &= ~has(p)
            out |= one
        return F.coalesce(out, F.lit(False))

    def rank(self, text: Column) -> Column:
        """Cover density of a text; 0 where it does not match."""
        single = {p for required, _ in self.alternatives for p in required}
        if len(single) == 1 and len(word := next(iter(single))) == 1:
            n = F.regexp_count(F.lower(text), F.lit(_pattern(word)))
            return F.when(self.matches(text), n * F.lit(WEIGHT)).otherwise(F.lit(0.0))
        query = self

        @F.pandas_udf(T.DoubleType())
        def covers(texts: pd.Series) -> pd.Series:
            return pd.Series([query.cover_density(t) for t in texts], dtype="float64")

        return F.when(self.matches(text), covers(text)).otherwise(F.lit(0.0))

    def cover_density(self, text: str | None) -> float:
        at: dict[str, list[int]] = {}
        asked = self.words
        for k, w in enumerate(_WORD.findall((text or "").lower())):
            if w in asked:
                at.setdefault(w, []).append(k)
        return self.density(at)

    def density(self, at: dict[str, list[int]]) -> float:
        """Cover density from the places of the query's words in a text."""
        places: dict[Phrase, list[int]] = {}
        for required, excluded in self.alternatives:
            for p in (*required, *excluded):
                if p not in places:
                    rest = [set(at.get(w, ())) for w in p[1:]]
                    places[p] = [k for k in at.get(p[0], ()) if all(k + n in r for n, r in enumerate(rest, 1))]
        open_ = [required for required, excluded in self.alternatives if required and not any(places[p] for p in excluded) and all(places[p] for p in required)]
        events = sorted((k, k + len(p) - 1, p) for p in {p for r in open_ for p in r} for k in places[p])
        total = 0.0
        for noise in _covers(events, open_):
            total += WEIGHT / (1 + noise)  # one by one as SQL adds; Python's sum also carries what rounding loses
        return total


def _covers(events: list[tuple[int, int, Phrase]], alternatives: list[tuple[Phrase, ...]]) -> Iterable[int]:
    """Words between a cover's query words, for each minimal cover: none that satisfies the query lies within another."""
    held: dict[Phrase, int] = {}
    left = 0

    def satisfied() -> bool:
        return any(all(held.get(p) for p in required) for required in alternatives)

    for right, (_, _, phrase) in enumerate(events):
        held[phrase] = held.get(phrase, 0) + 1
        last = None
        while satisfied():
            last = left
            held[events[left][2]] -= 1
            left += 1
        if last is not None:
            inside = events[last : right + 1]
            stretch = max(e[1] for e in inside) - inside[0][0] + 1
            yield max(0, stretch - sum(len(e[2]) for e in inside))


def parse(text: str) -> TextQuery:
    """Parts without a word are ignored, as are alternatives that require nothing."""
    alternatives, required, excluded = [], [], []

    def close() -> None:
        if required:
            alternatives.append((tuple(dict.fromkeys(required)), tuple(dict.fromkeys(excluded))))
        required.clear()
        excluded.clear()

    for minus, quoted, plain in _PART.findall(text):
        if plain.upper() == "OR" and plain:
            close()
            continue
        negative = bool(minus) or plain.startswith("-")
        words = tuple(_WORD.findall((quoted or plain).lower()))
        if words:
            # a plain part such as x-200 is a phrase of its words
            (excluded if negative else required).append(words)
    close()
    return TextQuery(tuple(alternatives))
