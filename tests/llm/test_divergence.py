"""The source audit against a plain computation, with rare and common terms and with tiles of a few groups."""

import random
import re
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import divergence

FIELDS = "doc_id long, text string, lang string, source string, n string, term string, total string"


def plainly(rows, least, ranks=50):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in held[lang].items() if n >= least]

        def shares(n, kept=kept):
            total = sum(n[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (n[w] + 5) // (total + 5 * len(kept)) for w in kept}

        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[t][w]) for w in kept), t) for t in sources if t != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def rows_of(n, sources, seed=0):
    draw = random.Random(seed)
    words = ["the", "The", "RYE", "oat", "été", "中文", "x1y", "don't", "a_b", "[z]", "Été", "ÀB", "@at`q{r~"] + [f"w{chr(97 + k)}" for k in range(20)]
    out = []
    for _ in range(n):
        s = draw.randrange(sources)
        mine = words[: 8 + s % 6] + words[s % len(words) :][:3]
        out.append((" ".join(draw.choice(mine) for _ in range(draw.randint(0, 12))), draw.choice(["en", "en", "de", None]), f"s{s}"))
    return out


@pytest.mark.parametrize(("rare", "tile", "terms"), [(0, 128, 2048), (3, 4, 5), (100, 4, 2048)])
def test_against_a_plain_computation(spark, monkeypatch, rare, tile, terms):
    monkeypatch.setattr(divergence, "GROUPS", tile)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rows = rows_of(300, 11) + [(None, "en", "s1"), ("", "en", "empty"), (None, None, None), ("...", "fr", "one"), ("12", "fr", "two"), (None, "it", "alone")] + [("rye rye " * 500, "en", "hot")] * 40
    docs = spark.createDataFrame([(k, *r, "n", "t", "z") for k, r in enumerate(rows)], FIELDS)
    got = sorted(tuple(r) for r in divergence.audit(docs, least=6, rare=rare).collect())
    want = plainly(rows, 6)
    assert got == want and {r[2] for r in want} == {"pair", "term"}


def test_few_ranks_and_full_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    rows = rows_of(200, 3, 2)
    docs = spark.createDataFrame([(k, *r, "n", "t", "z") for k, r in enumerate(rows)], FIELDS)
    got = sorted(tuple(r) for r in divergence.audit(docs, ranks=2, least=5).collect())
    assert got == plainly(rows, 5, 2)


def test_no_rows_and_no_kept_terms(spark):
    none = spark.createDataFrame([], FIELDS)
    assert divergence.audit(none).count() == 0
    two = spark.createDataFrame([(1, "a", "en", "x", "", "", ""), (2, "b", "en", "y", "", "", "")], FIELDS)
    assert sorted(tuple(r) for r in divergence.audit(two).collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_beyond_64_bits(spark):
    n = 60_000_000_000
    row = spark.createDataFrame([(n, 3 * n, 7)], "n long, total long, kept long").select(divergence.share("n")).first()
    assert row[0] == 1 + 1_000_000_000 * (n + 5) // (3 * n + 35)


