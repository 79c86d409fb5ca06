import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import graph, simhash


def brute_fingerprint(text):
    words, now = [], ""
    for c in [*(text or ""), " "]:
        if c in " \t\n\x0b\x0c\r":
            words += [now] * bool(now)
            now = ""
        else:
            now += c.lower() if "A" <= c <= "Z" else c
    parts = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    name = {f: f for f in fps}

    def top(f):
        while name[f] != f:
            f = name[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((top(a), top(b)))
                name[y] = x
    return {f: top(f) for f in fps}


@given(st.text(alphabet="aAbÉ \t\x0b\x1c ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@settings(deadline=None, max_examples=30)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), min_size=0, max_size=4, unique=True), st.sampled_from([2, 4, 6]))
def test_segments_meet(x, bits, distance):
    """Two fingerprints within the distance agree in a segment but for one bit."""
    y = x
    for b in bits[:distance]:
        y ^= 1 << b
    assert any((((x ^ y) >> o) & ((1 << w) - 1)).bit_count() <= 1 for o, w in simhash.segments(distance))
    assert sum(w for _, w in simhash.segments(distance)) == 64


@pytest.mark.parametrize("block", [3, 40, 2048])
def test_links_connect_what_brute_force_does(spark, block):
    """A tight group of many fingerprints, chains and strangers; small blocks take the path of heavy keys."""
    draw = random.Random(block)
    fps = {draw.getrandbits(64) for _ in range(60)}
    for centre in list(fps)[:6]:
        for _ in range(40):
            f = centre
            for b in draw.sample(range(64), draw.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    chain = draw.getrandbits(64)
    for k in range(12):
        chain ^= 0b111 << (5 * k)
        fps.add(chain)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {r["node"]: r["component"] for r in graph.components(simhash.links(df, 4, block)).collect()}
    want = brute_components([signed(f) & (2**64 - 1) for f in fps], 4)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(signed(f))
    for members in groups.values():
        assert {found.get(f, f) for f in members} == {min(members)}


def test_near_duplicates_of_odd_rows(spark, docs_of):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(5, None, None), (3, "", None), (4, " \n", None), (7, long, "en"), (9, long + " end", "en"), (9, long + " end", "en"), (2, "a few words only here", None), (None, "a few words only here", None)]
    docs = docs_of(rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (4, 3), (7, 7), (9, 7), (9, 7), (2, 2), (None, 2)], key=str)
    zero = [r["fingerprint"] for r in simhash.near_duplicates(docs_of([None])).collect()]
    assert zero == ["0" * 16]
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_spanning_keeps_the_components():
    draw = np.random.default_rng(1)
    fps = draw.integers(0, 1 << 20, 80).astype(np.int64)
    fps = np.unique(fps)
    edges = simhash.spanning(fps, 4)
    want = brute_components(fps.tolist(), 4)
    assert len(edges) == len(fps) - len(set(want.values()))
    assert all((int(a) ^ int(b)).bit_count() <= 4 for a, b in edges)


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (200, 201), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert graph.components(df.limit(0)).count() == 0
