"""The near-dedup stage against brute-force five-word shingle similarity."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from corpusloom.llm import copies


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_groups(texts):
    bags = [bag(t) for t in texts]
    name = list(range(len(texts)))

    def top(k):
        while name[k] != k:
            k = name[k]
        return k

    for b in range(len(texts)):
        for a in range(b):
            x, y = bags[a], bags[b]
            shared = sum((x & y).values())
            if x == y or 9 * shared >= 4 * (sum(x.values()) + sum(y.values())) and shared:
                p, q = sorted((top(a), top(b)))
                name[q] = p
    return {k: top(k) for k in range(len(texts))}


def word(draw):
    return "".join(draw.choice("abcdefghijkl") for _ in range(6))


def test_every_length_against_brute_force(spark, docs_of):
    """One word appended, at each length from 1 to 130 words; and copies with edits around the threshold."""
    draw = random.Random(0)
    texts = []
    for n in range(1, 131):
        w = [word(draw) for _ in range(n)]
        texts += [" ".join(w), " ".join([*w, word(draw)])]
        v = list(w)
        for _ in range(draw.randint(0, n // 30 + 1)):
            v[draw.randrange(n)] = word(draw)
        texts += [" ".join(v), " ".join(reversed(w)), " ".join([*w, *w])]
    draw.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs_of(texts)).collect()}
    assert got == brute_groups(texts)


@pytest.mark.parametrize("few,block", [(32, 512), (3, 4)])
def test_large_groups_and_shared_lines(spark, docs_of, monkeypatch, few, block):
    monkeypatch.setattr(copies, "FEW", few)
    monkeypatch.setattr(copies, "BLOCK", block)
    draw = random.Random(1)
    source, line = [word(draw) for _ in range(60)], [word(draw) for _ in range(30)]
    texts = [" ".join(source)] * 5
    for k in range(120):
        v = list(source)
        for _ in range(k % 4):
            v[draw.randrange(60)] = word(draw)
        texts.append(" ".join(v))
        texts.append(" ".join(line + [word(draw) for _ in range(draw.choice([4, 6, 8, 10, 30]))]))
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs_of(texts)).collect()}
    assert got == brute_groups(texts)


def test_the_stage_keeps_the_same_words_in_another_order_and_drops_short_copies(spark, docs_of):
    draw = random.Random(2)
    w, s = [word(draw) for _ in range(150)], [word(draw) for _ in range(8)]
    texts = [" ".join(w), " ".join(sorted(w)), " ".join(s), " ".join([*s, "more"])]
    kept = corpus_pipeline.near_dedup(spark, docs_of(texts), "")
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2}


@pytest.mark.parametrize("common", [200_000, 40])
def test_shared_passages_with_more_of_their_own(spark, docs_of, monkeypatch, common):
    """Texts around a passage of all of them, which a sample shows to be common, with few to many words of their own; and texts
    made of the same lines in other orders. Some of the common shingles may be beyond those kept."""
    monkeypatch.setattr(copies, "SAMPLED", 2)
    monkeypatch.setattr(copies, "FEW", 4)
    monkeypatch.setattr(copies, "BLOCK", 8)
    monkeypatch.setattr(copies, "COMMON", common)
    draw = random.Random(4)
    passage = [word(draw) for _ in range(50)]
    lines = [[word(draw) for _ in range(12)] for _ in range(6)]
    texts = []
    for k in range(60):
        own = [word(draw) for _ in range(k % 16)]
        texts.append(" ".join(passage + own if k % 2 else own + passage))
        texts.append(" ".join(w for line in draw.sample(lines, draw.choice([4, 5, 6])) for w in line))
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs_of(texts)).collect()}
    assert got == brute_groups(texts)


def test_sketches_fold_and_never_rule_out_a_copy():
    draw = random.Random(5)
    for n in (3, 400, 600, 1300):
        w = [word(draw).encode() for _ in range(n)]
        x, y = copies.shingles(w), copies.shingles([*w[: n // 2], *w[n // 2 + n // 60 :]])
        s, t = copies.sketch(x), copies.sketch(y)
        k = min(len(s), len(t))
        fold = lambda a: a if len(a) == k else a[:k] ^ a[k:]
        bits = sum(int(v).bit_count() for v in (fold(s) ^ fold(t)).view("u8"))
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_odd_rows(spark, docs_of):
    rows = [(5, None, None), (3, "", None), (9, "One two", None), (8, "one  two\n", None), (None, "other", None), (2, "two one", None)]
    got = {(r["doc_id"], r["component_id"]) for r in copies.near_copies(docs_of(rows)).collect()}
    assert got == {(5, 3), (3, 3), (9, 8), (8, 8), (None, None), (2, 2)}
    assert copies.near_copies(docs_of([])).count() == 0


def test_later_stages_on_what_the_stage_keeps(spark, docs_of, tmp_path):
    """A copy with its last word replaced (similarity 0.96), whose word fingerprints are too far apart, goes; the rest stays."""
    draw = random.Random(3)
    texts = []
    for _ in range(40):
        w = [word(draw) for _ in range(60)]
        texts += [" ".join(w), " ".join([*w[:-1], "other"])]
    kept = corpus_pipeline.near_dedup(spark, docs_of(texts), "")
    assert {r["doc_id"] for r in kept.collect()} == set(range(0, 80, 2))
