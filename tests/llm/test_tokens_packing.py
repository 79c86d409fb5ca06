import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import packing, tokens, vocab

ODD = ["a", "B", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'LL", "é", "ß", "1", "²", "<|endoftext|>", "!", "?", "½", "'", "ª", "×", "中", "🙂", "́", "ǅ", "x‍y", "Σ", "İ"]


def texts(n, seed=0):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_counts_equal_the_library(spark, docs_of):
    given = [*texts(600), None, "", "x" * 200_000, "word " * 60_000]
    lib = vocab.load("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs_of(given)).collect()}
    for k, t in enumerate(given):
        assert got[k]["n_tokens"] == len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[k]["n_bytes"] == len((t or "").encode())
        assert got[k]["over_limit"] == (got[k]["n_tokens"] > 512)


def test_counts_do_not_depend_on_what_is_joined_how(spark, docs_of):
    given = [*texts(300, 2), None, "", "y" * 3000 + " the end", "the " * 2000, *["the one line <|endoftext|> of many"] * 200]
    lib = vocab.load("byte_bpe_50k.json")
    want = sorted((k, len(lib.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(given))
    for kept in (0, 3, 10**6):
        assert sorted((r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(docs_of(given), kept=kept).collect()) == want


def test_each_distinct_pretoken_is_counted_once(spark, docs_of):
    given = [*texts(200, 4), "a b a", None]
    got = tokens.piece_counts(docs_of(given).select("text"), "byte_bpe_50k.json", kept=5).collect()
    cut = tokens.counter("byte_bpe_50k.json")
    found = defaultdict(int)
    for t in given:
        for p in cut.pretokens(t or ""):
            found[p] += 1
    assert sorted((r["pre"], r["n"]) for r in got) == sorted(found.items())
    assert all(r["pieces"] == len(cut.lib.encode(r["pre"], add_special_tokens=False).ids) for r in got)


def test_counts_of_no_rows_and_repeated_ids(spark, docs_of):
    assert tokens.count_tokens(docs_of([])).count() == 0
    twice = docs_of([(1, "a b c", None), (1, "a b c", None), (None, "q", None)])
    assert sorted(r["n_tokens"] for r in tokens.count_tokens(twice.withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "n_bytes")).collect()) == [1, 3, 3]


def test_pieces_are_the_ids_cut_without_gaps(spark, docs_of):
    given = [*texts(300, 1), None, "", "some words here " * 9000, "z" * 30_000]
    lib = vocab.load("word_bpe_49k.json")
    rows = packing.pack(docs_of(given), capacity=256, pool=50).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for k, t in enumerate(given):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256


def test_padding_is_small(spark):
    from corpusloom.sources.tables import table

    rows = packing.pack(table(spark, "/root/testdata/sf0.01", "documents")).groupBy("sequence_id").sum("length").collect()
    used = [r[1] for r in rows]
    assert sum(used) / (4096 * len(used)) > 0.97


def test_pack_of_repeated_rows_null_ids_and_clashing_columns(spark, docs_of):
    docs = docs_of([(1, "a b c", None), (1, "a b c", None), (None, "q", None), (None, None, None)])
    docs = docs.withColumnRenamed("lang", "start").withColumnRenamed("source", "sequence_id").withColumnRenamed("n_chars", "offset")
    rows = packing.pack(docs).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (0, 2), (1, 4), (1, 4)]
    assert packing.pack(docs).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:], strict=False))


def test_pack_of_no_rows(spark, docs_of):
    assert packing.pack(docs_of([])).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_differencing_keeps_all_and_balances(k):
    draw = random.Random(k)
    sizes = [draw.randint(1, 1000) for _ in range(200)]
    windows = packing.differencing(sizes, k)
    assert sorted(i for w in windows for i in w) == list(range(200))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert len(sums) <= k and max(sums) - min(sums) <= max(sizes) // 10


def test_known_case_of_two_way_differencing():
    # the textbook case: 4, 5, 6, 7, 8 differ by 2 under Karmarkar-Karp
    sums = sorted(sum([4, 5, 6, 7, 8][i] for i in w) for w in packing.differencing([4, 5, 6, 7, 8], 2))
    assert sums == [14, 16]


def test_window_count_rises_when_a_window_overflows():
    assert len(packing.packed([6, 6, 6], 10)) == 3  # 18 would fit in two by its sum
