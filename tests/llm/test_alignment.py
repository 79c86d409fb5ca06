"""Alignment against a plain encoding of whole texts, and corpus counts against a dictionary."""

import gc
import hashlib
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from corpusloom.llm import alignment

ODD = ["a", "B", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "é", "ß", "1", "²", "<|endoftext|>", "<s>", "!", "'", "中", "🙂", "́", "x‍y", "\r", "\r\n", "\x00", "　", "ing", "tion", ".", ", "]
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def texts(n, seed=0):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 30))) for _ in range(n)] + [None, "", "▁", "a▁b c", " ", "a ", " a", "a  b", "x y\n z", "word " * 3000, "y" * 5000]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(str(public_tokenizers.path(A)))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(B)))


def plainly(libraries, text):
    """Groups of ids, from the libraries' own ids and pieces."""
    if not text:
        return []
    a, b = libraries
    spaced = (" " + text).encode()
    one, two = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    letters = dict(zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True))
    for k in range(256):
        letters.setdefault(k, chr(256 + len([x for x in letters if ord(letters[x]) >= 256])))
    byte = {c: k for k, c in letters.items()}
    left = [bytes(byte[c] for c in a.id_to_token(i)) for i in one.ids]
    right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]
    if b"".join(left) != spaced or b"".join(right) != spaced:
        return []
    ends = [[sum(map(len, t[: k + 1])) for k in range(len(t))] for t in (left, right)] if len(spaced) < 2000 else [_sums(left), _sums(right)]
    out, at = [], 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        out.append(([i for i, x in zip(one.ids, ends[0], strict=True) if at < x <= e], [i for i, x in zip(two, ends[1], strict=True) if at < x <= e]))
        at = e
    return out


def _sums(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def told(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_merge_of_ends():
    assert alignment.merged([1, 3, 6, 7], [2, 3, 4, 7]) == [(2, 2), (4, 4)]
    assert alignment.merged([], [1]) == [] and alignment.merged([2], [2]) == [(1, 1)]


@pytest.mark.parametrize("kept", [700_000, 10])
def test_blocks_are_whole_texts(libraries, monkeypatch, kept):
    monkeypatch.setattr(alignment, "KEPT", kept)
    given = [t for t in texts(400, 1) if not t or len(t) < 2000]
    own = alignment.Aligner(A, B)
    for at in range(0, len(given), 50):
        part = given[at : at + 50]
        n_a, n_b, n_groups, out, links, first = own.block(part)
        for k, t in enumerate(part):
            want = plainly(libraries, t)
            assert out[k] == told(want)
            assert (n_a[k], n_b[k], n_groups[k]) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want))
            got = {divmod(int(x) >> alignment.BITS, own.width): int(x) & (1 << alignment.BITS) - 1 for x in links[first[k] : first[k + 1]]}
            assert got == Counter((a[-1], b[-1]) for a, b in want)


def test_a_full_table_keeps_the_units_met_most(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 20)
    own = alignment.Aligner(A, B)
    asked, tokens = [], own._tokens
    monkeypatch.setattr(own, "_tokens", lambda text: asked.extend(text.split()) or tokens(text))
    for k in range(12):
        text = " ".join(["often", "again,"] * 9 + [f"once{chr(97 + k)}{chr(97 + j)}" for j in range(8)])
        assert own.block([text])[3] == [told(plainly(libraries, text))]
    assert asked.count("often") == asked.count("again,") == 1


def test_a_worker_holds_little_for_each_unit():
    draw = random.Random(8)
    units = sorted({"".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(5, 12))) for _ in range(8000)})
    own = alignment.Aligner(A, B)
    own.block(["some words"])
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    for at in range(0, len(units), 1000):
        own.block([" ".join(units[at : at + 1000])])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held / len(units) < 200


@pytest.mark.parametrize("heavy", [1_000_000, 20])
def test_the_whole_operator(spark, docs_of, libraries, heavy):
    given = texts(150, 2) + ["the same words again, and again"] * 20 + ["the words of others"] * 3
    groups = [plainly(libraries, t) for t in given]
    counts = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    got = {r["doc_id"]: r.asDict() for r in alignment.alignment(docs_of(given), heavy=heavy).collect()}
    assert len(got) == len(given)
    for k, g in enumerate(groups):
        links = [(a[-1], b[-1]) for a, b in g]
        assert got[k] == {
            "doc_id": k, "n_a": sum(len(a) for a, _ in g), "n_b": sum(len(b) for _, b in g), "n_groups": len(g), "n_links": len(links),
            "n_best": sum(counts[x] == top[x[1]] for x in links), "count_sum": sum(counts[x] for x in links), "groups_sha256": hashlib.sha256(told(g).encode()).hexdigest() if g else "",
        }


def test_pairs_have_the_highest_of_either_side(spark, docs_of, libraries):
    from corpusloom.llm import scratch

    given = texts(60, 5)
    counts = Counter((a[-1], b[-1]) for t in given for a, b in plainly(libraries, t))
    rows = alignment.pairs(scratch.stored(alignment.aligned(docs_of(given)), "test")).collect()
    assert {(r["a"], r["b"]): r["n"] for r in rows} == counts
    for r in rows:
        assert r["best_a"] == (r["n"] == max(n for (a, _), n in counts.items() if a == r["a"]))
        assert r["best_b"] == (r["n"] == max(n for (_, b), n in counts.items() if b == r["b"]))


def test_repeated_rows_null_ids_clashing_columns_and_no_rows(spark, docs_of):
    docs = docs_of([(1, "a b", None), (1, "a b", None), (None, "a", None), (None, None, None)])
    docs = docs.withColumnRenamed("lang", "row").withColumnRenamed("source", "links").withColumnRenamed("n_chars", "n")
    rows = alignment.alignment(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in rows) == [(0, 0, 0), (0, 1, 3), (1, 2, 5), (1, 2, 5)]
    assert alignment.alignment(docs_of([])).count() == 0
