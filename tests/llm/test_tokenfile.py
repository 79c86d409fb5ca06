"""Token shards against the library, id by id; parts read alone; the layout of the files."""

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import tokenfile, vocab

ODD = ["a", "B", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'LL", "é", "ß", "1", "²", "<|endoftext|>", "!", "?", "½", "'", "ª", "×", "中", "🙂", "́", "ǅ", "x‍y", "Σ", "İ", ",", "..", "word "]


def texts(n, seed=0):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def ids_of(text, end=1):
    return [*vocab.load("word_bpe_49k.json").encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_hold_the_library_ids_in_order(spark, docs_of):
    given = [*texts(500, 3), None, "", "x" * 100_000, "Word, and word. " * 9000]
    random.Random(1).shuffle(given)
    docs = docs_of([(7 * k - 900, t, None) for k, t in enumerate(given)]).orderBy(F.rand(3))
    got = sorted(tuple(r) for r in tokenfile.round_trip(docs, shards=5).collect())
    start = 0
    for k, (row, text) in enumerate(zip(got, given, strict=True)):
        ids = ids_of(text)
        assert row == (7 * k - 900, start, len(ids), crc(ids))
        start += len(ids)


def test_chunks_over_a_full_table(monkeypatch):
    monkeypatch.setattr(tokenfile, "KEPT", 20)
    given = texts(300, 4)
    encoder = tokenfile.ChunkIds("word_bpe_49k.json")
    for at in range(0, len(given), 7):
        for text, data in zip(given[at : at + 7], encoder.block(given[at : at + 7]), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == ids_of(text)[:-1]


def test_a_full_table_keeps_the_chunks_met_most(monkeypatch):
    monkeypatch.setattr(tokenfile, "KEPT", 20)
    encoder = tokenfile.ChunkIds("word_bpe_49k.json")
    asked, encoded = [], encoder.words.encoded
    monkeypatch.setattr(encoder.words, "encoded", lambda words: asked.extend(words) or encoded(words))
    for k in range(12):
        text = " ".join(["often", "again,"] * 9 + [f"once{chr(97 + k)}{chr(97 + j)}" for j in range(8)])
        assert np.frombuffer(encoder.block([text])[0], "<u4").tolist() == ids_of(text)[:-1]
        assert len(encoder.chunks) <= 20
    assert asked.count("often") == asked.count("again") == 1


def test_blocks_of_odd_texts_and_none():
    encoder = tokenfile.ChunkIds("word_bpe_49k.json")
    given = ["", None, " ", "a\u024fb \u024f", "a \u0250 b", "\u02501 x", "x\x1cy", "x\x20y", "\u212a \u0130", "\u023a", "z <|endoftext|>z", "Z a\x85b\xa0c ", "y" * 70, "\u00c9\u00c9 \u0249"]
    for _ in range(2):
        for texts in (given, given[::-1], given[:2], [None], []):
            assert [np.frombuffer(b, "<u4").tolist() for b in encoder.block(texts)] == [ids_of(t)[:-1] for t in texts]
    assert not any("\u0250" in c or len(c) > 64 for c in encoder.chunks.to_pylist())


def test_words_are_looked_up_without_the_marks_behind_them(monkeypatch):
    encoder = tokenfile.ChunkIds("word_bpe_49k.json")
    words = ["alpha", "b\u00e9ta", "gamma", "\u00aa", "it's", "7"]
    encoder.block([" ".join(words)])
    asked, encoded = [], encoder.words.encoded
    monkeypatch.setattr(encoder.words, "encoded", lambda new: asked.extend(new) or encoded(new))
    given = [".\n".join(words), ", ".join(words) + ","]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.block(given)] == [ids_of(t)[:-1] for t in given]
    assert sorted(asked) == [",", "."] and len(encoder.chunks) == len(words) + 2
    draw = random.Random(9)
    given = ["".join(draw.choice([".", ",", "'", "'s", "'R", "e", "a", "3", "\u00bd", "\u00d7", "\u024f", "\x85", "\xa0", " ", "\t", "-", "\u00ab", "_"]) for _ in range(12)) for _ in range(3000)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.block(given)] == [ids_of(t)[:-1] for t in given]


def test_batches_are_gathered_up_to_a_bound():
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array(["a" * 10])], names=["id", "text"]) for k in range(7)]
    parts = list(tokenfile.gathered(iter(batches), 1, 3 * batches[0].column(1).nbytes))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3, 4, 5], [6]] and list(tokenfile.gathered(iter([]), 1, 5)) == []


def test_slices_are_bounded_by_bytes_and_rows():
    given = ["\u4e2d" * 10, None, "", "a" * 100, "b", "c"] + [""] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(given))), pa.array(given)], names=["id", "text"])
    parts = list(tokenfile.slices(batch, 1, 4, 30))
    assert [len(t) for _, t in parts] == [1, 3, 4, 4, 1]
    assert [x for _, t in parts for x in t] == given and [x for p, _ in parts for x in p.column(0).to_pylist()] == list(range(len(given)))


def test_repeated_ids_null_ids_and_clashing_columns(spark, docs_of):
    docs = docs_of([(1, "a b", None), (1, "a b", None), (1, "c", None), (None, "q", None), (None, None, None)] + [(5, "same words", None)] * 40)
    docs = docs.withColumnRenamed("lang", "start").withColumnRenamed("source", "ids").withColumnRenamed("n_chars", "shard")
    rows = [tuple(r) for r in tokenfile.round_trip(docs, shards=3).collect()]
    assert sorted(r[2] for r in rows) == sorted([3, 3, 2, 2, 1] + [3] * 40)
    rows.sort(key=lambda r: r[1])
    assert [r[0] for r in rows] == [None] * 2 + [1] * 3 + [5] * 40
    at = 0
    for r in rows:
        assert r[1] == at
        at += r[2]


def test_one_id_is_dealt_over_the_shards(spark, docs_of, tmp_path):
    docs = docs_of([(5, "same words", None)] * 400)
    file = tokenfile.write(docs, f"file://{tmp_path}/one", shards=4)
    assert max(r["n_rows"] for r in file.manifest.collect()) < 250


@pytest.fixture(scope="module")
def file(spark, docs_of, tmp_path_factory):
    given = [f"document {k} " + "word " * (k % 50) for k in range(3000)]
    folder = str(tmp_path_factory.mktemp("tokens") / "f")
    return given, folder, tokenfile.write(docs_of(given), f"file://{folder}", shards=4)


def test_lengths_read_no_ids_and_ranges_are_pushed_down(file):
    given, _, tokens = file
    lengths = tokens.lengths(F.col("id").between(100, 110))
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and not any("ids" in s for s in schemas) and "GreaterThanOrEqual(id,100)" in plan
    assert sorted((r["id"], r["n_tokens"]) for r in lengths.collect()) == [(k, len(ids_of(given[k]))) for k in range(100, 111)]


@pytest.mark.parametrize(("first", "last"), [(0, 1), (0, 10**9), (5, 5), (17, 4000), (30_000, 30_400), (10**9, 10**9 + 5)])
def test_spans_of_the_stream(file, first, last):
    given, _, tokens = file
    stream = [i for t in given for i in ids_of(t)]
    rows = sorted(tokens.span(first, last).collect(), key=lambda r: r["start"])
    assert [i for r in rows for i in r["ids"]] == stream[first:last]
    assert all(r["n_tokens"] == len(r["ids"]) and stream[r["start"] : r["start"] + r["n_tokens"]] == r["ids"] for r in rows)


def test_layout_of_the_files(file):
    _, folder, _ = file
    for path in glob.glob(f"{folder}/shards/*.parquet"):
        group = pq.ParquetFile(path).metadata.row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("id", "start", "n_tokens"))
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())


def test_no_rows(docs_of):
    assert tokenfile.round_trip(docs_of([])).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert tokenfile.round_trip(docs_of([])).count() == 0
