"""Each stage against a brute-force version on its own input, and the whole run."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from corpusloom import session
from corpusloom.llm import pii
from tests.llm.test_copies import brute_groups
from tests.llm.test_decontam_pii import words

NAMES = ["language_id", "near_dedup", "decontaminate", "mask_pii", "pack"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw = random.Random(0)
    folder = str(tmp_path_factory.mktemp("sf"))
    items = [" ".join(words(draw, 30)) for _ in range(5)]
    rows = []
    for k in range(120):
        text = words(draw, 60)
        if k % 6 == 1:
            text[10:10] = items[k % 5].split()
        if k % 6 == 2:
            text.append("me.you@site.example.org")
        if k % 6 == 3:
            text = rows[-3][1].split() if rows[-3][1] else text
            text = [*text[:-1], "other"]
        rows.append((k, " ".join(text) if k % 6 != 4 else "12 34 %%", "en" if k % 5 else None, "s", 0))
    rows += [(200, None, "en", None, None), (201, "", None, "s", 0), (None, rows[0][1], "en", "s", 1), (None, "alone without an id here", "en", "s", 1), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages_by_name():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_on_its_own_input(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    row = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    kept = stage["language_id"](spark, docs, folder)
    assert kept.schema == docs.schema
    assert row(kept) == sorted(((r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=str)

    unique = stage["near_dedup"](spark, kept, folder)
    assert unique.schema == docs.schema
    part = brute_groups([t for _, t in row(kept)])
    least = {}
    for k, (i, t) in enumerate(row(kept)):
        c = part[k]
        least[c] = min(least.get(c, (float("inf"), t)), (float("inf") if i is None else i, t))
    assert row(unique) == sorted(((None if i == float("inf") else i, t) for i, t in least.values()), key=str)

    clean = stage["decontaminate"](spark, unique, folder)
    assert clean.schema == docs.schema
    assert row(clean) == [(i, t) for i, t in row(unique) if not any(x.lower() in t.lower() for x in items)]

    masked = stage["mask_pii"](spark, clean, folder)
    assert masked.schema == docs.schema
    assert row(masked) == sorted(((i, t.replace("me.you@site.example.org", "[EMAIL]")) for i, t in row(clean)), key=str)
    assert not any(any(pii.base(t).values()) for _, t in row(masked))

    packed = stage["pack"](spark, masked, folder)
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in row(masked)})


def test_the_whole_run_and_an_empty_table(spark, tables, tmp_path):
    folder, rows, _ = tables
    out = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in out.collect()}
    assert 0 in ids and 200 not in ids and 1 not in ids
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_bound_arrow_batches(spark):
    key, most = session.BATCH[0], int(session.BATCH[1])
    before = spark.conf.getAll.get(key)
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 4000) AS text", "'en' AS lang", "'s' AS source", "20000L AS n_chars")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])

    try:
        for name, stage in corpus_pipeline.STAGES[:1]:
            spark.conf.unset(key)
            kept = stage(spark, docs, "")
            assert kept.count() == 400, name
            told = docs.select("text").mapInArrow(sizes, "bytes long, rows long").collect()
            assert sum(r["rows"] for r in told) == 400
            assert max(r["bytes"] for r in told) < most + 2 * 20_000, name
        spark.conf.set(key, "5m")  # an application's own bound stays
        session.bound_batches(spark)
        assert spark.conf.get(key) == "5m"
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
