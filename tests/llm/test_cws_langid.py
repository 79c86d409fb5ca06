import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import cws, langid


def jaccard(a, b):
    def bag(t):
        w = t.lower().split()
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    top = sum((x | y).values())
    return sum((x & y).values()) / top if top else 1.0


def prose(draw, n):
    return " ".join(draw.choice(["la", "de", "mi", "so", "Fa", "re\n", "ti", "do"]) for _ in range(n))


def test_rows_against_brute_force(spark, docs_of):
    draw = random.Random(0)
    texts = [prose(draw, draw.choice([0, 1, 3, 5, 40, 300])) for _ in range(60)] + [None, "", "x" * 50_000, prose(draw, 20_000)]
    ids = draw.sample(range(10_000), len(texts))
    rows = sorted(zip(ids, texts, strict=True))
    got = {r["doc_id"]: r for r in cws.fingerprint(docs_of([(i, t, None) for i, t in zip(ids, texts, strict=True)]), samples=256).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - jaccard(t, edited)) < 0.2
        assert abs(r["near_next"] - jaccard(t, after)) < 0.2
        for text, print_ in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            key = " ".join(text.lower().split())
            assert by_text.setdefault(key, print_) == print_


def test_one_row_repeated_ids_null_ids_and_no_rows(spark, docs_of):
    alone = cws.fingerprint(docs_of([(7, "one two three four five six seven eight", None)])).first()
    assert alone["near_next"] == 1.0 and alone["doc_id"] == 7
    rows = [(1, "a b c d e f g h", None)] * 3 + [(1, "other words", None), (None, "z", None), (None, None, None), (2, "", None)]
    assert cws.fingerprint(docs_of(rows).withColumnRenamed("lang", "part").withColumnRenamed("source", "place")).count() == 7
    assert cws.fingerprint(docs_of([])).count() == 0


def test_each_range_has_a_partition_of_its_own(spark, docs_of):
    docs = docs_of([(k * k, "x", None) for k in range(500)])
    parts = cws.with_next(docs, "doc_id", "text", 7)
    own = parts.where("place = 0").select("part", F.spark_partition_id().alias("p")).groupBy("part").agg(F.countDistinct("p").alias("p"), F.count("*").alias("n"), F.min("p").alias("at")).collect()
    assert len(own) == 7 and {r["p"] for r in own} == {1} and len({r["at"] for r in own}) == 7
    assert parts.where("place = 1").count() == 7


def test_too_many_languages_are_an_error(spark, docs_of, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    texts = [(k, "word", f"l{k}") for k in range(5)]
    assert langid.fit(docs_of(texts[:3])).langs == ["l0", "l1", "l2"]
    with pytest.raises(ValueError):
        langid.fit(docs_of(texts))


def test_collision_rate_is_the_generalised_jaccard_similarity():
    draw = np.random.default_rng(0)
    sampler = cws.Sampler(8000)
    for _ in range(6):
        h = np.unique(draw.integers(0, 1 << 63, 60, dtype=np.uint64))
        a, b = (draw.integers(1, 9, len(h)).astype(float) for _ in range(2))
        rate = np.mean(sampler.sample(h, a)[0] == sampler.sample(h, b)[0])
        assert abs(rate - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


WORDS = {"aa": "alba arra anda asta alma", "ee": "eche erre ende este elle", "oo": "ocho orro ondo osto ollo"}


def spoken(draw, lang, n):
    return " ".join(draw.choice(WORDS[lang].split()) for _ in range(n))


def brute_profile(texts):
    c = Counter()
    for t in texts:
        for w in t.lower().split():
            q = f" {w} "
            c.update(g for n in (1, 2, 3) for k in range(len(q) - n + 1) if (g := q[k : k + n]) != " ")
    code = lambda g: sum(ord(x) << 21 * (len(g) - 1 - k) for k, x in enumerate(g))
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))][:300]


def test_predictions_against_brute_force(spark, docs_of):
    draw = random.Random(1)
    rows = [(k, spoken(draw, lang, draw.randint(1, 30)), lang) for k, lang in enumerate(draw.choices(sorted(WORDS), k=120))]
    held = {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    profiles = {lang: brute_profile([t for k, t, c in rows if c == lang and k not in held]) for lang in WORDS}
    got = {r["doc_id"]: r for r in langid.identify(docs_of(rows)).collect()}
    for k, t, lang in rows:
        own = brute_profile([t])
        distance = {c: sum(min(abs(p.index(g) - at), 300) if g in p else 300 for at, g in enumerate(own)) for c, p in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        assert got[k]["lang_pred"] == best
        assert got[k]["score"] == pytest.approx(1 - distance[best] / (300 * len(own)))
        assert got[k]["held_out"] == (k in held)
    right = [got[k]["lang_pred"] == lang for k, _, lang in rows if k in held]
    assert sum(right) >= 0.95 * len(right)


def test_undetermined_texts_and_nothing_to_learn_from(spark, docs_of):
    rows = [(0, None, "aa"), (1, "", "aa"), (2, "12 %% ² _", None), (4, "alba anda", "aa"), (5, "alba " * 40_000, "aa"), (None, "alba", "aa")]
    docs = docs_of(rows).withColumnRenamed("source", "score")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    assert [got[k][0] for k in (0, 1, 2, 4, 5, None)] == ["und", "und", "und", "aa", "aa", "aa"]
    assert got[2][1] == 0.0
    unlabelled = langid.identify(docs_of([(4, "alba", None)])).first()
    assert unlabelled["lang_pred"] == "und"
    assert langid.identify(docs_of([])).count() == 0


def test_accuracy_on_held_out_documents(spark):
    from corpusloom.sources.tables import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()


def test_a_table_without_languages_keeps_its_texts(spark, docs_of):
    import corpus_pipeline

    docs = docs_of([(0, "alba anda", None), (1, "12 %% ² _", None), (2, None, None), (3, "", None)])
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [0]


def test_the_language_stage_rejects_by_its_profiles(spark, docs_of):
    import random

    import corpus_pipeline

    draw = random.Random(3)
    words = {"la": "alba arbor aqua terra stella silva luna casa via porta".split(), "ru": "дом река лес поле небо звезда вода гора трава снег".split()}
    text = lambda k: " ".join(draw.choice(words[k]) for _ in range(30))
    latin = [(k, text("la"), "la") for k in range(300)] + [(300, "alba", None), (301, "Luna 7", "la")]
    odd = [(400, "中文的句子没有空格", None), (401, text("ru"), None), (402, "qqzx " * 30, None), (403, "12 %%", "la"), (404, None, "la"), (405, "", "la")]
    kept = lambda rows: {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs_of(rows), "").collect()}
    assert kept(latin + odd) == set(range(302))
    # once the language is learned its texts stay
    assert kept([*latin, *odd, *((500 + k, text("ru"), "ru") for k in range(20))]) == {*range(302), 401, *range(500, 520)}
    assert kept([]) == set()


def test_the_least_score_counts_all_rows_but_a_share(spark, docs_of):
    profiles = langid.fit(docs_of([(k, "alba arbor aqua terra", "la") for k in range(5)]))
    near, far = profiles.predict("alba arbor aqua terra")[1], profiles.predict("alba arbor xyz qqq")[1]
    rows = [(k, "alba arbor aqua terra", "la") for k in range(999)] + [(1000, "alba arbor xyz qqq", "la"), (1001, "12", "la"), (1002, "zz", None), (1003, None, "la")]
    assert langid.least_score(docs_of(rows), profiles) == int(near * 1000) / 2000
    assert langid.least_score(docs_of(rows), profiles, share=0.0) == int(far * 1000) / 2000
    assert langid.least_score(docs_of(rows[:0]), profiles) == 0.0
