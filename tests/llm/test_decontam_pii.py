import hashlib
import random
import re

import numpy as np
import pytest

from corpusloom.llm import decontam, pii


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_scores_against_brute_force():
    draw = random.Random(0)
    for _ in range(200):
        a, b = ([draw.randrange(4) for _ in range(draw.randint(0, 15))] for _ in range(2))
        score, start, stop, covered = decontam.align(np.array(a), np.array(b))
        assert score == smith_waterman(a, b)
        assert 0 <= start <= stop <= len(a) and covered <= len(b)


def words(draw, n):
    return [f"{draw.choice('bcdfgh')}{draw.choice('aeiou')}{draw.choice('lmnrst')}{draw.randrange(60)}" for _ in range(n)]


def brute_leaks(docs, items):
    """(document, item, score) of what counts, by a full table over the whole text and the whole item."""
    out = set()
    for d, text in enumerate(docs):
        a = decontam.words_of(text)
        for k, item in items:
            b = decontam.words_of(item)
            h = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]  # score, and minus the start in b
            ends = []
            for i in range(1, len(a) + 1):
                for j in range(1, len(b) + 1):
                    steps = [(h[i - 1][j - 1], 2 if a[i - 1] == b[j - 1] else -1), (h[i - 1][j], -1), (h[i][j - 1], -1)]
                    h[i][j] = max([(s + x, start) for (s, start), x in steps] + [(0, j)])
                    ends.append((h[i][j][0], j - h[i][j][1]))
            score = max([s for s, _ in ends], default=0)
            whole = len(b) < 4 and any(a[i : i + len(b)] == b for i in range(len(a)))
            if b and score and (score >= len(b) if len(b) > 3 else whole) or any(s == score and c >= 24 and s >= 1.6 * c for s, c in ends):
                out.add((d, k, round(score / (2 * len(b)), 6)))
    return out


@pytest.mark.parametrize("bits", [27, 6])
def test_the_whole_query_against_brute_force(spark, docs_of, monkeypatch, bits):
    """Edits of all kinds and amounts around the threshold, few words (so that pairs repeat), shared passages, copies; also with a
    bitmap that lets nearly everything pass and with shuffled joins instead of broadcasts."""
    monkeypatch.setattr(decontam, "BITS_MOST", bits)
    monkeypatch.setattr(decontam, "BITS_LEAST", 6)
    monkeypatch.setattr(decontam, "ASKED", 1_000_000 if bits > 6 else 0)
    draw = random.Random(7)
    few = words(draw, 25)
    items = [(k, " ".join(words(draw, n))) for k, n in enumerate([4, 6, 9, 14, 20, 33, 60])]
    items += [(10, " ".join(draw.choice(few) for _ in range(30))), (11, "yes sir"), (12, "alone"), (13, "a b a b a b a b"), (14, "A, b! a b a c"), (15, None), (15, " ?! ")]
    docs = []
    for k in range(90):
        passage = decontam.words_of(items[k % 11][1])
        if k % 3:
            every = draw.choice([2, 3, 4, 6, 10])
            for at in range(draw.randrange(every), len(passage), every):
                passage[at : at + 1] = draw.choice([["new"], ["new", "two"], [], [passage[at]] * 2]) if at < len(passage) else []
        if k % 5 == 0:
            passage = passage[: len(passage) // 2]
        docs.append(" ".join([draw.choice(few) for _ in range(draw.randrange(12))] + passage + words(draw, draw.randrange(8))))
    docs += [docs[0], docs[0], None, "", "a b a b a b", "Yes, sir alone", "yes no sir"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], round(r["score"], 6)) for r in decontam.leaks(docs_of(docs), benchmark).collect()}
    want = brute_leaks(docs, items)
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert got == want
    kept = decontam.without_leaks(docs_of(docs), benchmark).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(range(len(docs))) - {d for d, _, _ in want})


def test_ids_of_one_name(spark, docs_of):
    benchmark = spark.createDataFrame([("x", "one two three four five", 1)], "doc_id string, text string, t int")
    docs = docs_of(["well one two three four five", None]).withColumnRenamed("lang", "t")
    got = decontam.leaks(docs, benchmark, item_id="doc_id")
    assert got.columns[:2] == ["doc_id", "item_id"] and [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(0, "x")]


def test_planted_passages_are_found_and_clean_documents_are_not(spark, docs_of):
    draw = random.Random(1)
    items = [words(draw, draw.randint(8, 60)) for _ in range(20)]
    docs, planted = [], {}
    for k in range(200):
        text = words(draw, draw.randint(0, 200))
        if k % 4 == 0:
            item = draw.randrange(20)
            passage = list(items[item])
            if k % 8 == 0:  # edited: about every eighth word changed, dropped or doubled
                for at in range(draw.randrange(4, 8), len(passage), 9):
                    if at < len(passage):
                        passage[at : at + 1] = draw.choice([["new"], [], [passage[at]] * 2])
            at = draw.randint(0, len(text))
            text[at:at] = [w.upper() + draw.choice(["", ",", "."]) for w in passage]
            planted[k] = item
        docs.append(" ".join(text))
    docs += [None, "", "too short", " ".join(items[3]) + " filler" * 50_000]
    planted[203] = 3
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (None, "of no id at all")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs_of(docs), benchmark).collect()}
    assert got == set(planted.items())
    clean = decontam.without_leaks(docs_of(docs).withColumnRenamed("source", "score"), benchmark)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(docs))) - set(planted)
    assert clean.columns == ["doc_id", "text", "lang", "score", "n_chars"]


def test_a_passage_that_most_documents_share_is_found_in_all(spark, docs_of):
    draw = random.Random(2)
    passage = " ".join(words(draw, 30))
    docs = docs_of([f"{' '.join(words(draw, 20))} {passage}" for _ in range(150)] + ["nothing of it"])
    benchmark = spark.createDataFrame([(0, passage)], "item_id long, text string")
    assert decontam.leaks(docs, benchmark).count() == 150


def test_short_long_and_repeated_items_and_empty_tables(spark, docs_of):
    draw = random.Random(3)
    long = words(draw, 2000)
    benchmark = spark.createDataFrame([(1, "yes sir"), (2, " ".join(long)), (2, " ".join(long)), (3, None)], "item_id long, text string")
    docs = docs_of(["well yes, SIR now", " ".join(words(draw, 50) + long[700:1100]), "yes no sir"])
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, benchmark).collect()} == {(0, 1), (1, 2)}
    assert decontam.leaks(docs_of([]), benchmark).count() == 0
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontam.without_leaks(docs, benchmark.limit(0)).count() == 3


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(s[::-1])) % 10 == 0


def brute(t):
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15],
    }


@pytest.mark.parametrize("alphabet", ["a@.-1 ", "12.3 ", "+1 (2)-.5", "0123456789 -", "ab@1.+ -0é"])
def test_base_spans_against_plain_patterns(alphabet):
    draw = random.Random(alphabet)
    for _ in range(5000):
        t = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 45)))
        assert pii.base(t) == brute(t)


def test_wider_patterns_propose_and_check():
    found = {
        "see 2001:db8::ff00:42:8329 now": ("ip", 4, 26), "at fe80:0:0:0:1:2:3:4,": ("ip", 3, 21), "amex 3782 822463 10005 ok": ("card", 5, 22), "diners 30569309025904": ("card", 7, 21),
        "call 1-555-123-4567": ("phone", 5, 19), "tel 0049 (555) 123-4567": ("phone", 4, 23),
    }
    for text, span in found.items():
        assert span in pii.candidates(text, pii.base(text)), text
        votes, _ = pii.labelled(text, *span, False)
        assert votes[2] in (1, -1), text
    for text in ("std::vector of a::b", "at 12:30:45 and 10::", "id 12345678901234567890"):
        assert all(pii.labelled(text, *c, False)[0][2] == 0 for c in pii.candidates(text, pii.base(text)) if c not in [("card", *s) for s in pii.base(text)["card"]]), text


def test_searches_are_linear():
    for t in ("a:" * 200_000, "::" * 200_000, "1:" * 200_000 + ":", "a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "a at b dot " * 40_000, "a@" * 200_000):
        pii.spans(t, np.zeros(pii.FEATURES))


TEXTS = ["mail a.b@c.example.org, é +1 (555) 123-4567.", "ip 10.0.0.255 and 10.0.0.256", "card 4539 1488 0343 6467 ok", "cards 4539148803436467 4539148803436467", "reach jo [at] site [dot] com now", None, "", "no such thing", "token = 1234567812345678", "call +1 (826) 555-4081 190.137.2.44 now"]


def test_rows_against_brute_force(spark, docs_of):
    got = {r["doc_id"]: r for r in pii.find(docs_of(TEXTS).withColumnRenamed("lang", "spans")).collect()}
    for k, t in enumerate(TEXTS):
        base = brute(t or "")
        plain = [f"{kind}:{a}:{b}" for kind in pii.KINDS for a, b in base[kind]]
        r = got[k]
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [len(base[kind]) for kind in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(plain).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert set(plain) <= set(every)
        assert every == sorted(every, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
    assert got[7]["spans"] == "" and got[8]["spans"] == ""
    assert got[3]["spans"] == "card:6:22,card:23:39"  # 32 digits fail the rule; the method tells the two apart


def test_reliabilities_follow_agreement():
    """The noisy labeler is found out by those that agree."""
    draw = np.random.default_rng(0)
    truth = draw.random(4000) < 0.4
    votes = np.stack([np.where(draw.random(4000) < p, truth, ~truth) for p in (0.95, 0.9, 0.9, 0.85, 0.5, 0.9)], 1).astype(int)
    kinds, n = np.unique(votes, axis=0, return_counts=True)
    posterior = pii.reliabilities([("ip", tuple(v), c) for v, c in zip(kinds.tolist(), n.tolist(), strict=True)])
    right = np.mean([(posterior["ip", tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)])
    assert right > 0.97


def test_masking_leaves_the_rest_alone(spark, docs_of):
    docs = docs_of(TEXTS).withColumnRenamed("source", "spans")
    got = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert got[0]["text"] == "mail [EMAIL], é [PHONE]." and got[0]["n_chars"] == len(got[0]["text"])
    assert got[3]["text"] == "cards [CARD] [CARD]"
    for k in (5, 6, 7, 8):
        assert got[k]["text"] == TEXTS[k]
    assert pii.mask(docs).columns == docs.columns
    assert not any(any(brute(r["text"] or "").values()) for r in got.values())
    assert pii.mask(docs_of([])).count() == 0 and pii.find(docs_of([])).count() == 0


def test_a_shared_half_of_an_item_is_found_however_many_share_it(spark, docs_of):
    """Half an item in many documents, the rest in none: each of its pairs is far more frequent than the item's median."""
    draw = random.Random(4)
    item = words(draw, 59)
    docs = docs_of([f"{' '.join(words(draw, 20))} {' '.join(item[:30])} {' '.join(words(draw, 5))}" for _ in range(60)] + ["nothing of it"])
    benchmark = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert decontam.leaks(docs, benchmark).count() == 60
    assert [r["doc_id"] for r in decontam.without_leaks(docs, benchmark).collect()] == [60]


@pytest.mark.parametrize("every", [3, 4])
def test_copies_with_every_third_or_fourth_word_edited(spark, docs_of, every):
    draw = random.Random(every)
    item = words(draw, 59)
    docs = []
    for k in range(every):
        copy = ["new" if at % every == k else w for at, w in enumerate(item)]
        docs.append(" ".join(words(draw, 30) + copy + words(draw, 30)))
    benchmark = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    want = [k for k, t in enumerate(docs) if smith_waterman(decontam.words_of(t), item) >= len(item)]
    assert len(want) >= every - 1
    assert sorted(r["doc_id"] for r in decontam.leaks(docs_of(docs), benchmark).collect()) == want


def test_seeds_lose_nothing_that_the_alignment_of_whole_texts_counts():
    draw = random.Random(5)
    items = [(k, tuple(words(draw, n))) for k, n in enumerate([4, 5, 6, 8, 11, 15, 20, 30, 45, 60, 120])]
    met = [0, 0]
    for _ in range(1500):
        _, item = draw.choice(items)
        rate, text = draw.choice([0.1, 0.2, 0.3, 0.4, 0.6, 1.0]), []
        kinds = draw.choice([["put"], ["drop"], ["swap"], ["put", "drop", "swap"]])
        start = draw.randrange(len(item))
        for w in item[start:] if draw.random() < 0.3 else item:
            kind = draw.choice(kinds) if draw.random() < rate else ""
            text += {"put": [w, "new"], "drop": [], "swap": ["new"], "": [w]}[kind]
        around = [draw.choice(draw.choice(items)[1]) for _ in range(60)]
        text = around[:30] + text + around[30:]
        want = set()
        for key, own in items:
            number = {w: n for n, w in enumerate(dict.fromkeys(own))}
            a, b = (np.array([number.get(w, -1) for w in t]) for t in (text, own))
            score, _, _, covered = decontam.align(a, b)
            if score >= len(own) or covered >= 24 and score >= 1.6 * covered:
                want.add(key)
        got = {key for key, own in items if decontam.passage(text, list(own))}
        assert got == want
        met[bool(want)] += 1
    assert min(met) > 100


@pytest.mark.parametrize("n", [256, 257, 300, 600])
def test_short_runs_anywhere_in_a_long_item(spark, docs_of, n):
    draw = random.Random(n)
    item = words(draw, n)
    docs = docs_of([" ".join(words(draw, 10) + item[k : k + 24] + words(draw, 10)) for k in range(n - 23)])
    benchmark = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert decontam.leaks(docs, benchmark).select("doc_id").distinct().count() == n - 23


def test_kept_hashes_are_few_and_short():
    hashes = decontam.Hashes()
    words = [f"w{k}" for k in range(decontam.KEPT + 50)]
    long = "x" * (decontam.KEPT_CHARS + 1)
    first = hashes.of([long, *words])
    assert len(hashes) == decontam.KEPT and long not in hashes
    assert (hashes.of([long, *words]) == first).all()
    assert (decontam.Hashes().of(words[::-1])[::-1] == first[1:]).all()
