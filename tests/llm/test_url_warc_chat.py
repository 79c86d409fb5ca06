import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import chat, urlfilter, warc

URLS = ["http://a.net/x", "https://WWW.Example.NET/en/1?b=2#c", "http://example.net/en", "https://example.com/de/1", "https://notexample.com/de/1", "x://b.org/fr/", "x://b.org/FR/", "http://net", "net/", "", None, "http://", "a://b?c/d", "a://b#c?d/e", "http://net:80/", "HTTP://ÉX.net/?", "q://h/p//x?y#z", "://net/", "http://u@a.net/1", "http://a.b/" + "x" * 50_000, "a://" + "b." * 20_000 + "net/"]
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def parts(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    path = rest[at:]
    end = min([k for k in map(path.find, "?#") if k >= 0], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), path[:end]


def fitting(host, path):
    fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fit, key=len, default=None)


def test_hosts_paths_and_rules_against_brute_force(spark):
    df = spark.createDataFrame([(k, u, "v", "s") for k, u in enumerate(URLS * 2)] + [(None, URLS[0], "v", "s")], "page_id long, url string, host string, suffix string")
    rows = urlfilter.judge(df).collect()
    assert len(rows) == 2 * len(URLS) + 1
    for r in rows:
        url = URLS[(r["page_id"] or 0) % len(URLS)]
        host, path = parts(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, fitting(host, path))
        if r["rule"]:
            assert r["verdict"] == RULES[r["rule"]]
        assert r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1
    assert urlfilter.judge(df.limit(0)).count() == 0
    assert urlfilter.judge(df, rules=()).where("verdict = 'allow' and rule is null").count() == len(rows)


def test_features_against_plain_python(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(u,) for u in URLS[:-2]], "url string")
    host, path = urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))
    for r in df.select("url", *urlfilter.features(F.col("url"), host, path)).collect():
        u = r["url"] or ""
        n = len(u)
        assert r["url_length"] == n and r["depth"] == parts(u)[1].count("/")
        assert r["digit_ratio"] == pytest.approx(sum(c in "0123456789" for c in u) / max(n, 1))
        assert r["entropy"] == pytest.approx(-sum(u.count(c) / n * np.log2(u.count(c) / n) for c in set(u)) if u else 0.0, abs=1e-9)
        query = u.split("?")[-1].split("#")[0] if "?" in u else ""
        assert r["parameters"] == (len(query.replace(";", "&").split("&")) if query else 0)


def pages_of(spark, draw, junk, others):
    """URLs of 40 sites under four rules and of 20 under none; a URL under a rule whose name starts with ``junk`` is long, deep and
    full of digits, and so are half of those under none."""
    rules = tuple(urlfilter.rule("block" if d.startswith("bads") else "allow", f"{d}/") for d in ("bads-one.test", "bads-two.test", "news-one.test", "news-two.test"))
    rows = []
    for k in range(2400):
        domain = draw.choice(["bads-one.test", "bads-two.test", "news-one.test", "news-two.test", *others])
        odd = domain.startswith(junk) if domain not in others else draw.random() < 0.5
        tail = "/".join(str(draw.randrange(10**6)) for _ in range(5)) + f"?id={draw.randrange(10**9)}&ref={draw.randrange(10**6)}" if odd else "story-" + draw.choice(["of-the-day", "one", "today"])
        rows.append((k, f"http://w{draw.randrange(10)}.{domain}/{tail}", odd))
    return rules, rows, spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")


def test_the_registered_path_has_skill_on_urls_that_no_rule_covers(spark):
    draw = random.Random(2)
    rules, rows, pages = pages_of(spark, draw, "bads", ["blog-one.test", "blog-two.test"])
    odd = {k: o for k, _, o in rows}
    got = [(r["verdict"] == "block", odd[r["page_id"]]) for r in urlfilter.judge(pages, rules).where("rule is null").collect()]
    assert np.mean([v == o for v, o in got]) > 0.95 and 0.3 < np.mean([v for v, _ in got]) < 0.7


def test_what_rules_do_not_teach_is_allowed(spark):
    """The same URLs where they are odd under one rule that blocks and one that allows: trees fit the rules, but not new ones."""
    rules, rows, pages = pages_of(spark, random.Random(3), ("bads-one", "news-one"), ["blog-one.test"])
    verdicts = {r["verdict"] for r in urlfilter.judge(pages, rules).where("rule is null").collect()}
    assert verdicts == {"allow"}


def test_area_and_threshold_against_brute_force():
    draw = random.Random(4)
    for _ in range(60):
        n = draw.randint(1, 60)
        s, y = np.array([draw.randrange(12) / 11 for _ in range(n)]), np.array([draw.randrange(2) for _ in range(n)], float)
        pairs = [(a > b) + (a == b) / 2 for a, i in zip(s, y, strict=True) if i for b, j in zip(s, y, strict=True) if not j]
        assert urlfilter.area(s, y) == pytest.approx(np.mean(pairs) if pairs else 0.5)
        least = urlfilter.least_score(s, y, 0.3)
        if least < np.inf:
            assert least >= 0.5 and y[s >= least].mean() >= 0.3
    assert urlfilter.least_score(np.zeros(0), np.zeros(0)) == np.inf


def test_the_held_out_measure_of_noise_is_even():
    draw = np.random.default_rng(5)
    found, passed = [], 0
    for _ in range(20):
        n = 400
        x, y, fold = draw.normal(size=(n, 4)), (draw.random(n) < 0.3).astype(float), draw.integers(0, 4, n)
        fitted = urlfilter.fit(x, y, fold)
        found.append(fitted.area)
        passed += fitted.threshold < np.inf
    assert abs(np.mean(found) - 0.5) < 0.03 and passed <= 1
    # a signal under folds of very different base rates
    y = np.repeat([1.0, 0.0, 1.0, 0.0], 100)
    fold = np.repeat([0, 0, 1, 1], 100)
    y[:5], y[100:190], y[200:290] = 0, 1, 0
    x = (y + draw.normal(size=400) * 0.2)[:, None]
    assert urlfilter.fit(x, y, fold).area > 0.97


def test_trees_decide_what_no_rule_covers_in_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = urlfilter.judge(pages).where("rule is null").groupBy("verdict").agg({"score": "min", "page_id": "count"}).collect()
    told = {r["verdict"]: r for r in rows}
    assert set(told) == {"allow", "block"} and min(r["count(page_id)"] for r in rows) >= 50


def test_trees_learn_and_hold_out(spark):
    draw = random.Random(0)
    rows = [(f"http://{draw.choice(['shop', 'news'])}{k}.example.com/" + ("/".join(str(draw.randrange(10**6)) for _ in range(5)) + "?a=1&b=2" if k % 2 else "story"), k % 2) for k in range(600)]
    labelled = spark.createDataFrame(rows[:400], "url string, label int")
    tested = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows[400:])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(tested, (), labelled).collect()}
    right = [got[k] == ("block" if label else "allow") for k, (_, label) in enumerate(rows[400:])]
    assert np.mean(right) > 0.97


def test_trees_fit_an_exclusive_or():
    draw = np.random.default_rng(0)
    x = draw.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = urlfilter.Boosted().fit(x[:1500], y[:1500])
    assert np.mean((model.predict(x[1500:]) > 0.5) == y[1500:]) > 0.95
    assert len(urlfilter.Boosted().fit(x[:0], y[:0]).predict(x[:0])) == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, digest string, id string")


def test_warc_round_trip(spark):
    draw = random.Random(0)
    rows = [(k, f"http://h/{k}\r\nX: y", "".join(draw.choice("aé\n\r ") for _ in range(draw.choice([0, 1, 4])))) for k in range(300)]
    rows += [(400, None, None), (401, "u", "z" * 3_000_000), (402, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (403, "u", "same"), (403, "u", "same"), (404, "u", "s2"), (405, "u", "s2"), (None, "u", "s2"), (None, "u", "alone")]
    got = sorted(tuple(r) for r in warc.round_trip(pages(spark, rows)).collect() if r["page_id"] is not None)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = top[h or ""]
        if i is not None:
            want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want)
    nulls = {r["record_type"]: r["refers_to"] for r in warc.round_trip(pages(spark, rows)).where("page_id is null").collect()}
    assert nulls == {"revisit": 405, "response": None}
    assert warc.round_trip(pages(spark, [])).count() == 0
    small = warc.round_trip(pages(spark, rows), least=3).where("payload_bytes < 3 and record_type = 'revisit'")
    assert small.count() == 0


def test_a_payload_of_half_the_pages_is_split(spark):
    """With low thresholds, the join that brings back whom a payload refers to deals the hot one out over several tasks."""
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in low}
    rows = [(k, f"u{k}", "the same payload" if k % 2 else f"payload {k} " * 3) for k in range(20_000)]
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        out = warc.planned(pages(spark, rows).repartition(8))
        assert out.where("refers_to is not null").count() == 9_999
        whole = out.select("id", "refers_to")
        whole._jdf.queryExecution().executedPlan().executeCollect()
        assert "skew=true" in whole._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def archive():
    body = b"hello" * 5000
    parts = [warc.record(k, "u", body, warc.base32(hashlib.sha1(body).digest()), refers) for k, refers in ((1, None), (2, 1), (3, None))]
    return parts, body


def test_round_trip_of_clashing_columns(spark):
    rows = [(1, "u", "a", "x", "y", "z"), (2, "u", "a", "x", "y", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, record_type string, refers_to string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None)}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_reader_is_incremental(chunk):
    parts, body = archive()
    data = b"".join(map(warc.member, parts))
    found = list(warc.read(io.BytesIO(data), chunk))
    assert [(w["x-page"], w["warc-type"], p) for w, _, p in found] == [("1", "response", body), ("2", "revisit", None), ("3", "response", body)]
    z = zlib.decompressobj(31)
    assert z.decompress(data) == parts[0] and z.eof  # a member for each record


def test_reader_refuses_damage():
    parts, _ = archive()
    whole = warc.member(parts[0])
    for data in (whole[:-9], whole[:40], b"junk", warc.member(parts[0].replace(b"hellohello", b"hellohallo", 1)), warc.member(parts[0][:-4]), warc.member(parts[0] + b"x"), warc.member(b"WARC/1.1\r\n\r\n"), whole + b"tail"):
        with pytest.raises(warc.WarcError):
            list(warc.read(io.BytesIO(data)))


def turns(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "conv_id long, turn long, role string, text string, place int, h int")


def test_snapshots_collapse_as_brute_force_says(spark):
    draw = random.Random(0)
    rows, whole = [], {}
    for c in range(300):
        n = draw.randint(1, 5)
        told = [("user" if k % 2 == 0 else "assistant", draw.choice(["a", "b", None, ""])) for k in range(n)]
        whole[c] = tuple(told)
        rows += [(c, k, r, t) for k, (r, t) in enumerate(told)]
    draw.shuffle(rows)
    groups = {}
    for c in sorted(whole):
        groups.setdefault(whole[c], []).append(c)
    prefixes = {w[:k] for w in whole.values() for k in range(1, len(w))}
    want = {(v[0], len(w), len(v), "".join(f"<|im_start|>{r}\n{t or ''}<|im_end|>\n" for r, t in w)) for w, v in groups.items() if w not in prefixes}
    assert {tuple(r) for r in chat.collapse(turns(spark, rows)).collect()} == want


def test_odd_conversations(spark):
    """Rows without an id are conversations of one turn: of equal ones one is left, none where it begins or equals a named one."""
    rows = [(1, None, "user", "n"), (1, 0, "user", "n"), (2, 0, "us er", "a<|im_end|>b"), (3, 0, "user", "y"), (3, 0, "user", "y"), (4, 0, "user", "y"), (5, 0, "user", "w " * 100_000)]
    rows += [(None, 0, "user", "x"), (None, 1, None, None), (None, 7, "user", "x"), (None, 0, "user", "y"), (None, 9, "us er", "a<|im_end|>b")]
    found = chat.collapse(turns(spark, rows)).collect()
    got = {r["conv_id"]: r for r in found if r["conv_id"] is not None}
    assert set(got) == {1, 2, 3, 5}
    assert got[3]["n_turns"] == 2 and got[3]["n_copies"] == 1 and got[2]["n_copies"] == 2
    assert got[2]["chat"] == "<|im_start|>us_er\na<im_end>b<|im_end|>\n"
    lone = {(r["n_turns"], r["n_copies"], r["chat"]) for r in found if r["conv_id"] is None}
    assert lone == {(1, 2, "<|im_start|>user\nx<|im_end|>\n"), (1, 1, "<|im_start|>unknown\n<|im_end|>\n")} and len(found) == 6
    assert chat.collapse(turns(spark, [])).count() == 0
