import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators.blocks import canonical
from corpusloom.sources import api, files, registry, web


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://Bakery.TEST:80/Rye/Loaf?weight=750&crust=dark#oven", "http://bakery.test/Rye/Loaf?crust=dark&weight=750"),
        ("https://bakery.test?utm_campaign=easter&loaf=12&utm_term=rye", "https://bakery.test/?loaf=12"),
        ("https://bakery.test:443/seeds?FBCLID=q7", "https://bakery.test/seeds"),
        ("http://bakery.test:8443/", "http://bakery.test:8443/"),
        ("tel:+4930123", None),
        ("http://", None),
        ("http://h:bad/", None),
        (None, None),
    ],
)
def test_normalised_urls(spark, raw, want):
    assert urls.normalise(raw) == want
    if raw and "bad" not in raw:
        assert spark.createDataFrame([(raw,)], "u string").select(urls.plain_normalised(F.col("u"))).first()[0] == want


ROBOTS = "User-agent: *\nDisallow: /oven\nAllow: /oven/hours\n\nUser-agent: loom\nUser-agent: mill\nDisallow: /flour # note\nDisallow:\n"


@pytest.mark.parametrize(
    ("agent", "path", "allowed"),
    [("bot", "/oven/3", False), ("bot", "/oven/hours/may", True), ("bot", "", True), ("LoomBot", "/oven", True), ("loom", "/flour/x", False), ("mill/1", "/flour", False)],
)
def test_robots(agent, path, allowed):
    assert web.may_fetch(web.robots(ROBOTS, agent), path) is allowed


def test_robots_ties_and_empty_files():
    assert web.may_fetch(web.robots("", "a"), "/x")
    assert web.may_fetch(web.robots("Disallow: /a\nAllow: /a", "a"), "/a")


def test_links():
    page = '<title> </title><meta property="og:title" content="OG"><link rel="canonical" href="/c?utm_x=1"><a href="b#1">x</a><a href="/a">y</a><a href="b">z</a><a href="mailto:q">m</a><a href="http://[bad">n</a>'
    got = web.page_links("http://h/dir/p", page)
    assert got == {"title": "OG", "canonical": "http://h/c", "links": ["http://h/dir/b", "http://h/a"]}


def test_references_without_a_semicolon():
    page = "<title>a&amp;b &amp c&copy;d &nosuch;&amp</title><a href='/x&amp'>x</a>"
    assert web.page_links("http://h/", page)["title"] == "a&b & c©d &nosuch;&"
    assert web.page_links("http://h/", page, True)["title"] == "a&b &amp c©d &nosuch;&amp"


def test_registered_links_keep_a_cut_reference(spark, tmp_path):
    from corpusloom.plans.textual import html_link_extract

    page = '<html><head><title>Tea &amp; les&amp</title></head><body><a href="/a">x</a></body></html>'
    spark.createDataFrame([(1, "http://h.test/p", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r["title"] for r in html_link_extract(spark, str(tmp_path)).collect()] == ["Tea & les&amp"]


def test_crawl_levels_and_cap(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "e"), ("c", "a"), ("e", "f")], "url string, link string")
    seeds = spark.createDataFrame([("a",)], "url string")
    found, cut = web.crawl(edges, seeds, 3)
    assert {r["url"]: r["depth"] for r in found.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3} and not cut
    found, cut = web.crawl(edges, seeds, 3, max_pages=2)
    assert {r["url"] for r in found.collect()} == {"a", "b"} and cut


NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def index_of(*urls):
    return f"<sitemapindex {NS}>{''.join(f'<sitemap><loc>{u}</loc></sitemap>' for u in urls)}</sitemapindex>".encode()


def urlset_of(*urls):
    return f"<urlset {NS}>{''.join(f'<url><loc>{u}</loc>' + (f'<lastmod>{t}</lastmod>' if t else '') + '</url>' for u, t in urls)}</urlset>".encode()


def listed(spark, tree, roots=("http://h/root",), **bounds):
    """(pages, files with errors, cut) of a tree of files by URL."""
    files = spark.createDataFrame([(u, None if b is None else bytearray(b)) for u, b in tree.items()], "url string, body binary")
    got = web.sitemap_urls(spark.createDataFrame([(r,) for r in roots], "url string"), lambda wanted: wanted.join(files, "url"), **bounds)
    pages = {r["url"]: r["lastmod"] and r["lastmod"].day for r in got.pages.collect()}
    return pages, {r["url"] for r in got.errors.collect()}, got.cut


def test_sitemaps(spark):
    tree = {
        "http://h/root": index_of("http://h/s1", " HTTP://H/s2#x ", "http://h/root", "http://h/gone", "junk", "http://h/bad", "http://h/dtd", "http://h/cut"),
        "http://h/s1": urlset_of((" http://h/a?utm_x=1&amp;b=2 ", "2024-01-02T12:00:00Z"), ("http://h/b", ""), ("ftp://h/c", "")),
        "http://h/s2": gzip.compress(urlset_of(("http://h/c", "2024-01-05T12:00"), ("http://h/a?b=2", "2024-01-09T12:00Z"), ("http://h/c", "2024-01-06T12:00Z"))),
        "http://h/bad": b"<urlset>",
        "http://h/dtd": b'<!DOCTYPE x [<!ENTITY a "b">]><urlset/>',
        "http://h/cut": gzip.compress(urlset_of(("http://h/d", "")))[:-12],
    }
    pages, errors, cut = listed(spark, tree, ("http://h/root", None, "no url", "http://h/root"))
    assert pages == {"http://h/a?b=2": 2, "http://h/b": None, "http://h/c": 5} and not cut
    assert errors == {"http://h/gone", "http://h/bad", "http://h/dtd", "http://h/cut"}
    assert listed(spark, tree, ()) == ({}, set(), False)
    with pytest.raises(ValueError):
        web.unpacked(gzip.compress(bytes(1000)), 999)


def test_of_files_the_shallowest_names_a_page(spark):
    tree = {"http://h/root": index_of("http://h/a", "http://h/z"), "http://h/a": index_of("http://h/deep"), "http://h/deep": urlset_of(("http://h/p", "2024-01-03T12:00Z")), "http://h/z": urlset_of(("http://h/p", "2024-01-04T12:00Z"))}
    assert listed(spark, tree)[0] == {"http://h/p": 4}


def test_lastmod(spark):
    times = ["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.25+02:00", "2024-01-02T03:04:05", "2024-01-02T03:04+01:00", " 2024-01-02T03:04 ", "junk", "2024-01-02+01:00", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, s string")
    want = [1704153600000, 1704164645000, 1704157445250, 1704164645000, 1704161040000, 1704164640000, None, None, None, None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert [r[0] for r in df.orderBy("k").select(F.unix_millis(web.lastmod(F.col("s")))).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_robots_of_hosts_and_repeated_rows(spark):
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a", True), ("h", "/b", False), ("h", "", True), ("g", "/", False)], "host string, prefix string, allow boolean")
    pages = spark.createDataFrame([("h", "/a", 1), ("h", "/b/x", 1), ("h", "/b/x", 1), ("h", "/c", 1), ("g", "/", 1), ("x", "/b", 1), (None, "/b", 1), ("g", None, 1)], "host string, path string, prefix int")
    got = [(r["host"], r["path"], r["allowed"]) for r in web.robots_allowed(pages, rules).collect()]
    want = [("h", "/a", True), ("h", "/b/x", False), ("h", "/b/x", False), ("h", "/c", True), ("g", "/", False), ("x", "/b", True), (None, "/b", True), ("g", None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_selectors():
    html = '<title>T</title><body><div id=x class="a b"><p class=c>in</p></div><div class=c>out</div><section><p class=c>deep</p></section></body>'
    from corpusloom.operators.blocks import _blocks

    def text(include, exclude):
        root = web.selected_html(html, include, exclude)
        return canonical(list(_blocks(root.find("body"), True)))

    assert text(["#x"], []) == "in"
    assert text([".a .c", "section"], []) == "in\n\ndeep"
    assert text([], ["div.c", "p["]) == "in\n\ndeep"
    assert text(["nothing"], []) == "in\n\nout\n\ndeep"


ITEMS = [{"id": k, "slug": f"p-{k}"} for k in range(7)]


def transport(url):
    """An endpoint with all five paginations."""
    from urllib.parse import parse_qs, urlsplit

    u = urlsplit(url)
    q = {k: v[0] for k, v in parse_qs(u.query).items()}
    if u.path == "/none":
        return 200, {}, json.dumps(ITEMS).encode()
    if u.path == "/page":
        at = 3 * (int(q["page"]) - 1)
        return 200, {}, json.dumps({"data": {"items": ITEMS[at : at + 3]}}).encode()
    if u.path == "/offset":
        at = int(q["offset"])
        return 200, {}, json.dumps(ITEMS[at : at + 3]).encode()
    if u.path == "/cursor":
        at = int(q.get("after", 0))
        return 200, {}, json.dumps({"items": ITEMS[at : at + 3], "next": at + 3 if at + 3 < 7 else None}).encode()
    at = int(q.get("at", 0))
    return 200, {"link": f'<https://h/link?at={at + 3}>; rel="next"' if at + 3 < 7 else ""}, json.dumps(ITEMS[at : at + 3]).encode()


@pytest.mark.parametrize(
    ("path", "paging", "items"),
    [
        ("none", api.Paging(), "$"),
        ("page", api.Paging("page", "page", size=3), "$.data.items"),
        ("offset", api.Paging("offset", "offset", size=3), "$"),
        ("cursor", api.Paging("cursor", "after", size=3, cursor_path="next"), "items"),
        ("link", api.Paging("link"), "$"),
    ],
)
def test_paginations(path, paging, items):
    got = [i for page in api.pages(f"https://h/{path}", paging, items, transport) for i in page]
    assert [i["slug"] for i in got] == [i["slug"] for i in ITEMS]


def test_retries_and_errors():
    answers = [(503, {"retry-after": "7"}, b""), (429, {"retry-after": "999"}, b""), (200, {}, b"[]")]
    waits = []
    assert api.fetch("u", lambda _: answers.pop(0), waits.append)[0] == 200
    assert waits == [7.0, 60.0]
    with pytest.raises(OSError):
        api.fetch("u", lambda _: (500, {}, b""))
    with pytest.raises(ValueError):
        list(api.pages("https://h/none", api.Paging(), "$.x", transport))


ITEM = api.load('{"no":7,"code":"rye-07","label":"Rye loaf","grams":750,"cost":4.2,"coin":"EUR","note":"Dark crust.","shelf":{"row":"B"},"baked":"2025-05-06T04:30:00Z","seeds":["flax","poppy"]}'.encode())


def test_mapping():
    m = api.Mapping("loaves", "code", "label", "## {{.label}} ({{.grams}} g)\n{{money .cost .coin}}\n\n{{.note}}", "https://bakery.test/{{.code}}", "baked", {"row": "$.shelf.row"})
    d = api.document(ITEM, 1, m)
    assert d["external_id"] == "loaves/rye-07" and d["uri"] == "https://bakery.test/rye-07"
    assert d["body"] == "## Rye loaf (750 g)\n4.20 EUR\n\nDark crust."
    assert d["metadata"] == {"row": "B"} and d["updated"] == "2025-05-06T04:30:00Z"
    assert api.render('{{join .seeds "; "}} {{date .baked "%m"}} {{.none}}', ITEM) == "flax; poppy 05 "
    assert api.newest("2025-05-05", ["2025-05-04T22:10:00Z", "2025-05-06T04:30:00Z", "junk"]) == "2025-05-06T04:30:00Z"
    assert api.newest("2025-05-05", []) == "2025-05-05"


def test_too_many_pages_are_an_error_and_not_an_end(monkeypatch):
    monkeypatch.setattr(api, "MOST_PAGES", 2)
    with pytest.raises(ValueError):
        list(api.pages("https://h/page", api.Paging("page", "page", size=3), "$.data.items", transport))


def test_cut_sitemaps_say_so(spark):
    urlset = lambda n: urlset_of(*[(f"http://h/{k}", "") for k in range(n)])
    tree = {"http://h/root": index_of("http://h/s1", "http://h/s2"), "http://h/s1": urlset(3), "http://h/s2": urlset(5)}
    assert listed(spark, tree) == ({f"http://h/{k}": None for k in range(5)}, set(), False)
    assert listed(spark, tree, urls=None, files=None, depth=1)[2] is False
    assert listed(spark, tree, files=3, urls=5)[2] is False
    assert listed(spark, tree, urls=4) == ({f"http://h/{k}": None for k in range(4)}, set(), True)
    assert listed(spark, tree, files=2) == ({f"http://h/{k}": None for k in range(3)}, set(), True)
    assert listed(spark, tree, depth=0) == ({}, set(), True)


def test_data_source(spark):
    spark.dataSource.register(api.ApiSource)
    endpoints = [{"url": f"https://h/{p}", "paging": {"kind": k, **o}, "items_path": "$", "mapping": {"endpoint": p, "id_path": "slug"}} for p, k, o in (("none", "none", {}), ("offset", "offset", {"parameter": "offset", "size": 3}))]
    df = spark.read.format("records_api").option("endpoints", json.dumps(endpoints)).option("transport", "tests.test_web_api:transport").load()
    assert {r["external_id"] for r in df.collect()} == {f"{p}/p-{k}" for p in ("none", "offset") for k in range(7)}


def test_uploads_and_cases(spark, tmp_path):
    (tmp_path / "up").mkdir()
    for name, data in {"a.txt": b"plain", "b.pdf": b"%PDF-1.7", "c.pdf": b"no", "d.exe": b"MZ", "e.md": b"bin\x00", "f.docx": b"PK\x03\x04", "g.txt": b"%PDF-1.4"}.items():
        (tmp_path / "up" / name).write_bytes(data)
    got = {r["external_id"]: r["ok"] for r in files.uploads(spark, str(tmp_path / "up")).collect()}
    assert got == {"a.txt": True, "b.pdf": True, "c.pdf": False, "d.exe": False, "e.md": False, "f.docx": True, "g.txt": False}
    (tmp_path / "c.csv").write_text("tags,question,expected_doc_ids\n x | y ,Q1,d1|d2\n,Q2\n")
    rows = {r["question"]: r for r in files.cases(spark, str(tmp_path / "c.csv")).collect()}
    assert rows["Q1"]["tags"] == ["x", "y"] and rows["Q1"]["expected_doc_ids"] == ["d1", "d2"] and rows["Q2"]["expected_doc_ids"] == []
    (tmp_path / "d.csv").write_text("question,surprise\na,b\n")
    with pytest.raises(ValueError):
        files.cases(spark, str(tmp_path / "d.csv"))


def test_registry():
    assert registry.kinds() == ["api", "sitemap", "upload", "web_crawl"]
    assert registry.problems("web_crawl", {"max_depth": True, "odd": 1}) == ["max_depth: not a int", "odd: unknown", "seeds: missing"]
    assert registry.problems("web_crawl", {"seeds": ["https://a/", "ftp://b/", 3], "max_depth": 11, "max_pages": 0}) == ["max_depth: over 10", "max_pages: under 1", "seeds[1]: does not match ^https?://", "seeds[2]: not a str"]
    right = {"url": "https://a/x", "paging": {"kind": "page", "size": 5}, "mapping": {"endpoint": "x", "id_path": "$.id"}}
    assert registry.problems("api", {"endpoints": [right], "auth": {"type": "bearer"}, "headers": {"a": "b"}}) == []
    wrong = {"url": "https://a/x", "paging": {"kind": "pages", "size": 0}, "mapping": {}}
    assert registry.problems("api", {"endpoints": [wrong], "auth": {"kind": "bearer"}}) == [
        "auth.kind: unknown", "auth.type: missing", "endpoints[0].mapping.endpoint: missing", "endpoints[0].paging.kind: not one of none, page, offset, cursor, link", "endpoints[0].paging.size: under 1",
    ]
    assert registry.problems("api", []) == ["config: not a dict"] and registry.problems("sitemap", {"url": ""}) == ["url: does not match ^https?://"]
    assert not registry.lookup("upload").scheduled
    with pytest.raises(ValueError):
        registry.register(registry.Connector("api", {}))


def test_authorisation():
    sent, now = [], [0.0]

    def send(url, headers, form):
        sent.append((url, headers, form))
        return (200, {}, json.dumps({"access_token": f"t{len(sent)}", "expires_in": 100}).encode()) if form else (200, {}, b"[]")

    api.authorised(send, {"type": "api_key_header"}, {"api_key": "k"})("u")
    api.authorised(send, {"type": "bearer"}, {"token": "b"})("u")
    api.authorised(send, {"type": "basic"}, {"username": "ann", "password": ""})("u")
    api.authorised(send, None, {})("u")
    assert [h for _, h, _ in sent] == [{"X-API-Key": "k"}, {"Authorization": "Bearer b"}, {"Authorization": "Basic YW5uOg=="}, {}]
    client = api.authorised(send, {"type": "oauth2_cc", "token_url": "https://t", "scopes": ["r", "w"]}, {"client_id": "i", "client_secret": "s"}, lambda: now[0])
    for at in (0.0, 50.0, 95.0):
        now[0] = at
        client("u")
    tokens = [h["Authorization"] for u, h, _ in sent[4:] if u == "u"]
    assert tokens[0] == tokens[1] != tokens[2] and sent[4][2]["scope"] == "r w"
    for auth, known in (({"type": "odd"}, {}), ({"type": "bearer"}, {}), ({"type": "oauth2_cc"}, {"client_id": "i", "client_secret": "s"})):
        with pytest.raises(ValueError):
            api.authorised(send, auth, known)


def test_waits():
    assert api.wait_of("7", 1.0) == 7 and api.wait_of("", 1.5) == 1.5 and api.wait_of("soon", 2.0) == 2
    assert api.wait_of("Thu, 01 Jan 1970 00:02:00 GMT", 1.0, 100.0) == 20 and api.wait_of("Thu, 01 Jan 1970 00:00:00 GMT", 1.0, 100.0) == 0


@pytest.mark.parametrize(
    ("address", "blocked"),
    [("8.8.8.8", False), ("10.0.0.1", True), ("127.0.0.1", True), ("169.254.169.254", True), ("::1", True), ("::ffff:192.168.0.1", True), ("fd00::1", True), ("2606:4700::1111", False), ("224.0.0.1", True), ("255.255.255.255", True), ("junk", True), (None, True)],
)
def test_blocked_addresses(address, blocked):
    from corpusloom.functions.net import blocked as found

    assert found(address) is blocked
