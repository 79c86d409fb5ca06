"""Crawl sources: robots rules, links, sitemaps and the breadth-first frontier, over a table of fetched pages."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.urls import normalise, normalise_udf
from corpusloom.operators.blocks import Node, squeeze, tree

MAX_DEPTH, MAX_PAGES = 3, 1000
SITEMAP_DEPTH, SITEMAP_FILES, SITEMAP_URLS, SITEMAP_BYTES = 5, 200, 50_000, 20 << 20


@dataclass(frozen=True)
class Sitemaps:
    """pages (url, lastmod), files that could not be read (url, error), and whether a bound has left something out."""

    pages: DataFrame
    errors: DataFrame
    cut: bool


LINKS = T.StructType([T.StructField("title", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))])


def robots(text: str, agent: str) -> list[tuple[str, bool]]:
    """(path, allowed) rules of the group whose name is the longest prefix of the agent, else of `*`."""
    groups: dict[str, list[tuple[str, bool]]] = {}
    names: list[str] = []
    fresh = True
    for raw in text.splitlines():
        key, colon, value = raw.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            names = [*names, value.lower()] if fresh else [value.lower()]
            fresh = True
        elif key in ("allow", "disallow"):
            fresh = False
            if value or key == "allow":
                for name in names or ["*"]:
                    groups.setdefault(name, []).append((value, key == "allow"))
    own = max((g for g in groups if g != "*" and agent.lower().startswith(g)), key=len, default="*")
    return groups.get(own, [])


def may_fetch(rules: list[tuple[str, bool]], path: str) -> bool:
    """The longest rule that begins the path decides; of equal ones allow; without any it is allowed."""
    return max(((len(p), ok) for p, ok in rules if (path or "/").startswith(p)), default=(0, True))[1]


def robots_allowed(pages: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """``pages`` with allowed, by a table of rules (host, prefix, allow): the longest prefix of a page's path decides, of equal ones
    allow, without any it is allowed. Rows stay as they are, repeated ones too.

    The rules of a host are one row, so a host of any number of pages is a join without a sum over them. A robots file is read up to a
    size cap, which bounds that row."""
    from corpusloom.sources.shared import stored

    of = stored(rules.groupBy("host").agg(F.collect_set(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("_rules")), "robots")
    hits = F.filter("_rules", lambda r: F.startswith(F.col(path), r["prefix"]))
    told = pages.join(of, "host", "left").withColumn("allowed", F.coalesce(F.array_max(hits)["allow"], F.lit(True)))
    return told.select(*[F.col(f"`{c}`") for c in pages.columns], "allowed")


def _all(n: Node, tag: str) -> Iterator[Node]:
    for c in n.elements():
        if c.tag == tag:
            yield c
        yield from _all(c, tag)


def page_links(url: str, html: str | None, terminated: bool = False) -> dict:
    """Title (of title, og:title, the first h1), canonical URL and normalised links of a page, each once, in order. ``terminated`` as for
    ``tree``."""
    doc = tree(html or "", terminated)
    base = next((b.attrs.get("href") for b in _all(doc, "base") if b.attrs.get("href")), "")
    root = urljoin(url or "", base)
    join = lambda href: _joined(root, href)
    title = next((t for n in _all(doc, "title") if (t := squeeze(n.text()))), "")
    og = next((t for n in _all(doc, "meta") if n.attrs.get("property", "").lower() == "og:title" and (t := squeeze(n.attrs.get("content", "")))), "")
    h1 = next((t for n in _all(doc, "h1") if (t := squeeze(n.text()))), "")
    canonical = next((join(n.attrs["href"]) for n in _all(doc, "link") if "canonical" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href")), None)
    links = [u for n in _all(doc, "a") if "href" in n.attrs and (u := join(n.attrs["href"]))]
    return {"title": title or og or h1, "canonical": canonical, "links": list(dict.fromkeys(links))}


def _joined(root: str, href: str) -> str | None:
    try:
        return normalise(urljoin(root, href.strip()))
    except ValueError:
        return None


@F.pandas_udf(LINKS)
def links_udf(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_links(u, h) for u, h in zip(url, html, strict=True)], columns=LINKS.names)


@F.pandas_udf(LINKS)
def terminated_links_udf(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    """``links_udf`` with character references as ``tree`` decodes them with ``terminated``."""
    return pd.DataFrame([page_links(u, h, True) for u, h in zip(url, html, strict=True)], columns=LINKS.names)


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES) -> tuple[DataFrame, bool]:
    """(url, depth) of pages reached from the seeds along links (url, link), level by level, and whether the cap cut it.

    A level is a join of the frontier with the links, less what was visited; of a level that passes the cap the first pages
    by URL are taken. A depth of 0 means the default. Each level is a stored table, so none computes those before it again.
    """
    from corpusloom.sources.shared import stored

    depth, truncated = 0, False
    visited = stored(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "seeds")
    total = visited.count()
    frontier = visited
    while depth < (max_depth or MAX_DEPTH) and not truncated:
        depth += 1
        found = stored(frontier.join(edges, "url").select(F.col("link").alias("url")).distinct().join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)), "level")
        n = found.count()
        if not n:
            break
        truncated = total + n > max_pages
        frontier = found.orderBy("url").limit(max_pages - total) if truncated else found
        total += n
        visited = visited.union(frontier)
    return visited, truncated


def scheduled(frontier: DataFrame, delays: DataFrame | None = None, delay_ms: int = 1000, host: str = "host", order: tuple[str, ...] = ("url",), most: int | None = None, lanes: int = 64) -> DataFrame:
    """``frontier`` with turn, at_ms and lane: each host's fetches in the order of ``order`` (which tells its rows apart), its delay
    apart, all hosts from 0 on, so that sorting by at_ms interleaves them. A host is in one lane, so tasks that fetch lanes in the order
    of at_ms keep the delays without speaking to each other. ``delays`` (host, delay_ms) has those that robots files ask for;
    ``most`` keeps that many fetches, the earliest.

    A host may have any number of rows: turns are counted within ranges of (host, order), of which a large host has many, and the
    counts of its ranges before are added. Null hosts are one host."""
    from corpusloom.sources.shared import stored

    key = F.coalesce(F.col(host), F.lit(""))
    spread = frontier.withColumn("_host", key).repartitionByRange("_host", *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(spread, "frontier")
    counts = stored(ranged.groupBy("_host", "_part").agg(F.count("*").alias("_n")), "turns")
    # a host has a row for each of its ranges here
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_host").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_host", "_part", before.alias("_base"))
    within = F.row_number().over(Window.partitionBy("_host", "_part").orderBy(*order)) - 1
    rows = ranged.withColumn("_within", within).join(bases, ["_host", "_part"]).withColumn("turn", (F.col("_base") + F.col("_within")).cast("long"))
    if delays is not None:
        rows = rows.join(delays.select(F.coalesce(host, F.lit("")).alias("_host"), F.col("delay_ms").alias("_delay")), "_host", "left")
    else:
        rows = rows.withColumn("_delay", F.lit(None).cast("long"))
    rows = rows.withColumn("at_ms", F.col("turn") * F.greatest(F.coalesce("_delay", F.lit(delay_ms)), F.lit(0)).cast("long")).withColumn("lane", F.pmod(F.xxhash64("_host"), F.lit(lanes)).cast("int"))
    if most is not None:
        rows = rows.orderBy("at_ms", "_host", *order).limit(most)
    return rows.select(*[F.col(f"`{c}`") for c in frontier.columns], "turn", "at_ms", "lane")


def fetch_decision(incremental: bool, most_bytes: int | None = None) -> Column:
    """What a crawl does with a page: its columns are robots_ok, in_scope, lastmod, last_fetched_at, status, body_hash and
    known_hash. With ``most_bytes``, also bytes, which is one more than it for a body that was cut there."""
    fresh = F.lit(incremental) & F.col("lastmod").isNotNull() & F.col("last_fetched_at").isNotNull() & (F.col("lastmod") <= F.col("last_fetched_at"))
    return (
        F.when(~F.col("in_scope"), "out of scope").when(fresh, "not modified since").when(~F.col("robots_ok"), "robots").when(F.col("status") == 304, "unchanged")
        .when(F.lit(False) if most_bytes is None else F.col("bytes") > most_bytes, "too large").when(F.col("status") >= 400, "failed").when(F.col("body_hash").eqNullSafe(F.col("known_hash")) & F.col("body_hash").isNotNull(), "unchanged").otherwise("changed")
    )


def canonical_once(pages: DataFrame, canonical: str = "canonical", url: str = "url", depth: str = "depth") -> DataFrame:
    """One page for each canonical address: the shallowest, then the first by URL."""
    key = F.coalesce(canonical, url)
    from corpusloom.operators.ingest import latest_once

    return latest_once(pages.withColumn("external_id", key), ["external_id"], F.col(depth), F.col(url))


#: Layouts of a lastmod, each with the zone that a text of that layout is read in if it names none: fixed values.
LAYOUTS = (("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX", ""), ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX", "Z"), ("yyyy-MM-dd'T'HH:mmXXX", ""), ("yyyy-MM-dd'T'HH:mmXXX", "Z"), ("yyyy-MM-ddXXX", "Z"))


def lastmod(text: Column) -> Column:
    """The time of a sitemap's lastmod, null if it is none; without a zone it is UTC, whatever the session's."""
    return F.coalesce(*[F.try_to_timestamp(F.concat(F.trim(text), F.lit(zone)), F.lit(layout)) for layout, zone in LAYOUTS])


def unpacked(data: bytes, most: int = SITEMAP_BYTES) -> bytes:
    """A body without gzip, if it has any; one that would be longer than ``most``, or is damaged, is an error before it is held."""
    if data[:2] == b"\x1f\x8b":
        reader = zlib.decompressobj(31)
        data = reader.decompress(data, most + 1)
        if len(data) <= most and not reader.eof:
            raise ValueError("a damaged gzip stream")
    if len(data) > most:
        raise ValueError("larger than the size cap")
    return data


def sitemap(data: bytes) -> tuple[list[str], list[tuple[str, str | None]]]:
    """(children, urls with lastmod) of a sitemap or index, which may be gzipped. A DTD is refused, so no entity expands."""
    data = unpacked(data)
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError("a sitemap must not declare entities")
    root = ET.fromstring(data)
    name = lambda e: e.tag.rpartition("}")[2]
    rows = []
    for entry in root:
        values = {name(c): (c.text or "").strip() for c in entry}
        if values.get("loc"):
            rows.append((values["loc"], values.get("lastmod") or None))
    return ([loc for loc, _ in rows], []) if name(root) == "sitemapindex" else ([], rows)


def sitemap_entries(files: DataFrame) -> DataFrame:
    """file, child, place, loc (normalised) and lastmod (as written) of each entry of sitemap files (url, body), and for a file that
    cannot be read one row with its error. Files are read in tasks, one after the other; entries without a usable URL are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    if not body.is_valid:
                        raise ValueError("not fetched")
                    children, urls = sitemap(body.as_py())
                    found = [(bool(children), k, u, when, None) for k, (loc, when) in enumerate([(c, None) for c in children] or urls) if (u := normalise(loc))]
                except (ValueError, ET.ParseError, zlib.error) as e:
                    found = [(None, 0, None, None, str(e))]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_pylist([{"file": url, "child": c, "place": k, "loc": u, "lastmod": w, "error": e} for c, k, u, w, e in part], schema)

    schema = pa.schema([("file", pa.string()), ("child", pa.bool_()), ("place", pa.int64()), ("loc", pa.string()), ("lastmod", pa.string()), ("error", pa.string())])
    return files.select("url", "body").mapInArrow(run, "file string, child boolean, place long, loc string, lastmod string, error string")


def sitemap_urls(roots: DataFrame, fetched: Callable[[DataFrame], DataFrame], depth: int = SITEMAP_DEPTH, files: int | None = SITEMAP_FILES, urls: int | None = SITEMAP_URLS) -> Sitemaps:
    """What the sitemaps ``roots`` (url) and the indexes' files below them list, level by level, each file once.

    ``fetched`` gives (url, body) for a level's (url): a join with a table of bodies, or a function of tasks that fetches; a URL
    without a row or with a null body counts as an error. Of a page that several files list, the entry of the shallowest one stands, then
    of the first by URL, then the first in it. Bounds, None for none: index levels below the roots, files in all (a level that passes
    it is read in the order of URLs up to it) and pages (in the order of level, file and place); ``cut`` tells whether any has left
    something out. Only counts reach the driver. Null and unusable roots are ignored; without any the result is empty.
    """
    from corpusloom.sources.shared import stored

    spark, cut, level = roots.sparkSession, False, 0
    wanted = stored(roots.select(normalise_udf("url").alias("url")).where("url is not null").distinct(), "sitemaps")
    seen, total = None, 0
    entries = spark.createDataFrame([], "file string, child boolean, place long, loc string, lastmod string, error string, level int")
    while n := wanted.count():
        if level > depth or (files is not None and total + n > files):
            cut = True
            if level > depth or total >= files:
                break
            wanted = stored(wanted.orderBy("url").limit(files - total), "sitemaps")
        got = wanted.join(fetched(wanted).select("url", "body"), "url", "left")
        own = stored(sitemap_entries(got).withColumn("level", F.lit(level)), "sitemap-entries")
        entries = own if not level else entries.union(own)
        seen = wanted if seen is None else seen.union(wanted)
        total, level = total + n, level + 1
        if cut:
            break
        wanted = stored(own.where("child").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"), "sitemaps")
    place = F.struct("level", "file", "place")
    once = entries.where("not child").groupBy(F.col("loc").alias("url")).agg(F.min_by(F.struct(place.alias("at"), "lastmod"), place).alias("e"))
    found = once.select("url", lastmod(F.col("e.lastmod")).alias("lastmod"), F.col("e.at").alias("at"))
    if urls is not None:
        found = stored(found, "sitemap-urls")
        if found.count() > urls:
            cut, found = True, found.orderBy("at").limit(urls)
    return Sitemaps(found.select("url", "lastmod"), entries.where("error is not null").select(F.col("file").alias("url"), "error"), cut)


def pages_merged(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """The crawl-page table after a run: new validators where there are any, else the old ones."""
    from corpusloom.operators.ingest import merged

    return merged(stored, fetched, ["url"], ["etag", "last_modified", "body_hash", "last_fetched_at"])


_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")


def _step(text: str) -> tuple[str, list[str], list[str]]:
    m = _SELECTOR.fullmatch(text)
    if not m or not text:
        raise ValueError(f"not a selector: {text!r}")
    parts = re.findall(r"([.#])([\w-]+)", m[2])
    return (m[1] or "*").lower(), [v for k, v in parts if k == "."], [v for k, v in parts if k == "#"]


def _is(n: Node, step: tuple[str, list[str], list[str]]) -> bool:
    tag, classes, ids = step
    return (tag == "*" or n.tag == tag) and set(classes) <= set(n.attrs.get("class", "").split()) and all(n.attrs.get("id") == i for i in ids)


def selected(root: Node, selectors: list[str]) -> list[Node]:
    """Top-most elements that any selector (tag, .class, #id and descendants of these) matches; bad ones are ignored."""
    chains = []
    for s in selectors:
        for one in s.split(","):
            try:
                chains.append([_step(p) for p in one.split()])
            except ValueError:
                continue
    chains = [c for c in chains if c]
    out: list[Node] = []

    def fits(path: list[Node], chain: list) -> bool:
        if not _is(path[-1], chain[-1]):
            return False
        at = len(chain) - 2
        for n in reversed(path[:-1]):
            if at >= 0 and _is(n, chain[at]):
                at -= 1
        return at < 0

    def visit(n: Node, path: list[Node]) -> None:
        for c in n.elements():
            own = [*path, c]
            if any(fits(own, chain) for chain in chains):
                out.append(c)
            else:
                visit(c, own)

    visit(root, [])
    return out


def selected_html(html: str, include: list[str], exclude: list[str]) -> Node:
    """A page without the excluded elements, and of the rest only the included ones if any match."""
    doc = tree(html)
    gone = {id(n) for n in selected(doc, exclude)}

    def prune(n: Node) -> None:
        n.children = [c for c in n.children if id(c) not in gone]
        for c in n.elements():
            prune(c)

    prune(doc)
    kept = selected(doc, include) if include else []
    if kept:
        body = Node("body")
        body.children = list(kept)
        html_node = Node("html")
        html_node.children = [*([t] if (t := doc.find("title")) is not None else []), body]
        root = Node("#document")
        root.children = [html_node]
        return root
    return doc
