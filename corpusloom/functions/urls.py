"""URL normalisation and filters of a crawl."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, quote_plus, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that only track a visit: fixed values, besides all that begin with utm_.
TRACKING = frozenset("gclid fbclid mc_cid mc_eid yclid msclkid igshid _hsenc _hsmi ref_src".split())
PORTS = {"http": 80, "https": 443}


def normalise(raw: str | None) -> str | None:
    """The canonical form of an absolute http(s) URL, null for anything else: scheme and host in lower case, no default port,
    fragment or tracking parameter, parameters by name, `/` for an empty path."""
    try:
        u = urlsplit((raw or "").strip())
        port = u.port
    except ValueError:
        return None
    if u.scheme not in PORTS or not u.netloc:
        return None
    host = u.netloc.lower()
    if port is not None and port == PORTS[u.scheme]:
        host = host[: host.rindex(":")]
    query = ""
    if u.query:
        kept = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in TRACKING]
        query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(kept, key=lambda kv: kv[0]))
    path = quote(u.path, safe="/%:@!$&'()*+,;=~-._") or "/"
    return f"{u.scheme}://{host}{path}" + (f"?{query}" if query else "")


@F.pandas_udf(T.StringType())
def normalise_udf(raw: pd.Series) -> pd.Series:
    """``normalise`` over Arrow batches; for URLs with escapes, which ``plain_normalised`` leaves as they are."""
    return raw.map(normalise, na_action="ignore").astype(object)


def plain_normalised(url: Column) -> Column:
    """``normalise`` by JVM expressions, for URLs whose parameters hold no escapes or repeated names."""
    whole = F.regexp_extract(F.trim(url), r"^([A-Za-z]+)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", 0)
    part = lambda k: F.regexp_extract(F.trim(url), r"^([A-Za-z]+)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", k)
    scheme = F.lower(part(1))
    host = F.lower(part(2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.startswith(name(p), F.lit("utm_")) & ~name(p).isin(*sorted(TRACKING))))
    query = F.array_join(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    out = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when((whole != "") & scheme.isin("http", "https"), out)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1))


def allowed(url: Column, prefixes: list[str], denied: list[str], seeds: list[str] | None = None) -> Column:
    """A URL may be crawled if it begins with an allowed prefix (by default: is on a seed's host) and holds no denied part."""
    ok = F.lit(False)
    for p in prefixes:
        ok |= url.startswith(p)
    if not prefixes:
        ok = host(url).isin(sorted({urlsplit(s).netloc.lower() for s in seeds or []}))
    for d in denied:
        ok &= ~url.contains(d)
    return F.coalesce(ok, F.lit(False))
