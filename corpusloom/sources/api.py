"""HTTP API source: pages of records by any of five paginations, and the mapping of a record to a document.

The transport is a function, so that a reader's requests can be served by files or a test. ``ApiSource`` is a Spark data
source (format "records_api") whose partitions are the endpoints.
"""

from __future__ import annotations

import base64
import importlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any
from email.utils import parsedate_to_datetime
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIES, LONGEST_WAIT, MOST_PAGES = 5, 60.0, 10_000
#: A response: status, headers in lower case, body.
Response = tuple[int, dict[str, str], bytes]
Transport = Callable[[str], Response]


def at_path(value: Any, path: str) -> Any:
    """The value at a dotted path like ``$.a.b.0``; None where there is none."""
    for part in [p for p in path.removeprefix("$").split(".") if p]:
        if isinstance(value, dict):
            value = value.get(part)
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return None
    return value


class Number(str):
    """A JSON number as it is written."""


def load(body: bytes) -> Any:
    return json.loads(body, parse_int=Number, parse_float=Number)


def text_of(value: Any) -> str:
    """A scalar as text; nothing for null, compact JSON for the rest."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@dataclass(frozen=True)
class Paging:
    """kind: none, page, offset, cursor or link; the names of its parameters; where the next cursor stands."""

    kind: str = "none"
    parameter: str = "page"
    size_parameter: str = "limit"
    size: int = 0
    start: int = 1
    cursor_path: str = ""


def with_parameters(url: str, **values: Any) -> str:
    u = urlsplit(url)
    kept = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k not in values]
    return urlunsplit(u._replace(query=urlencode([*kept, *values.items()])))


def fetch(url: str, transport: Transport, sleep: Callable[[float], None] = time.sleep) -> Response:
    """A response; 429 and 503 are tried again after what Retry-After says, at most a minute, five times."""
    for attempt in range(RETRIES + 1):
        status, headers, body = transport(url)
        if status not in (429, 503) or attempt == RETRIES:
            break
        sleep(min(wait_of(headers.get("retry-after", ""), 2.0**attempt), LONGEST_WAIT))
    if status >= 400:
        raise OSError(f"{url}: status {status}")
    return status, headers, body


def wait_of(header: str, default: float, now: float | None = None) -> float:
    """Seconds that a Retry-After header asks for: a number, or the time until a date; else the default."""
    if header.replace(".", "", 1).isdigit():
        return float(header)
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - (time.time() if now is None else now))
    except ValueError:
        return default


#: Sends a request with headers, and a form if one is given.
Send = Callable[[str, dict[str, str], dict[str, str] | None], Response]


def authorised(send: Send, auth: dict | None, credentials: dict[str, str], clock: Callable[[], float] = time.time) -> Transport:
    """A transport that puts the credentials of a source's ``auth`` on each request: a key in a header, a bearer token, a name and a
    password, or a client's token, which is fetched when the last one ends. A credential that is missing is an error at once."""
    kind = (auth or {}).get("type", "none")
    needed = {"none": (), "api_key_header": ("api_key",), "bearer": ("token",), "basic": ("username", "password"), "oauth2_cc": ("client_id", "client_secret")}
    if kind not in needed:
        raise ValueError(f"no authorisation of type {kind!r}")
    if missing := [c for c in needed[kind] if not credentials.get(c) and not (c == "password" and c in credentials)]:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    if kind == "oauth2_cc" and not auth.get("token_url"):
        raise ValueError("oauth2_cc needs token_url")
    held = {"token": "", "until": 0.0}

    def client_token() -> str:
        if clock() >= held["until"]:
            form = {"grant_type": "client_credentials", "client_id": credentials["client_id"], "client_secret": credentials["client_secret"]}
            if auth.get("scopes"):
                form["scope"] = " ".join(auth["scopes"])
            status, _, body = send(auth["token_url"], {}, form)
            if status >= 400:
                raise OSError(f"no token: status {status}")
            told = json.loads(body)
            held.update(token=told["access_token"], until=clock() + float(told.get("expires_in", 3600)) - 10)
        return held["token"]

    def headers() -> dict[str, str]:
        if kind == "api_key_header":
            return {auth.get("header") or "X-API-Key": credentials["api_key"]}
        if kind == "basic":
            return {"Authorization": "Basic " + base64.b64encode(f"{credentials['username']}:{credentials['password']}".encode()).decode()}
        token = credentials["token"] if kind == "bearer" else client_token() if kind == "oauth2_cc" else ""
        return {"Authorization": f"Bearer {token}"} if token else {}

    return lambda url: send(url, headers(), None)


def next_link(header: str) -> str | None:
    """The address of a Link header whose rel holds next."""
    for m in re.finditer(r"<([^>]*)>([^<]*)", header or ""):
        rel = re.search(r'rel\s*=\s*"?([^";,]*)', m[2], re.I)
        if rel and "next" in rel[1].lower().split():
            return m[1]
    return None


def pages(url: str, paging: Paging, items_path: str, transport: Transport, sleep: Callable[[float], None] = time.sleep) -> Iterator[list[Any]]:
    """The items of each page until one is empty, short, the last by its cursor or link, or one that was there before. More than
    ``MOST_PAGES`` pages are an error."""
    kind = paging.kind
    position: Any = paging.start if kind == "page" else 0
    now, seen = url, set()
    for _ in range(MOST_PAGES):
        if kind in ("page", "offset") or kind == "cursor" and position:
            now = with_parameters(url, **{paging.parameter: position})
        if kind in ("page", "offset", "cursor") and paging.size:
            now = with_parameters(now, **{paging.size_parameter: paging.size})
        if now in seen:
            return
        seen.add(now)
        _, headers, body = fetch(now, transport, sleep)
        value = load(body)
        items = at_path(value, items_path)
        if not isinstance(items, list):
            raise ValueError(f"{items_path!r} is not a list")
        if items:
            yield items
        if kind == "none" or not items and kind != "link" or kind in ("page", "offset") and paging.size and len(items) < paging.size:
            return
        if kind == "page":
            position += 1
        elif kind == "offset":
            position += len(items)
        elif kind == "cursor":
            position = text_of(at_path(value, paging.cursor_path))
            if not position:
                return
        else:
            link = next_link(headers.get("link", ""))
            if not link:
                return
            now = urljoin(now, link)
            if urlsplit(now)[:2] != urlsplit(url)[:2]:
                raise ValueError("a page links to another host")
    raise ValueError(f"more than {MOST_PAGES} pages")  # else a cut result would pass for a whole one


#: Layouts of a record's times: fixed values; numbers are seconds since 1970.
TIMES = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d")


def when(text: str) -> datetime | None:
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return datetime.fromtimestamp(float(text), UTC)
    try:
        return _utc(datetime.fromisoformat(text))
    except ValueError:
        pass
    for layout in TIMES:
        try:
            return _utc(datetime.strptime(text, layout))
        except ValueError:
            continue
    return None


def _utc(t: datetime) -> datetime:
    return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)


_SLOT = re.compile(r"\{\{\s*(?:(\w+)\s+)?([.$][\w.]*|\.)\s*((?:\"[^\"]*\"|[.$][\w.]*)?)\s*\}\}")


def render(template: str, item: Any) -> str:
    """A template with slots ``{{.path}}``, ``{{money .price .currency}}``, ``{{date .at "%Y"}}`` and ``{{join .tags ", "}}``."""

    def fill(m: re.Match) -> str:
        function, path, extra = m[1], m[2], m[3]
        value = at_path(item, path.lstrip("$"))
        argument = extra[1:-1] if extra.startswith('"') else text_of(at_path(item, extra)) if extra else ""
        if function == "money":
            return f"{float(text_of(value) or 0):.2f} {argument}".strip()
        if function == "date":
            t = when(text_of(value))
            return t.strftime(argument or "%Y-%m-%dT%H:%M:%SZ") if t else ""
        if function == "join":
            return argument.join(map(text_of, value)) if isinstance(value, list) else text_of(value)
        if function:
            raise ValueError(f"no template function {function!r}")
        return text_of(value)

    return _SLOT.sub(fill, template)


@dataclass(frozen=True)
class Mapping:
    """How a record becomes a document."""

    endpoint: str
    id_path: str = ""
    title_path: str = ""
    body: str = ""
    uri: str = ""
    updated_path: str = ""
    metadata: dict[str, str] = field(default_factory=dict)


def document(item: Any, number: int, m: Mapping) -> dict[str, Any]:
    """external_id (the endpoint and the record's id, or its number), title, uri, body (the template, or the record), metadata
    and updated, as it is written."""
    key = text_of(at_path(item, m.id_path)) if m.id_path else ""
    return {
        "external_id": f"{m.endpoint}/{key or number}",
        "title": text_of(at_path(item, m.title_path)) if m.title_path else "",
        "uri": render(m.uri, item) if m.uri else "",
        "body": render(m.body, item) if m.body else json.dumps(item, ensure_ascii=False, sort_keys=True),
        "metadata": {k: text_of(at_path(item, p)) for k, p in m.metadata.items()},
        "updated": text_of(at_path(item, m.updated_path)) if m.updated_path else "",
    }


def newest(cursor: str | None, updates: list[str]) -> str | None:
    """The latest of the times, as it is written: what the next run starts from, to be saved once the endpoint is through."""
    known = [(t, u) for u in [*updates, cursor or ""] if u and (t := when(u))]
    return max(known, key=lambda x: x[0])[1] if known else cursor


class _Endpoint(InputPartition):
    def __init__(self, config: dict) -> None:
        self.config = config


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.endpoints = json.loads(options["endpoints"])
        self.transport = options["transport"]
        self.auth, self.credentials = (json.loads(options.get(k) or "null") for k in ("auth", "credentials"))

    def partitions(self) -> list[_Endpoint]:
        return [_Endpoint(e) for e in self.endpoints]

    def read(self, partition: _Endpoint) -> Iterator[tuple]:
        module, _, name = self.transport.partition(":")
        transport = getattr(importlib.import_module(module), name)
        if self.auth:
            transport = authorised(transport, self.auth, self.credentials or {})
        e = partition.config
        mapping = Mapping(**e["mapping"])
        number = 0
        for items in pages(e["url"], Paging(**e.get("paging", {})), e.get("items_path", "$"), transport):
            for item in items:
                number += 1
                d = document(item, number, mapping)
                yield d["external_id"], d["title"], d["uri"], d["body"], d["metadata"], d["updated"], mapping.endpoint


class ApiSource(DataSource):
    """Options: endpoints, a JSON list of {url, paging, items_path, mapping}, and transport, ``module:function`` of a URL; with auth and
    credentials (JSON objects) of a URL, headers and a form."""

    @classmethod
    def name(cls) -> str:
        return "records_api"

    def schema(self) -> str:
        return "external_id string, title string, uri string, body string, metadata map<string,string>, updated string, endpoint string"

    def reader(self, schema: Any) -> _Reader:
        return _Reader(dict(self.options))
