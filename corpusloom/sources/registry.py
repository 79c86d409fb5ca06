"""Connectors by kind: what a source's configuration must hold, and whether it may be scheduled."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Field:
    """What a value must be: its type, allowed values, bounds (of a number, or of a list's or text's length), a pattern that is found in
    a text, what a list's items must be, and an object's fields."""

    of: type
    required: bool = False
    choices: tuple = ()
    least: float | None = None
    most: float | None = None
    pattern: str = ""
    items: Field | None = None
    fields: dict[str, Field] = field(default_factory=dict)
    #: whether an object may have other names, as with headers
    others: bool = False

    def problems(self, value: Any, path: str = "") -> Iterator[str]:
        """One line for each leaf that is wrong."""
        name = path or "config"
        if not isinstance(value, self.of) or self.of in (int, float) and isinstance(value, bool):
            yield f"{name}: not a {self.of.__name__}"
            return
        if self.choices and value not in self.choices:
            yield f"{name}: not one of {', '.join(map(str, self.choices))}"
        size = value if isinstance(value, int | float) and not isinstance(value, bool) else len(value) if isinstance(value, str | list) else None
        if size is not None and self.least is not None and size < self.least:
            yield f"{name}: under {self.least:g}"
        if size is not None and self.most is not None and size > self.most:
            yield f"{name}: over {self.most:g}"
        if self.pattern and isinstance(value, str) and not re.search(self.pattern, value):
            yield f"{name}: does not match {self.pattern}"
        if self.items and isinstance(value, list):
            for k, item in enumerate(value):
                yield from self.items.problems(item, f"{path}[{k}]")
        if isinstance(value, dict) and (self.fields or not self.others):
            for k in value:
                if k in self.fields:
                    yield from self.fields[k].problems(value[k], f"{path}.{k}".lstrip("."))
                elif not self.others:
                    yield f"{path}.{k}: unknown".lstrip(".")
            for k, f in self.fields.items():
                if f.required and k not in value:
                    yield f"{path}.{k}: missing".lstrip(".")


@dataclass(frozen=True)
class Connector:
    kind: str
    fields: dict[str, Field]
    scheduled: bool = True


_kinds: dict[str, Connector] = {}


def register(connector: Connector) -> None:
    """A kind may be registered once."""
    if connector.kind in _kinds:
        raise ValueError(f"{connector.kind} is registered already")
    _kinds[connector.kind] = connector


def lookup(kind: str) -> Connector:
    if kind not in _kinds:
        raise KeyError(f"no connector of kind {kind!r}")
    return _kinds[kind]


def kinds() -> list[str]:
    return sorted(_kinds)


def problems(kind: str, config: Any) -> list[str]:
    """What is wrong with a configuration, sorted; nothing if it is right."""
    return sorted(Field(dict, fields=lookup(kind).fields).problems(config))


_URL = Field(str, True, pattern="^https?://")
_TEXTS = Field(list, items=Field(str, least=1))
_AUTH = Field(
    dict,
    fields={"type": Field(str, True, ("api_key_header", "bearer", "basic", "oauth2_cc")), "header": Field(str, least=1), "token_url": Field(str, pattern="^https://"), "scopes": _TEXTS},
)
_PAGING = Field(
    dict,
    fields={"kind": Field(str, True, ("none", "page", "offset", "cursor", "link")), "parameter": Field(str), "size_parameter": Field(str), "size": Field(int, least=1), "start": Field(int, least=0), "cursor_path": Field(str)},
)
_MAPPING = Field(dict, others=True, fields={"endpoint": Field(str, True, least=1)})
_ENDPOINT = Field(dict, fields={"url": _URL, "paging": _PAGING, "items_path": Field(str), "mapping": _MAPPING})

register(Connector("upload", {}, scheduled=False))
register(
    Connector(
        "web_crawl",
        {"seeds": Field(list, True, least=1, items=_URL), "allow_prefixes": _TEXTS, "deny": _TEXTS, "max_depth": Field(int, least=0, most=10), "max_pages": Field(int, least=1), "include": _TEXTS, "exclude": _TEXTS},
    )
)
register(Connector("sitemap", {"url": _URL, "include": _TEXTS, "exclude": _TEXTS}))
register(Connector("api", {"endpoints": Field(list, True, least=1, items=_ENDPOINT), "auth": _AUTH, "headers": Field(dict, others=True)}))
