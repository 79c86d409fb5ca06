"""Personal data: spans of emails, IP addresses, card numbers and phone numbers.

Base spans follow fixed rules (``base``) and always stand. Method for the rest: weak-supervision aggregation. Wider patterns
propose candidates; regex, gazetteer, checksum and context labelers vote on each (yes, no or nothing); expectation-
maximisation over the counts of vote patterns estimates how reliable each labeler is for each kind, and its posteriors train
the final classifier of spans, a logistic regression on their features. Candidates it accepts are added.

Plan: one scan puts out the votes and features of candidates (a narrow table in the shared folder). The vote patterns are
counted over all documents, by kind and pattern, so at most 4 * 3^6 rows reach the driver; the classifier is fitted on a
bounded sample (``SAMPLE`` candidates, those of smallest hash). A second scan applies it. No text is shuffled, and every search is linear in the
length of a text: no pattern can backtrack over a long run.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import scratch

KINDS = ("email", "ip", "card", "phone")
#: Candidates to fit the classifier on; the probability from which it adds a span.
SAMPLE, ACCEPT = 20_000, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def emails(text: str) -> list[Span]:
    """Each `@` is tried once: what stands before it back to the last match, and the domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        free = end
        at = text.find("@", end)
    return out


def base(text: str) -> dict[str, list[Span]]:
    """Spans by the fixed rules: for each kind leftmost, not overlapping; what a rule's check refuses is dropped."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Wider patterns: every quantifier is bounded or possessive.
_WIDE = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}){1,8}", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|3[068][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{4})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:(?:00[1-9][0-9]{0,2}|1)[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
_HINT = re.compile(r"[\[({ ]at[\])} ]", re.I)


def candidates(text: str, known: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
    """(kind, start, end): the base spans, and what the wider patterns propose outside of them."""
    out = []
    digit = _DIGIT.search(text)
    for kind in KINDS:
        own = known[kind]
        out.extend((kind, a, b) for a, b in own)
        if (digit if kind != "email" else "dot" in text.lower() and _HINT.search(text)) and (kind != "ip" or "::" in text or text.count(":") >= 7):
            taken = sorted(s for spans in known.values() for s in spans)
            starts = [a for a, _ in taken]
            for m in _WIDE[kind].finditer(text):
                a, b = m.span()
                k = int(np.searchsorted(starts, b))
                if not any(a < y for _, y in taken[max(0, k - 4) : k]):
                    out.append((kind, a, b))
    return out


#: Gazetteers: fixed values.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl ch at be eu us ca au jp cn in br ru pl se no dk fi pt cz ie".split())
CUES = {
    "email": frozenset("email e-mail mail contact write reach adresse courriel correo kontakt".split()),
    "ip": frozenset("ip address host server addr adresse dirección login from".split()),
    "card": frozenset("card credit visa mastercard amex payment carte karte tarjeta pay".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell téléphone telefon teléfono".split()),
}
#: The labelers, and the least reliability that estimation may give each: the rules and checksums are known to be sound.
LABELERS = {"base rule": 0.95, "gazetteer": 0.5, "checksum": 0.95, "context": 0.5, "neighbours": 0.5, "length": 0.5}
_WORD = re.compile(r"[\w-]+")


def _is_six(s: str) -> bool:
    """Whether a text is an IPv6 address of more than two groups, so that no `::` alone or at a word's end is one."""
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return len([g for g in s.split(":") if g]) > 2


def labelled(text: str, kind: str, start: int, end: int, is_base: bool) -> tuple[list[int], list[float]]:
    """The labelers' votes on a candidate (1 yes, 0 no, -1 nothing) and its features."""
    s = text[start:end]
    d = _digits(s)
    before, after = text[start - 1 : start], text[end : end + 1]
    near = {w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])}
    cue = bool(near & CUES[kind])
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9]+", s)[-1].lower()
        gazetteer, check, length = int(last in TOP_DOMAINS), -1, int(6 <= len(s) <= 80)
    elif kind == "ip":
        parts = s.split(".")
        gazetteer = int(0 < int(parts[0][-3:]) < 240) if len(parts) == 4 else -1
        check, length = int(len(parts) == 4 or _is_six(s)), int(len(s) <= 39)
    elif kind == "card":
        gazetteer, check, length = int(d[:1] in "3456"), int(luhn(d)), int(13 <= len(d) <= 19)
    else:
        area = re.search(r"\(([0-9]{3})\)", s)
        gazetteer, check, length = (1 if s.startswith(("+", "00")) else int(area[1][0] in "23456789") if area else -1), -1, int(8 <= len(d) <= 15)
    inside = before.isalnum() or after.isalnum() or before in "#=/_\"'" and bool(before) and kind == "card"
    votes = [1 if is_base else 0 if check == 0 else -1, gazetteer, check, 1 if cue else -1, 0 if inside else 1, length]
    numbers = [1.0, len(d) / 16, len(s) / 32, sum(not c.isalnum() for c in s) / 8, float(cue), float(inside), float(gazetteer == 1), float(check == 1), float(s[:1] == "+")]
    return votes, [x if k == kind else 0.0 for k in KINDS for x in numbers]


FEATURES = len(KINDS) * 9


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[str, tuple[int, ...]], float]:
    """The posterior of each (kind, votes), given how often each occurs, from expectation-maximisation of the labelers'
    rates of yes among true and no among false candidates. Priors: four right votes to one wrong, half of candidates true."""
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        votes, n = np.array([v for v, _ in own]), np.array([n for _, n in own], float)
        yes, no = votes == 1, votes == 0
        least = np.array(list(LABELERS.values()))
        hit, rejects, share = np.maximum(least, 0.8), np.maximum(least, 0.8), 0.5
        for _ in range(rounds):
            true = np.log(share) + yes @ np.log(hit) + no @ np.log(1 - hit)
            false = np.log(1 - share) + yes @ np.log(1 - rejects) + no @ np.log(rejects)
            p = 1 / (1 + np.exp(np.clip(false - true, -50, 50)))
            w, u = n * p, n * (1 - p)
            hit = np.clip((w @ yes + 4) / (w @ (yes | no) + 5), least, 0.999)
            rejects = np.clip((u @ no + 4) / (u @ (yes | no) + 5), least, 0.999)
            share = (w.sum() + 1) / (n.sum() + 2)
        out.update({(kind, tuple(v)): float(x) for (v, _), x in zip(own, p, strict=True)})
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, from the candidates in all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0):
                t = t.as_py() or ""
                known = base(t)
                for kind, a, b in candidates(t, known):
                    votes, features = labelled(t, kind, a, b, (a, b) in known[kind])
                    rows.append((kind, votes, features, f"{a}:{t[max(0, a - 20) : b + 20]}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "votes", "features", "place"])

    found = docs.select(F.col(text)).mapInArrow(run, "kind string, votes array<int>, features array<float>, place string")
    found = scratch.stored(found.select("kind", "votes", "features", F.xxhash64("kind", "place").alias("h")), "candidates")
    patterns = [(r["kind"], tuple(r["votes"]), r["n"]) for r in found.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()]
    if not patterns:
        return np.zeros(FEATURES)
    posterior = reliabilities(patterns)
    rows = scratch.smallest(found, sum(n for _, _, n in patterns), sample, "h", "kind", "votes", "features").collect()
    x = np.array([r["features"] for r in rows], float)
    return logistic(x, np.array([posterior[r["kind"], tuple(r["votes"])] for r in rows]))


def spans(text: str | None, weights: np.ndarray) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by kind and start."""
    known = base(text or "")
    out = []
    for kind, a, b in candidates(text or "", known):
        if (a, b) in known[kind] or np.dot(labelled(text, kind, a, b, False)[1], weights) >= np.log(ACCEPT / (1 - ACCEPT)):
            out.append((kind, a, b))
    return known, sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id``, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans, all of them as kind:start:end.

    Offsets are code points, ends exclusive. A null text is empty: no spans. Repeated rows stay; an empty table gives an
    empty result.
    """
    weights = fit(docs, text)
    kind = docs.schema[id].dataType
    schema = T.StructType([T.StructField(id, kind), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                known, every = spans(t.as_py(), weights)
                plain = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in known[k])
                rows.append((*(len(known[k]) for k in KINDS), hashlib.sha256(plain.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in every)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(columns))], names=schema.names)

    return docs.select(F.col(id), F.col(text).alias("text")).mapInArrow(run, schema)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in capitals and brackets; spans that overlap become one."""
    out, done = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with the spans of personal data masked; texts without any stay as they are, nulls too. ``length``, if it is a
    column, is brought up to date where a text has changed. All columns keep their names and order."""
    weights = fit(docs, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(at):
                t = t.as_py()
                out.append(masked(t, every) if t and (every := spans(t, weights)[1]) else t)
            columns = [*batch.columns]
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    clean = docs.mapInArrow(run, docs.schema)
    if length and length in docs.columns:
        kind = docs.schema[length].dataType
        clean = clean.select(*[F.coalesce(F.char_length(text).cast(kind), F.col(c)).alias(c) if c == length else F.col(f"`{c}`") for c in docs.columns])
    return clean
