"""Personal data: weak labelers vote, expectation-maximisation weighs them, a span
classifier decides.

Spans are of four kinds: email, ip, card, phone. The base rules (one expression and
one test for each kind) always count. Further candidates - written-out addresses,
phone numbers without a plus, longer or spaced card numbers, IPv6 addresses - are
kept if the classifier says so.

1. One pass over the whole texts lists base spans and candidates. Four labelers vote
   on each candidate (1 for, -1 against, 0 abstains): strict form, checksum or
   range, gazetteer (domains, issuers, dialling codes, reserved ranges), context (cue
   words in front). The text itself is left behind; what is kept is small.
2. Vote patterns are counted over all documents. From the counts alone - a table of
   bounded size, as votes and shape features have few values - expectation-
   maximisation estimates each labeler's reliability and each kind's share of true
   spans, and a logistic classifier is fitted to the resulting soft labels.
3. The kept candidates are scored and the spans written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, bounded_batches, keep

KINDS = ("email", "ip", "card", "phone")
#: Least probability of a candidate that no base rule found.
ACCEPT = 0.9

# The base rules.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Further candidates.
_AT = re.compile(r"[(\[{] ?(?:at|AT) ?[)\]}]")
_SPELT_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?:(?: ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?|\.)[A-Za-z0-9-]+)+")
_NATIONAL = re.compile(r"(?<![0-9+])(?:00[1-9][0-9 .-]{7,18}[0-9]|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4})(?![0-9])")
_GROUPED = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]{1,3}[0-9]{4}){3}(?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")

# Gazetteers and cue words (fixed values).
_TOP_DOMAINS = frozenset("com net org edu gov info io biz de fr es it nl uk eu us ch at be ca au jp br in ru pl se no fi dk pt".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[4-7]|6011|65|35|62")
_CUES = {
    "email": re.compile(r"mail|contact|write|courriel|correo|schreib|@", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|login|client", re.I),
    "card": re.compile(r"card|visa|master|amex|carte|karte|tarjeta|pay", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|cell|ruf|llam|appel", re.I),
}
_AGAINST = re.compile(r"version|order|invoice|isbn|serial|\bid\b|\bno\.|page|token|sha|figure|section|#", re.I)
_FRONT = 40


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _number(digits: str) -> int:
    """Of a part of an address, of which any length may be zeros; too large ones are 999."""
    digits = digits.lstrip("0")
    return int(digits or "0") if len(digits) <= 3 else 999


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """As a leftmost, non-overlapping search would find them, in linear time: the
    local part is the run of its characters in front of an @ sign."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
        done = match.end() if match else at + 1
        at = text.find("@", done)
    return found


def _spelt(text: str) -> list[tuple[int, int]]:
    """Addresses with a written-out at sign, in linear time as _emails."""
    found, done = [], 0
    for at in _AT.finditer(text):
        if at.start() < done:
            continue
        stop = at.start() - (at.start() > done and text[at.start() - 1] == " ")
        start = stop
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _SPELT_DOMAIN.match(text, at.end()) if start < stop else None
        if match:
            found.append((start, match.end()))
        done = match.end() if match else at.end()
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base rules for each kind, in code points."""
    digits = _DIGIT.search(text) is not None
    ips = [m.span() for m in _IP.finditer(text) if all(_number(p) <= 255 for p in m[0].split("."))] if digits else []
    cards = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)] if digits else []
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return {"email": _emails(text) if "@" in text else [], "ip": ips, "card": cards, "phone": phones}


def _more(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Candidates besides the base spans, none overlapping a base span or another."""
    found = []
    if "(" in text or "[" in text or "{" in text:
        found += [("email", *s) for s in _spelt(text)]
    if _DIGIT.search(text):
        found += [("phone", *m.span()) for m in _NATIONAL.finditer(text)] + [("card", *m.span()) for m in _GROUPED.finditer(text)]
        if ":" in text:
            found += [("ip", *m.span()) for m in _IPV6.finditer(text)]
    taken = sorted(s for spans in base.values() for s in spans)
    out: list[tuple[str, int, int]] = []
    end, i = 0, 0
    for kind, start, stop in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if start >= end and not any(a < stop for a, _ in taken[i : i + 1]):
            out.append((kind, start, stop))
            end = stop
    return out


def votes(kind: str, text: str, start: int, stop: int) -> tuple[int, int, int, int]:
    """Of the labelers for form, checksum or range, gazetteer, context."""
    span = text[start:stop]
    digits, front = _digits(span), text[max(0, start - _FRONT) : start]
    context = 1 if _CUES[kind].search(front) else -1 if _AGAINST.search(front) else 0
    if kind == "email":
        tail = re.split(r"[.\])} ]", span)[-1].lower()
        return (1 if "@" in span else 0), (1 if re.match(r"[A-Za-z0-9]", span) and ".." not in span else -1), (1 if tail in _TOP_DOMAINS else -1), context
    if kind == "ip":
        if ":" in span:
            return 1, 0, 0, context
        parts = [_number(p) for p in span.split(".")]
        return (1 if all(str(_number(p)) == p for p in span.split(".")) else -1), (1 if max(parts) <= 255 else -1), (-1 if parts[0] in (0, 127) or parts[0] >= 224 or max(parts) < 10 else 1), context
    if kind == "card":
        return (1 if len(digits) in (15, 16) else -1), (1 if _luhn(digits) else -1), (1 if _ISSUERS.match(digits) else -1), context
    national = digits[-10:]
    return (1 if span[0] == "+" or span.startswith("00") else 0), (1 if 9 <= len(digits) <= 15 else -1), (1 if len(national) == 10 and national[0] not in "01" else -1), context


def _shape(text: str, start: int, stop: int) -> tuple[int, int]:
    """Letters or digits that touch the span; its length class."""
    touch = (start > 0 and text[start - 1].isalnum()) + 2 * (stop < len(text) and text[stop].isalnum())
    return touch, min((stop - start) // 8, 5)


_SPAN = "struct<kind: int, start: int, stop: int, base: boolean, form: int, check: int, gazetteer: int, context: int, touch: int, size: int>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), *((n, pa.int32()) for n in ("form", "check", "gazetteer", "context", "touch", "size"))]))
_PATTERN = ["kind", "form", "check", "gazetteer", "context", "touch", "size"]


def candidates(text: str) -> list[tuple]:
    """Rows of _SPAN, by kind as listed, then start."""
    base = base_spans(text)
    every = [(KINDS.index(kind), a, b, True) for kind, spans in base.items() for a, b in spans]
    every += [(KINDS.index(kind), a, b, False) for kind, a, b in _more(text, base)]
    return [(*row, *votes(KINDS[row[0]], text, row[1], row[2]), *_shape(text, row[1], row[2])) for row in sorted(every)]


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _ARROW.value_type]
    for batch in blocks(batches, "text"):
        spans = [[dict(zip(names, row, strict=True)) for row in candidates(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, _ARROW)], names=["id", "spans"])


class SpanModel:
    """Reliabilities by expectation-maximisation over counted vote patterns, then a
    logistic classifier on votes and shape with the posteriors as soft labels."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 30):
        """patterns: one row for each distinct _PATTERN."""
        self.weights = np.zeros(self._features(np.zeros((1, len(_PATTERN)), int)).shape[1])
        self.reliability = np.full((len(KINDS), 4), 0.8)
        self.share = np.full(len(KINDS), 0.5)
        if len(patterns):
            self._train(patterns, counts.astype(float), rounds)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        kind, vote = patterns[:, 0], patterns[:, 1:5]
        right = np.log(self.reliability[kind]) - np.log1p(-self.reliability[kind])
        odds = np.log(self.share[kind]) - np.log1p(-self.share[kind]) + (vote * right).sum(axis=1)
        return 1 / (1 + np.exp(-odds))

    @staticmethod
    def _features(patterns: np.ndarray) -> np.ndarray:
        kind = np.eye(len(KINDS))[patterns[:, 0]]
        vote = np.concatenate([(patterns[:, 1:5] == v).astype(float) for v in (1, -1)], axis=1)
        by_kind = (kind[:, :, None] * vote[:, None, :]).reshape(len(patterns), -1)
        return np.concatenate([kind, vote, by_kind, np.eye(4)[patterns[:, 5]][:, 1:], np.eye(6)[patterns[:, 6]]], axis=1)

    def _train(self, patterns: np.ndarray, counts: np.ndarray, rounds: int) -> None:
        kind, vote = patterns[:, 0], patterns[:, 1:5]
        for _ in range(rounds):
            truth = self.posterior(patterns)
            for k in range(len(KINDS)):
                own = kind == k
                if not own.any():
                    continue
                n, t, v = counts[own], truth[own], vote[own]
                self.share[k] = ((n * t).sum() + 1) / (n.sum() + 2)
                agree = (n[:, None] * np.where(v == 1, t[:, None], np.where(v == -1, 1 - t[:, None], 0))).sum(axis=0)
                cast = (n[:, None] * (v != 0)).sum(axis=0)
                self.reliability[k] = np.clip((agree + 8) / (cast + 10), 0.55, 0.99)  # as a prior, 8 of 10 votes are right
        x, soft = self._features(patterns), self.posterior(patterns)
        n = counts / counts.sum()
        for _ in range(25):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-x @ self.weights))
            hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
            self.weights += np.linalg.solve(hessian, x.T @ (n * (soft - p)) - 1e-4 * self.weights)

    def probability(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._features(patterns) @ self.weights))


def fit_spans(listed: DataFrame) -> SpanModel:
    """From the pattern counts of all rows: at most 4 * 81 * 4 * 6 rows reach the driver."""
    counted = listed.select(F.explode("spans").alias("s")).select("s.*").groupBy(*_PATTERN).count().orderBy(*_PATTERN).collect()
    rows = np.array([r[:-1] for r in map(tuple, counted)], int).reshape(-1, len(_PATTERN))
    return SpanModel(rows, np.array([r["count"] for r in counted]))


def _write(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def list_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Step 1 as a kept table: id, spans (array of _SPAN)."""
    bounded_batches(documents.sparkSession)
    source = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return keep(source.mapInArrow(_list, f"id long, spans array<{_SPAN}>"), "spans")


def personal_data(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone and base_sha256 (of the base
    spans), spans (base and accepted ones, kind:start:end by kind, then start),
    n_added (accepted ones).

    Null and empty texts have no spans. Repeated rows and null ids each keep a row;
    other columns are not read. An empty table gives an empty result.
    """
    listed = list_spans(documents, id_column, text_column)
    classifier = fit_spans(listed)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for spans in batch.column("spans").to_pylist():
                base = [(s["kind"], s["start"], s["stop"]) for s in spans if s["base"]]
                chosen = accepted(spans, classifier, accept)
                for k in range(4):
                    columns[k].append(sum(s[0] == k for s in base))
                columns[4].append(hashlib.sha256(_write(base).encode()).hexdigest())
                columns[5].append(_write(chosen))
                columns[6].append(len(chosen) - len(base))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns, kinds)], names=["id", *_COLUMNS])

    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return listed.mapInArrow(decide, schema).withColumnRenamed("id", id_column)


_COLUMNS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]


def accepted(spans: list[dict], classifier: SpanModel, least: float) -> list[tuple[int, int, int]]:
    """Base spans and candidates that the classifier takes, in order."""
    if not spans:
        return []
    p = classifier.probability(np.array([[s[n] for n in _PATTERN] for s in spans]))
    return [(s["kind"], s["start"], s["stop"]) for s, q in zip(spans, p, strict=True) if s["base"] or q >= least]


def masked_texts(documents: DataFrame, text_column: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The same rows and columns with each span replaced by its kind in brackets;
    null texts stay null. Two passes: candidates are counted, then masked."""
    numbered = documents.select(F.lit(0).cast("long").alias("id"), F.col(text_column).alias("text"))
    listed = list_spans(numbered, "id", "text")
    classifier = fit_spans(listed)
    at = documents.columns.index(text_column)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _ARROW.value_type]
        for batch in blocks(batches, text_column):
            texts = []
            for text in batch.column(at).to_pylist():
                spans = accepted([dict(zip(names, row, strict=True)) for row in candidates(text)], classifier, accept) if text else []
                parts, done = [], 0
                for kind, start, stop in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if start >= done:
                        parts += [text[done:start], f"[{KINDS[kind]}]"]
                        done = stop
                    elif stop > done:  # spans of two kinds overlap: hide the rest, too
                        done = stop
                texts.append(text if text is None or not spans else "".join([*parts, text[done:]]))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(mask, documents.schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
