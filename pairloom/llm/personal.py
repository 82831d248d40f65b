"""Personal data: base patterns, and a semi-Markov conditional random field that adds whole spans.

Base spans come from four patterns (email, ip, card, phone) and always stay. Around digits, at signs and spelled-out at
signs that they leave over, the semi-Markov field of personal_model.py scores every candidate segment of at most
MOST_ATOMS atoms as a whole - digits, shape, groups, Luhn sum, neighbours, the words before, address parts - for each
kind, atoms outside segments one by one, and a Viterbi pass over the region picks boundaries and kinds together; base
spans are closed to it. Its weights are fitted by maximum likelihood on sentences written there, with forms that the
base patterns miss (phones without a country code, cards with dots, spelled-out addresses) and look-alikes (dates,
versions, sums, order numbers, ISBN).

Nulls count as empty texts; empty texts have no spans; an empty table gives an empty result; repeated rows are scored
alike; columns beside id and text
are ignored by the digests and kept by mask_personal, whatever their names. Everything is linear in the text's length,
so very long texts only take their share of time.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, text_of
from .personal_model import CONNECTOR, KINDS, LEAST_DIGITS, NOT_DIGIT, decode, fitted, luhn

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9][0-9\x20().+/-]*")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An at sign that may belong to an address: a sign, in brackets, or a word with a spelled-out dot after the next one.
#: Groups of four digits with marks that no base pattern takes.
JOINED = re.compile(r"[0-9]{4}(?:[_·/][0-9]{4}){3}")
MARK = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|(?<![^\W_])at(?=\s+[A-Za-z0-9-]+(?:\s+dot\s|\s?[\[({]\s?dot))", re.I)
BLANKS = re.compile(r"[ \t]*")
PART = re.compile(r"[A-Za-z0-9._%+-]+")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the base patterns in order, and the runs of number characters."""
    emails, ips, cards, phones, runs = [], [], [], [], []
    at, last = text.find("@"), 0
    while at >= 0:
        m, start = DOMAIN.match(text, at), at
        if m:
            while start > last and text[start - 1] in LOCAL:
                start -= 1
        if m and start < at:
            last = m.end()
            emails.append((0, start, last))
        at = text.find("@", max(last, at + 1))
    for run in NUMBERS.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        runs.append((a, b))
        for m in ADDRESS.finditer(text, a, b):
            if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m.group().split(".")):
                ips.append((1, *m.span()))
        for m in CARD.finditer(text, a, b):
            if m.end() - m.start() >= 16:
                digits = NOT_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    cards.append((2, *m.span()))
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            phones.append((3, *m.span()))
        at = text.find("+", m.end() if m else at + 1)
    return emails + ips + cards + phones, runs


# --- regions --------------------------------------------------------------------------------------------------------


def _address_around(text: str, start: int, end: int, low: int) -> tuple[int, int]:
    """The stretch around an at sign, from `low` on, that may be an address: parts, and spelled-out signs between them."""
    left, right = start, end
    while True:  # a part, then a connector before it
        at = left
        while at > low and text[at - 1] in " \t":
            at -= 1
        stop = at
        while at > low and text[at - 1] in LOCAL:
            at -= 1
        if at == stop:
            break
        left = at
        gap = left
        while gap > low and text[gap - 1] in " \t":
            gap -= 1
        m = next((m for k in range(1, 8) if gap - k >= low and (m := CONNECTOR.fullmatch(text, gap - k, gap))), None)
        if m is None:
            break
        left = m.start()
    while True:
        part = PART.match(text, BLANKS.match(text, right).end())
        if part is None:
            break
        right = part.end()
        m = CONNECTOR.match(text, BLANKS.match(text, right).end())
        if m is None:
            break
        right = m.end()
    return left, right


def _regions(text: str, spans: list[tuple[int, int, int]], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of text that may hold a span that the base patterns miss; none overlaps another, or begins or ends inside a word."""
    places = []
    for a, b in runs:
        if len(NOT_DIGIT.sub("", text[a:b])) >= LEAST_DIGITS:
            # a run of digits and letters, or with other marks between, is looked at as a whole
            while a and (text[a - 1] in "+(_/·" or text[a - 1].isalnum()):
                a -= 1
            while b < len(text) and (text[b] in "_/·" or text[b].isalnum()):
                b += 1
            places.append((a, b))
    places += [_joined_runs(text, m.start(), m.end()) for m in JOINED.finditer(text)]
    last = 0
    for m in MARK.finditer(text):
        if m.start() >= last:  # otherwise the stretch around an earlier sign holds it
            places.append(_address_around(text, *m.span(), last))
            last = places[-1][1]
    covered = sorted((s, e) for _, s, e in spans)
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if any(s <= a and b <= e + 1 for s, e in covered[max(0, _before(covered, a) - 1) : _before(covered, a) + 1]):
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _joined_runs(text: str, a: int, b: int) -> tuple[int, int]:
    while a and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum():
        b += 1
    return a, b


def _before(spans: list[tuple[int, int]], at: int) -> int:
    low, high = 0, len(spans)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if spans[mid][0] <= at else (low, mid)
    return low


def trained() -> dict[tuple[int, str], float]:
    return fitted(_regions, base_spans)


def personal_spans(text: str, weights: dict[tuple[int, str], float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text."""
    base, runs = base_spans(text)
    closed = sorted((s, e) for _, s, e in base)
    added = []
    for a, b in _regions(text, base, runs):
        added += decode(text, a, b, closed[max(0, _before(closed, a) - 2) : _before(closed, b) + 1], weights)
    return base, added


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base spans' counts by kind and digest, all spans joined, and n_added."""
    weights = trained()
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, spans, n_added = [], [], [], []
            for s in batch.column("text"):
                base, added = personal_spans(s.as_py(), weights)
                counts.append([sum(k == i for k, _, _ in base) for i in range(len(KINDS))])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(sorted(base + added)))
                n_added.append(len(added))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(n_added, pa.int64())], schema=out)

        return step

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_arrow(rows, start, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data in the text replaced by its kind in brackets."""
    weights, at = trained(), docs.columns.index(text)

    def masked(s: str | None) -> str | None:
        if not s:
            return s
        base, added = personal_spans(s, weights)
        out, last = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in base + added):
            if a >= last:
                out += [s[last:a], f"[{KINDS[k]}]"]
            elif b > last:
                pass  # it overlaps the one before, whose mark stands for both
            last = max(last, b)
        return "".join([*out, s[last:]]) if out else s

    def start():
        return lambda batch: batch.set_column(at, batch.schema.field(at), pa.array([masked(s.as_py()) for s in batch.column(at)], batch.schema.field(at).type))

    return map_arrow(docs, start, docs.schema)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(documents(spark, sf_dir))
