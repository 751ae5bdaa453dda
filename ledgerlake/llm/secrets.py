"""Secret scan with multipart credential linking.

Strong findings stand alone: values assigned to a secret name (``assign``),
access identifiers (``access``) and long lower-case hex strings (``hex``).  Weak
parts mean little alone: account identifiers (``ident``), opaque mixed strings
(``blob``) and service addresses (``endpoint``).  Every part covers an interval
that reaches REACH code points to both sides (its scope); an interval join over
the sorted parts of a document links all pairs of complementary roles whose scopes
meet and that do not overlap (what overlaps is one string seen twice).  A weak part
is reported only if it has such a partner: an identifier
needs a secret, a blob needs an identifier or an address, an address needs a
secret.  Strong findings are always reported, unchanged.

Parts of one kind do not overlap and have a least length, so a part has a bounded
number of partners in its scope and the links are linear in the parts.  Positions
are code points, end exclusive.

Defined cases: null text is empty (no findings); texts of any length are
scanned whole; equal starts are ordered by kind as listed in KINDS; an empty
table gives an empty result.  Only the identifier and the text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty, tidied

REACH = 200
KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
BASE = KINDS[:3]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "blob": "secret", "endpoint": "address"}
#: What a weak part needs next to it.
NEEDS = {"ident": ("secret",), "blob": ("identifier", "address"), "endpoint": ("secret",)}
#: For links: the roles that complete a role.
COMPLETES = {"identifier": ("secret", "address"), "secret": ("identifier", "address"), "address": ("secret", "identifier")}

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
DIGIT = re.compile(r"[0-9]")
IDENT = re.compile(
    r"""\b(?:user(?:name|_id)?|login|account(?:_id)?|client_id|tenant(?:_id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
BLOB = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"""\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+""", re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strong findings; cheap substring tests spare most texts the scans."""
    out = []
    low = text.lower()
    if any(n in low for n in ASSIGN_NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [("ident", m.start(), m.end()) for m in IDENT.finditer(text)]
    if DIGIT.search(text):
        out += [("blob", m.start(), m.end()) for m in BLOB.finditer(text)]
    if "://" in text:
        out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    return out


def partners(part: tuple[str, int, int], starts: list[tuple[int, int, str]], ends: list[tuple[int, int, str]], reach: int) -> list[tuple[str, int, int]]:
    """The parts of a role whose scopes meet the part's and that do not overlap it.
    starts holds (start, end, kind) by start, ends (end, start, kind) by end."""
    _, s, e = part
    low, high = bisect_left(ends, s - 2 * reach, key=itemgetter(0)), bisect_right(ends, s, key=itemgetter(0))
    first, last = bisect_left(starts, e, key=itemgetter(0)), bisect_right(starts, e + 2 * reach, key=itemgetter(0))
    return [(k, a, b) for b, a, k in ends[low:high]] + [(k, a, b) for a, b, k in starts[first:last]]


def apart(spans: list[tuple[str, int, int]], from_: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of the others, by one sorted list of their unions."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in from_):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s), ends.append(e)
    free = lambda s, e: (k := bisect_right(ends, s)) == len(starts) or starts[k] >= e
    return [x for x in spans if free(x[1], x[2])]


def link(text: str, reach: int = REACH) -> tuple[list[tuple[str, int, int]], list[tuple[tuple, tuple]]]:
    """All reported spans and the links between complementary parts of a text."""
    base = base_spans(text)
    weak = weak_spans(text)
    if not base and len(weak) < 2:
        return base, []
    free = set(apart([w for w in weak if w[0] == "blob"], base))
    parts = base + [w for w in weak if w[0] != "blob" or w in free]
    by_role: dict[str, list[tuple[int, int, str]]] = {}
    for kind, s, e in sorted(parts, key=lambda x: (x[1], KINDS.index(x[0]))):
        by_role.setdefault(ROLE[kind], []).append((s, e, kind))
    ends = {r: sorted(((e, s, k) for s, e, k in v), key=itemgetter(0, 1)) for r, v in by_role.items()}
    kept, links = [], []
    for p in parts:
        found = {r: partners(p, by_role[r], ends[r], reach) for r in COMPLETES[ROLE[p[0]]] if r in by_role}
        if p[0] in BASE or any(found.get(r) for r in NEEDS[p[0]]):
            kept.append(p)
            links += [(p, q) for of_role in found.values() for q in of_role]
    reported = set(kept)
    return kept, [(p, q) for p, q in links if q in reported]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
LINK = T.StructType([T.StructField("part", SPAN), T.StructField("partner", SPAN)])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """id, spans array<(kind, start, end)> by start and kind, links array<(part, partner)>."""
    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = T.StructType(
        [
            T.StructField(id_col, src.schema["_id"].dataType),
            T.StructField("spans", T.ArrayType(SPAN)),
            T.StructField("links", T.ArrayType(LINK)),
        ]
    )
    as_span = lambda p: {"kind": p[0], "start": p[1], "end": p[2]}
    order = lambda p: (p[1], KINDS.index(p[0]), p[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            spans, links = [], []
            for value in batch.column(1):
                found, linked = link(value.as_py(), reach)
                spans.append([as_span(p) for p in sorted(found, key=order)])
                links.append([{"part": as_span(p), "partner": as_span(q)} for p, q in sorted(linked, key=lambda x: (order(x[0]), order(x[1])))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(spans, pa.list_(span)),
                    pa.array(links, pa.list_(pa.struct([("part", span), ("partner", span)]))),
                ],
                [id_col, "spans", "links"],
            )

    return src.mapInArrow(tidied(run), schema)
