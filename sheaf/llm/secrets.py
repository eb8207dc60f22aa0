"""Secret scans with multipart credential linking.

Strong spans are reported wherever they stand: ``assign`` (a named value), ``access`` (an access identifier) and
``hex`` (a long hexadecimal run). Weak spans alone are mostly noise: ``ident`` (a user, account or client name, or
a run of capitals and digits), ``key`` (a random-looking token, or a short named value) and ``endpoint`` (a URL, or a
host with a port). A weak span is reported only if parts of a credential that complement it stand in its scope:

=========== ============= =======================================
kind        part          reported if in scope there is
=========== ============= =======================================
ident       identifier    a secret
key         secret        an identifier or an endpoint
endpoint    endpoint      an identifier and a secret
=========== ============= =======================================

``access`` is an identifier, ``assign`` and ``hex`` are secrets. A scope is the lines up to a blank one, however long.
An endpoint may overlap a strong span (a URL with a password in it); an identifier that does so is a part, if it is not
all inside, but not reported itself. The interval join sorts each part's intervals and looks a span's scope up by
binary search over starts and running maxima of ends, so a text with many candidates costs n log n. All parts of a
credential stand in one text, so nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "ident", "key", "endpoint")
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "key": "secret", "endpoint": "endpoint"}
NEEDS = {"ident": (("secret",),), "key": (("identifier", "endpoint"),), "endpoint": (("identifier",), ("secret",))}

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_IDENT = re.compile(r"""(?i:user(?:_?name)?|login|account(?:_?id)?|client_?id|(?:access_?)?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})|(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,}(?![A-Za-z0-9])""", re.ASCII)
_ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![\w.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])""", re.ASCII)
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")


def random_looking(token: str) -> bool:
    """Lower case, upper case and digits, and at least 3.5 bits of entropy a character."""
    if not (re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= 3.5


def _near(spans: list[tuple[int, int]]):
    """Whether any of the intervals overlaps [low, high]."""
    spans = sorted(spans)
    starts, reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    return lambda low, high: bool(k := bisect_right(starts, high)) and reach[k - 1] >= low


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all reported spans in the order of start, then kind; code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    low = text.lower()
    short = []
    if any(n in low for n in _NAMES):
        for m in _ASSIGN.finditer(text):
            (found["assign"] if m.end(1) - m.start(1) >= 8 else short).append(m.span())
    if "AKIA" in text:
        found["access"] = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found["hex"] = [m.span() for m in _HEX.finditer(text)]
    covered = _near([x for k in BASE for x in found[k]])
    free = lambda spans: [x for x in spans if not covered(x[0] + 1, x[1] - 1)]
    strong = sorted(x for k in BASE for x in found[k])
    starts, reach = [s for s, _ in strong], list(accumulate((e for _, e in strong), max))
    inside = lambda s, e: bool(k := bisect_right(starts, s)) and reach[k - 1] >= e
    found["endpoint"] = [m.span() for m in _ENDPOINT.finditer(text)] if ":" in low else []
    idents = [m.span() for m in _IDENT.finditer(text)]
    found["ident"], partners = free(idents), [x for x in idents if not inside(*x)]
    if found["endpoint"] or partners or found["access"]:  # a weak secret needs one of them
        other = _near(free(found["endpoint"]) + found["ident"])
        tokens = [m.span() for m in _KEY.finditer(text) if random_looking(m[0])]
        found["key"] = free(short + [x for x in tokens if not other(x[0] + 1, x[1] - 1)])
    if any(found[k] for k in NEEDS):
        parts = {p: _near([x for k in KINDS if PART[k] == p for x in (partners if k == "ident" else found[k])]) for p in set(PART.values())}
        blank = [m.span() for m in _BLANK_LINE.finditer(text)]
        opened, closed = [0, *(e for _, e in blank)], [*(s for s, _ in blank), len(text)]
        for kind, needs in NEEDS.items():
            linked = []
            for s, e in found[kind]:
                first, last = opened[bisect_right(opened, s) - 1], closed[bisect_left(closed, min(e, len(text)))]
                if all(any(parts[p](first, last) for p in some) for some in needs):
                    linked.append((s, e))
            found[kind] = linked
    return [(KINDS[k], s, e) for s, k, e in sorted((s, k, e) for k, kind in enumerate(KINDS) for s, e in found[kind])]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])
    for batch in batches:
        spans = [[dict(zip(("kind", "start", "end"), x)) for x in scan(t.as_py() or "")] for t in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(spans, pa.list_(_SPAN))], schema=schema)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``spans`` array<struct<kind, start, end>>), one row per row of ``docs``.

    Null and empty texts have no spans. Repeated rows, null ids and an empty table are nothing special; other
    columns are not looked at.
    """
    d = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    return d.mapInArrow(_scan_rows, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
