"""Scan texts for secrets, linking the parts of multipart credentials.

Strong findings stand by themselves: assigned secrets, access identifiers and long
hexadecimal runs. Weak candidates are parts that mean little alone: short
identifiers, opaque values and endpoints. A scope is a paragraph. Within a scope
parts are joined by intervals, those at most ``REACH`` characters apart, and a weak
candidate is reported only where parts that complement it are in reach: an
identifier needs a secret; an opaque value needs an identifier; an endpoint needs
both. Parts are swept in order of position with the nearest part of each role on
either side, so a scope takes time in proportion to its parts. A text's result
depends on that text alone, so the scan needs no shuffle.

Defined results: a null or empty text has no findings; positions count code points;
repeated rows each get the result of their text; a null id stays null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Texts without any of these in lower case have no assignment, or no identifier.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_IDENTIFIER_WORDS = ("user", "login", "account", "client", "access")

#: Weak parts: what names a caller, what may be a key, where it is used.
_IDENTIFIER = re.compile(
    r"""(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s\"'<>]{4,}", re.ASCII)
_PARAGRAPH = re.compile(r"\n\s*\n")

ORDER = {kind: i for i, kind in enumerate(("assign", "access", "hex", "identifier", "opaque", "endpoint"))}
#: Parts of one credential are at most so many characters apart.
REACH = 400

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Findings that stand by themselves."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _mixed(value: str) -> bool:
    """Letters of both cases and digits, as random keys have them and words don't."""
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)


def weak_parts(text: str) -> list[Span]:
    """Candidates that need complementary parts."""
    low = text.lower()
    found = [("opaque", *m.span()) for m in _OPAQUE.finditer(text) if _mixed(m[0])]
    if "://" in text:
        found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    if any(w in low for w in _IDENTIFIER_WORDS):
        found += [("identifier", *m.span()) for m in _IDENTIFIER.finditer(text)]
    return in_order(found)


#: What each part can be in a credential.
ROLES = {
    "assign": "secret", "hex": "secret", "opaque": "secret",
    "access": "name", "identifier": "name", "endpoint": "place",
}
#: What a weak part must have in reach.
NEEDS = {"identifier": ("secret",), "opaque": ("name",), "endpoint": ("name", "secret")}


def linked(text: str, base: list[Span], weak: list[Span]) -> list[Span]:
    """The weak parts whose complements are in the same paragraph and in reach."""
    if not weak:
        return []
    breaks = [m.start() for m in _PARAGRAPH.finditer(text)]
    sides: dict[tuple[int, str], list[Span]] = {}
    for span in in_order(base + weak):
        sides.setdefault((bisect.bisect_right(breaks, span[1]), ROLES[span[0]]), []).append(span)
    starts = {k: [s[1] for s in v] for k, v in sides.items()}
    # The farthest end so far makes the nearest part before a place a lookup.
    ends = {}
    for k, spans in sides.items():
        far, ends[k] = 0, []
        for s in spans:
            far = max(far, s[2])
            ends[k].append(far)

    def near(scope: int, role: str, start: int, end: int) -> bool:
        k = (scope, role)
        if k not in starts:
            return False
        at = bisect.bisect_left(starts[k], start)
        after = bisect.bisect_left(starts[k], end)
        return (
            at > 0 and start - ends[k][at - 1] <= REACH
            or after < len(starts[k]) and starts[k][after] - end <= REACH
            or after > at
        )

    return [
        s for s in weak
        if all(near(bisect.bisect_right(breaks, s[1]), role, s[1], s[2]) for role in NEEDS[s[0]])
    ]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            added = linked(text, base, weak_parts(text))
            rows.append([
                {"kind": k, "start": a, "end": b, "base": s in base_set}
                for base_set in [set(base)]
                for s in in_order(base + [x for x in added if x not in base_set])
                for k, a, b in [s]
            ])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "findings"])


def find_credentials(docs: DataFrame) -> DataFrame:
    """``(doc_id, findings)``: kind, start, end and whether a finding stands by itself."""
    return docs.select("doc_id", "text").mapInArrow(
        _scan, "doc_id bigint, findings array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    )


def op10(spark, sf_dir: str) -> DataFrame:
    found = find_credentials(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("findings", lambda f: f["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ","
        )

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"),
    )
