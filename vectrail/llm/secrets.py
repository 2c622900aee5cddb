"""Secret scans: keyword prefilter, anchored expressions near hits, then checksums.

One pass of an Aho-Corasick automaton over the lower-cased bytes finds every keyword; only there the kind's
expression is tried, anchored at the hit. Kinds whose secrets carry a checksum keep a match only if it holds.
Runs of hexadecimal digits have no keyword: a byte table and a substring search find runs that are long
enough. Per kind, matches are leftmost and do not overlap; one that fails its length still takes its place.

Kinds of the base: assign, access, hex. Added: github and npm (tokens whose last six digits are
the base-62 CRC-32 of the thirty before), pem (the first line of a private key).

Results: spans count code points, end exclusive. A null or empty text has none; very
long texts are scanned whole. Where kinds' spans overlap or tie, each kind keeps its own. Repeated rows are scanned each; an empty
table gives no rows. ``scan`` reads only the columns asked for; ``redact`` keeps all columns.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vectrail.runtime import share_code, unused

#: Kinds in order, keywords (lower case) with the kind and the expression tried at them.
KINDS = ("assign", "access", "hex", "github", "npm", "pem")
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
EXPRESSIONS = {
    "assign": re.compile(ASSIGN.replace(b"password|passwd|secret|token|api_?key", b"(?i:password|passwd|secret|token|api_?key)")),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "pem": re.compile(rb"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
}
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "pem": ("-----begin",),
}
DIGITS62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = 32
HEX_TABLE = bytes(120 if c in b"0123456789abcdef" else 46 for c in range(256))
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
MASK = "[SECRET]"


def crc62(body: bytes) -> bytes:
    """The CRC-32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS62[d : d + 1] + out
    return out


def _holds(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return m.end(2) - m.start(2) >= 8
    if kind == "access":
        return m.end() - m.start() >= 16
    if kind in ("github", "npm"):
        return crc62(m[1][:30]) == m[1][30:]
    return True


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (len(w), kind))
    found.make_automaton()
    return found


def find(data: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets in a text's bytes, in bytes, by start and then by kind."""
    hits = sorted((end - n + 1, kind) for end, (n, kind) in automaton.iter(data.lower().decode("latin-1")))
    free = dict.fromkeys(KINDS, 0)
    out = []
    for at, kind in hits:
        if at >= free[kind] and (m := EXPRESSIONS[kind].match(data, at)):
            free[kind] = m.end()
            if _holds(kind, m):
                out.append((at, m.end(), kind))
    runs, need, at = data.translate(HEX_TABLE), b"x" * HEX_RUN, 0
    while (at := runs.find(need, at)) >= 0:
        end = at + HEX_RUN
        while end < len(runs) and runs[end] == 120:
            end += 1
        out.append((at, end, "hex"))
        at = end
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def to_code_points(data: bytes, spans: list[tuple[int, int, str]]) -> list[dict]:
    """The spans counted in code points."""
    if data.isascii():
        return [{"kind": k, "start": a, "end": b} for a, b, k in spans]
    places, n, last = {}, 0, 0
    for at in sorted({x for a, b, _ in spans for x in (a, b)}):
        n += len(data[last:at].decode())
        places[at], last = n, at
    return [{"kind": k, "start": places[a], "end": places[b]} for a, b, k in spans]


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``spans``: kind, start and end of each secret in the text, by start and then by kind."""
    share_code(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            n = batch.num_columns - 1
            texts = ((t.as_py() or b"") for t in batch.column(n))
            spans = [to_code_points(t, s) if (s := find(t, automaton)) else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(spans, kind)], [*batch.schema.names[:n], "spans"])

    bytes_ = unused("v_text", keep)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(bytes_))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != bytes_)
    return source.mapInArrow(run, f"{schema}, spans {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark; overlapping spans are one. ``n_chars`` follows where the text changed."""
    share_code(docs.sparkSession)
    schema = docs.schema
    arrow = to_arrow_schema(schema)
    at, counted = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def changed(column: pa.Array, values: dict) -> pa.Array:
        mask = np.zeros(len(column), bool)
        mask[list(values)] = True
        return pc.replace_with_mask(column, pa.array(mask), pa.array(list(values.values()), column.type))

    def clean(text: str | None, automaton) -> str | None:
        data = (text or "").encode()
        spans = find(data, automaton)
        if not spans:
            return text
        out, last = [], 0
        for start, end, _ in spans:
            if start >= last:
                out += [data[last:start], MASK.encode()]
            last = max(last, end)
        return b"".join([*out, data[last:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            new: dict[int, str] = {}
            for k, t in enumerate(batch.column(at)):
                old = t.as_py()
                if (text := clean(old, automaton)) != old:
                    new[k] = text
            columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, arrow, strict=True)]
            if new:
                columns[at] = changed(columns[at], new)
                if counted is not None:
                    columns[counted] = changed(columns[counted], {k: len(t) for k, t in new.items()})
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, schema)
