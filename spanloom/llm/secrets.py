"""Secret scan: patterns, and strings that zstandard finds new where a secret would stand.

Base kinds: assign (a secret's name, = or :, a value), access (AKIA...), hex (long runs).
Every string in a sensitive context is then measured: the values of base spans, and the runs of
LONG or more identifier or base-64 characters that start within REACH characters after a
sensitive word, or, of a run that holds such a word, what follows the first of them. What
a string adds to the output of a zstandard compressor that is primed with a dictionary of
identifiers and has read the text around it, against a random string, tells a new string from a
name that the code already uses; strings of NEW or more are reported as novel, those of base spans beside
the base span. Time is linear in a text: each run is measured once, BLOCK characters at a time.

Offsets are code points of the whole text, ends exclusive. Null and empty texts have no
spans; texts of any length are taken whole. Rows are independent, so repeated rows get equal
spans; of spans that start together the kinds come in the order above. An empty table gives
an empty one. Columns of docs stay; one that has the name of the result is kept under that
name and "_".
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import extended, make_room
from .text import store

KINDS = ("assign", "access", "hex", "novel")
# The patterns that are asked for, and the least characters of a match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}
SENSITIVE = re.compile(r"(?:pass|pwd|secret|token|key|auth|bearer|credential|private|session|cookie|signature|salt|connection)[a-z_]*", re.ASCII | re.IGNORECASE)
LONG = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LONG},}}")
# Names that occur in code and configuration.
IDENTIFIERS = b"""
access_key access_token account api_key api_url application argument array attribute authorization base64 boolean buffer
callback certificate character class client client_id client_secret collection column command config configuration
connection connection_string constant content context controller cookie count credential current database default
description document element encoding endpoint environment error example exception expected expires field filename
filter format function header hostname identifier implementation index initialize input instance integer interface
internal iterator length library localhost manager message method module number object operation option output package
parameter parse password path pattern permission placeholder port private private_key process property protocol provider
public_key query record redirect reference refresh_token region register repository request resource response result
return schema secret secret_key security select sequence server service session session_id signature source statement
status stream string structure submit subscription system table target template thread timeout timestamp token
transaction undefined update upload username utility validate value variable version window
0123456789abcdef 00000000-0000-0000-0000-000000000000 ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz
"""
AROUND, REACH, NEW, BLOCK = 256, 64, 0.73, 1024
#: Bytes that a reference to what the compressor has seen takes.
MATCH = 3
HEX_DIGITS = re.compile(r"[0-9a-fA-F]*")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def compressor() -> zstandard.ZstdCompressor:
    """A compressor primed with the identifiers; one for each worker."""
    kept = store().__dict__
    if "secrets" not in kept:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=3)
        kept["secrets"] = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False)
    return kept["secrets"]


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that a span adds to the output of the primed compressor after the text around it,
    less those of a reference, against what a random string as long takes: half a byte for a
    character of a string of hexadecimal digits, else three quarters."""
    pack, after, added, size = compressor().compress, text[end : end + AROUND], 0, 0
    for at in range(start, end, BLOCK):
        around = f"{after} {text[max(0, at - AROUND) : at]}".encode()
        own = text[at : min(at + BLOCK, end)].encode()
        added += len(pack(around + own)) - len(pack(around))
        size += len(own)
    return max(0, added - MATCH) / size / (0.5 if HEX_DIGITS.fullmatch(text, start, end) else 0.75)


def measured(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The strings in a sensitive context, in order of their starts."""
    out = [(ASSIGN.match(text, s).start(2), e) if k == "assign" else (s, e) for s, e, k in base]
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    if words:
        ends, taken = [e for _, e in words], merged(base)
        for m in CANDIDATE.finditer(text):
            s, e = m.span()
            k = bisect.bisect_right(ends, s)  # the words that end by the start of the run
            if not k or s > ends[k - 1] + REACH:
                if k == len(ends) or ends[k] > e:
                    continue
                s = ends[k]
                while s < e and text[s] in "=/+-_":
                    s += 1
                if e - s < LONG:
                    continue
            i = bisect.bisect_left(taken, (e, e)) - 1
            if i < 0 or taken[i][1] <= s:
                out.append((s, e))
    return sorted(set(out))


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Disjoint sorted spans that cover what the spans cover."""
    out: list[list[int]] = []
    for s, e, _ in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def all_spans(text: str) -> list[tuple[int, int, str]]:
    """Base and novel spans, by start and then by kind."""
    base = base_spans(text)
    novel = [(s, e, "novel") for s, e in measured(text, base) if novelty(text, s, e) >= NEW]
    return sorted(base + novel, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """docs with an array of (kind, start, end)."""
    docs = make_room(docs, [name], keep=text)
    fields = [f.name for f in docs.schema]
    at = fields.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in all_spans(t.as_py() or "")] for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*fields, name])

    return docs.mapInArrow(run, extended(docs, f"`{name}` array<struct<kind: string, start: bigint, end: bigint>>"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """text with its spans replaced; of an assignment only the value goes."""
    out, at = [], 0
    for s, e, k in spans:
        if k == "assign":
            s = ASSIGN.match(text, s).start(2)
        if e <= at:
            continue
        out += [text[at : max(at, s)], mark] if s >= at else []
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every secret of `text` replaced; all rows and columns stay."""
    fields = [f.name for f in docs.schema]
    at = fields.index(text)

    def run(batches):
        for b in batches:
            texts = [None if t is None else redacted(t, all_spans(t)) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=fields)

    return docs.mapInArrow(run, docs.schema)
