"""Secret scan: key patterns, plus a token-efficiency test for random strings.

A vocabulary learnt from text spends few tokens on text and many on noise, so a
run of key characters with few characters to a token is a likely secret.  The
whole run is tested, the parts between separators, and windows inside it, so
that a key joined to words isn't averaged away.
Digests of known lengths, digits, identifiers (UUIDs, dotted or slashed names,
words) are not.  Spans are in code points, end exclusive.

Null and empty texts have no spans.  Equal rows give equal rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import common, token_counts

#: The base patterns; the group must have so many characters.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
KINDS = ("assign", "access", "hex", "random")
#: Characters of a run or part that the efficiency test looks at, at least, and of a token in a random one, at most.
LEAST, RATIO = 16, 1.9
#: Least characters of a part of letters of one case: shorter words of some languages have as low a ratio.
ONE_CASE = 20
#: Characters of a window, its step, and its ratio at most.
WINDOW, STEP, WINDOW_RATIO = 20, 4, 1.6
_PART = re.compile(r"[A-Za-z0-9]{%d,}" % LEAST)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_HEX = re.compile(r"[0-9a-f]{32,}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
#: Fixed value: hexadecimal digits in MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_DIGITS = frozenset((32, 40, 56, 64, 96, 128))
REDACTED = "[SECRET]"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end by start, then kind as listed."""
    out = []
    for kind, pattern, group, least in BASE:
        if kind == "assign" and ":" not in text and "=" not in text or kind == "access" and "AKIA" not in text:
            continue
        # a run shorter than 32 is dropped anyway, and a longer one starts where its maximal run starts
        for m in (_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def known(run: str) -> bool:
    """A digest, a UUID, a number or a name: no secret by its look alone."""
    if len(run) in DIGEST_DIGITS and _DIGEST.match(run) or _UUID.match(run):
        return True
    body = run.strip("=")
    letters, digits = sum(c.isalpha() for c in body), sum(c.isdigit() for c in body)
    if not letters or not digits:
        return True
    pieces = [p for p in re.split(r"[/_=+-]+", body) if p]
    return all(p.isdigit() or p.isalpha() and p.islower() or p.isalpha() and p.isupper() or p.istitle() and p.isalpha() for p in pieces)


def known_part(part: str) -> bool:
    """A digest, a number or a short word; other letters are left to the ratio."""
    return part.isdigit() or len(part) in DIGEST_DIGITS and bool(_DIGEST.match(part)) or part.isalpha() and len(part) < ONE_CASE and (part[1:].islower() or part.isupper())


def run_spans(run: str, encode, ratio: float = RATIO) -> list[tuple[int, int]]:
    """What of a run looks random: all of it, or else parts and stretches of windows, in order and apart."""
    if _UUID.match(run) or len(run) in DIGEST_DIGITS and _DIGEST.match(run):
        return []
    if not known(run) and len(run) <= ratio * len(encode(run)):
        return [(0, len(run))]
    found, safe = [], []
    for m in _PART.finditer(run):
        if known_part(m[0]):
            safe.append(m.span())
        elif len(m[0]) <= ratio * len(encode(m[0])):
            found.append(m.span())
    settled = [*safe, *found]
    for at in sorted({*range(0, len(run) - WINDOW, STEP), len(run) - WINDOW}) if len(run) > WINDOW else ():
        if any(s < at + WINDOW and at < e for s, e in settled):
            continue
        window = run[at : at + WINDOW]
        if not known(window) and WINDOW <= WINDOW_RATIO * len(encode(window)):
            found.append((at, at + WINDOW))
    out = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def random_spans(text: str, encode, ratio: float = RATIO) -> list[tuple[str, int, int]]:
    return [("random", m.start() + s, m.start() + e) for m in _RUN.finditer(text) for s, e in run_spans(m[0], encode, ratio)]


def all_spans(text: str, encode) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    inside = [x for x in random_spans(text, encode) if not any(s <= x[1] and x[2] <= e for _, s, e in base)]
    return base, sorted([*base, *inside], key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans (kind:start:end, comma-joined)."""
    path = vocabulary or token_counts.default_ranks()
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string())])

    def scan(batches):
        encode = token_counts.encoding(path).encode_ordinary
        for batch, values in common.slices(batches, 1):
            found = [all_spans(x, encode) for x in values]
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in found], pa.int64()) for kind, *_ in BASE]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(a) for _, a in found], pa.string())], schema=schema)

    return common.texts(docs).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans become one mark."""
    out, done = [], 0
    for _, s, e in spans:
        if s >= done:
            out += [text[done:s], REDACTED]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The documents, same columns and rows, with secrets replaced in the texts."""
    path, at = vocabulary or token_counts.default_ranks(), docs.columns.index("text")

    def clean(batches):
        encode = token_counts.encoding(path).encode_ordinary
        for batch, values in common.slices(batches, at):
            new = [x and redact(x, all_spans(x, encode)[1]) for x in values]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(new, batch.schema.field(at).type), *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
