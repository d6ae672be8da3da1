"""Secret scan: Aho-Corasick prefilter, anchored expressions near hits, checksum validation.

One automaton of lower-cased keywords runs over a slice of texts. Only where it hits is the
kind's expression tried, anchored at the keyword. Long hexadecimal runs have no keyword;
their prefilter looks at every 16th character, as a run of 32 covers two of those in a row.
Tokens with an embedded CRC-32 (six base-62 digits behind thirty random ones) count only if
it is right.

Kinds, in the order that breaks ties of equal starts: assign, access, hex, github, npm.
Matches of a kind are leftmost and do not overlap; a match that is too short is dropped
after it has been consumed. Positions are code points, the end exclusive.

Defined results: null and empty texts have no spans; repeated rows give repeated results;
an empty table gives an empty table; columns that are not asked for are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, slices

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC-32 of an ASCII string as six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = _BASE62[rest] + digits
    return digits


def _checksummed(m: re.Match) -> bool:
    return base62_crc(m[1][:30]) == m[1][30:]


#: kind -> keywords (lower case), anchored expression, test of a match
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
        lambda m: len(m[2]) >= 8,
    ),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _checksummed),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _checksummed),
}

_HEX_RUN = 32
_HEX = np.zeros(128, dtype=bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (words, _, _) in RULES.items():
        for word in words:
            out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def _hex_runs(text: str) -> list[tuple[int, int]]:
    """Runs of 32 or more lower-case hexadecimal digits."""
    step = _HEX_RUN // 2
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sampled = points[::step]
    good = (sampled < 128) & _HEX[np.minimum(sampled, 127)]
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(good[:-1] & good[1:]).tolist():
        window = points[i * step : (i + 1) * step]
        if (window < 128).all() and _HEX[window].all() and (not found or i * step >= found[-1][1]):
            first, last = i * step, (i + 1) * step
            while first and text[first - 1] in "0123456789abcdef":
                first -= 1
            while last < len(text) and text[last] in "0123456789abcdef":
                last += 1
            if last - first >= _HEX_RUN:
                found.append((first, last))
    return found


def scan_texts(texts: Sequence[str], automaton: ahocorasick.Automaton | None = None) -> list[list[tuple[str, int, int]]]:
    """The spans (kind, start, end) of each text, by start and then by kind."""
    automaton = automaton or _automaton()
    joined = "\n".join(texts)  # no expression crosses a line break
    lowered = joined.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII letters only
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    hits, free = [("hex", a, b) for a, b in _hex_runs(joined)], dict.fromkeys(RULES, 0)
    # Keywords come by their ends; by their starts is what leftmost means.
    for at, kind in sorted((end - length + 1, kind) for end, (length, kind) in automaton.iter(lowered)):
        if at >= free[kind] and (m := RULES[kind][1].match(joined, at)):
            free[kind] = m.end()
            if RULES[kind][2](m):
                hits.append((kind, m.start(), m.end()))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    hits.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    owners = np.searchsorted(begins, [h[1] for h in hits], side="right") - 1
    for i, (kind, a, b) in zip(owners.tolist(), hits, strict=True):
        out[i].append((kind, int(a - begins[i]), int(b - begins[i])))
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each covered stretch replaced by the kind that begins it."""
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row, its ``spans`` and its ``redacted`` text (null if the text is). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in slices(batches, "_text"):
            texts = as_text(batch.column("_text")).to_pylist()
            spans = scan_texts(texts, automaton)
            clean = [redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            nulls = batch.column("_text").is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), pa.array(rows, SPANS), pa.array(clean, pa.string(), mask=nulls)], ["_kept", "_spans", "_redacted"])

    picked = docs.select(F.struct(*[docs[c] for c in keep]).alias("_kept"), docs[text_col].alias("_text"))
    kept = picked.schema["_kept"].dataType.simpleString()
    out = picked.mapInArrow(run, f"_kept {kept}, _spans array<struct<kind: string, start: bigint, end: bigint>>, _redacted string")
    return out.select("_kept.*", F.col("_spans").alias("spans"), F.col("_redacted").alias("redacted"))
