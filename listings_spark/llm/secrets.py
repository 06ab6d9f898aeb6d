"""Secrets in texts: fixed patterns, and strings that their surroundings do not explain."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # whole runs, of 16 or more
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")
# Words that announce a credential, and identifiers common in code and settings.
SENSITIVE = re.compile(
    r"access|api|auth|bearer|cert|client|cookie|cred|hash|key|login|passphrase|passw|private|pwd|salt|"
    r"secret|session|sign|token",
    re.IGNORECASE | re.ASCII,
)
IDENTIFIERS = (
    "access_key_id secret_access_key client_id client_secret api_key private_key public_key password "
    "passphrase username authorization bearer token session_id refresh_token connection_string "
    "database_url import export return function class public static final const string integer "
    "boolean null true false default config settings environment production development "
    "http:// https:// localhost 127.0.0.1 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx example.com your_key_here changeme"
)
AROUND = 512  # characters of text on each side that prime the compressor
BEFORE = 64  # characters in front of a candidate that may announce it
NOVEL = 0.75  # marginal bytes per byte from which a candidate counts as incompressible: six bits
# Alphabets of encodings that hold less, with the bits a random character of theirs has.
ALPHABETS = [
    (re.compile(pattern), math.log2(size))
    for pattern, size in (
        (r"(0x)?([0-9A-F]+([_-][0-9A-F]+)*|[0-9a-f]+([_-][0-9a-f]+)*)", 16), (r"[0-9A-Fa-f]+", 22),
        (r"([A-Z2-7]+|[a-z2-7]+)=*", 32), (r"[A-Z0-9]+|[a-z0-9]+", 36), (r"[A-Za-z0-9]+", 62),
    )
]
NO_DASHES = str.maketrans("", "", "_=-")


class Span(NamedTuple):
    start: int
    rank: int  # place of the kind in KINDS
    end: int


def base_spans(text: str) -> list[Span]:
    """Spans of the three fixed patterns, by start and kind, in code points."""
    found = [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        found += [
            Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8
        ]
    return sorted(found)


def marginal_bytes(candidate: str, around: str) -> int:
    """Compressed bytes that a candidate adds to its surroundings and the identifiers."""
    primer = f"{IDENTIFIERS}\n{around}".encode()
    known = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(
        level=3, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return len(packer.compress(candidate.encode())) - len(packer.compress(b""))


def least_bytes(candidate: str) -> float:
    """Marginal bytes from which a candidate counts as incompressible, by its own alphabet."""
    for alphabet, bits in ALPHABETS:
        if alphabet.fullmatch(candidate):
            return bits / 8 * len(candidate.translate(NO_DASHES))
    return NOVEL * len(candidate)


def candidates(text: str, base: list[Span]) -> list[list[tuple[int, int]]]:
    """For each run of candidate characters its (start, end) outside the base spans, best first.

    The value alone, after the last '=' that is no padding, comes before the run with its name; the
    name may announce the value, as may the text in front of the run.
    """
    starts = [s.start for s in base]
    reach = list(accumulate((s.end for s in base), max))  # furthest end of the spans so far
    found = []
    for m in CANDIDATE.finditer(text):
        first, end = m.span()
        value = first + m[0].rstrip("=").rfind("=") + 1
        before = bisect_left(starts, end)
        found.append([
            (start, end)
            for start in sorted({value, first}, reverse=True)
            if end - start >= LEAST
            and not (before and reach[before - 1] > start)
            and MIXED.match(text, start, end)
            and SENSITIVE.search(text, max(0, first - BEFORE), start)
        ])
    return [spans for spans in found if spans]


def _novel(text: str, runs: list[list[tuple[int, int]]]) -> list[Span]:
    found = []
    for spans in runs:
        for start, end in spans:
            around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
            if marginal_bytes(text[start:end], around) >= least_bytes(text[start:end]):
                found.append(Span(start, 3, end))
                break
    return found


def novel_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates outside the base spans that stand in a sensitive context and do not compress."""
    return _novel(text, candidates(text, base))


def without(value: str, text: str, low: int, high: int) -> str:
    """The text from low to high less all copies of a value, also those that reach across an end."""
    parts, reach = [], high + len(value) - 1
    at = text.find(value, max(0, low - len(value) + 1), reach)
    while at >= 0:
        parts.append(text[low:at])
        low = at + len(value)
        at = text.find(value, low, reach)
    return "".join([*parts, text[low:high]])


def occurrences(text: str, values: set[str]) -> list[tuple[int, int]]:
    """(start, end) of all copies of the values, those of one value apart; one walk over the text."""
    if not values:
        return []
    known = ahocorasick.Automaton()
    for value in values:
        known.add_word(value, value)
    known.make_automaton()
    free, found = dict.fromkeys(values, 0), []
    for last, value in known.iter(text):
        start = last + 1 - len(value)
        if start >= free[value]:
            free[value] = last + 1
            found.append((start, last + 1))
    return found


def secret_spans(text: str, base: list[Span]) -> list[Span]:
    """Novel spans of the whole text, where copies of a candidate do not explain each other.

    Besides `novel_spans`: candidates that are novel once their copies are taken out of the
    surroundings, and all further copies of a novel string wherever they stand.
    """
    runs = candidates(text, base)
    found = {s.start: s for s in _novel(text, runs)}
    judged = {}
    for spans in runs:
        for start, end in spans:
            value = text[start:end]
            if start in found or value in judged and judged[value]:
                break
            low, high = max(0, start - AROUND), end + AROUND
            left, right = without(value, text, low, start), without(value, text, end, high)
            if len(left) + len(right) < start - low + len(text[end:high]):
                judged[value] = marginal_bytes(value, left + right) >= least_bytes(value)
                if judged[value]:
                    found[start] = Span(start, 3, end)
                    break
    copies = occurrences(text, {text[s.start : s.end] for s in found.values()})
    taken, nth, reach = sorted([*base, *found.values()]), 0, 0
    for at, end in sorted(copies, key=lambda c: (c[0], -c[1])):
        while nth < len(taken) and taken[nth].start <= at:
            reach = max(reach, taken[nth].end)
            nth += 1
        if reach <= at and (nth == len(taken) or end <= taken[nth].start):
            found[at] = Span(at, 3, end)
            reach = end
    return sorted(found.values())


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.rank]}:{s.start}:{s.end}" for s in spans)


def _scan_batches(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for text in batch.column(1):
            value = text.as_py() or ""
            base = base_spans(value)
            novel = secret_spans(value, base)
            for rank in range(4):
                out[rank].append(sum(s.rank == rank for s in (base if rank < 3 else novel)))
            out[4].append(hashlib.sha256(written(base).encode()).hexdigest())
            out[5].append(written(sorted(base + novel)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, type=pa.int64()) for x in out[:4]],
             *[pa.array(x, type=pa.string()) for x in out[4:]]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text, as counts and as spans kind:start:end in code points.

    Kinds assign, access and hex are fixed patterns (runs too short are no spans); novel are
    strings of 16 or more characters with letters and digits, near a word that announces a
    credential, whose bytes a compressor primed with the text around them (less their own copies)
    and common identifiers cannot save, and all copies of these in the text. Only
    texts decide; each row is judged by itself without a shuffle, in time linear in its length.

    Null text: as empty, no spans. Null and repeated ids: one row per row. Empty input: no rows.
    Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan_batches,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, "
        "base_sha256 string, spans string",
    )


def masked(text: str, mark: str) -> str:
    """The text with each maximal run of spans replaced by a mark."""
    base = base_spans(text)
    out, at = [], 0
    for span in sorted(base + secret_spans(text, base)):
        if span.start >= at:
            out += [text[at : span.start], mark]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, mark: str = "[removed]") -> DataFrame:
    """The same rows and columns with secrets masked in `text`, and `n_chars` set where it is there.

    Null texts stay null. Overlapping spans share a mark.
    """
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            new = [None if t is None else masked(t, mark) for t in texts]
            columns[at] = pa.array(new, type=columns[at].type)
            if counted is not None:
                old = columns[counted].to_pylist()
                columns[counted] = pa.array(
                    [o if a == b else len(b) for o, a, b in zip(old, texts, new, strict=True)],
                    type=columns[counted].type,
                )
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
