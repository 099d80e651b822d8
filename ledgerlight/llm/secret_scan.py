"""Secret scans: known forms, and sliding-window entropy over candidate strings.

A candidate is a run of 20 or more characters of the base64 and identifier
alphabets. A window of WINDOW characters moves over it; its Shannon entropy is
kept up by counts, of which one goes down and one goes up at each step, so a
candidate costs time in proportion to its length whatever the window. The
window's character class sets the entropy it must reach: hex digits, digits and
letters of one case without separators (as in base36 and base32), or both cases
and digits. Windows without a digit or without a letter do not count, and those
of one case not with a separator, as names and paths have. Windows that reach it
are merged into spans. Candidates on the allow-list (paths, identifiers of
words, UUIDs) give none, nor do windows that hold a whole placeholder or run.

Defined cases: null text counts as empty and has no span; spans of one kind
never overlap; spans of different kinds may; positions are code points, end
exclusive; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlight.llm.common import small

#: The forms of known secrets, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits a character that a window must reach, by character class.
HEX_BITS, ONE_CASE_BITS, MIXED_BITS = 3.0, 3.6, 3.7
#: Allow-list: whole candidates that are no secrets.
ALLOWED = re.compile(
    r"""[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}  # UUID
    | [0-9-]+                                                 # numbers, dates, phone numbers
    | (?:[A-Z]?[a-z]+[0-9]{0,2}|[A-Z]+|[0-9]{1,4})(?:[/_=+-]+(?:[A-Z]?[a-z]+[0-9]{0,2}|[A-Z]+|[0-9]{1,4}))*[/_=+-]*  # paths and names made of words
    """,
    re.VERBOSE,
)
#: Overlapping ones are all found.
PLACEHOLDER = re.compile(r"(?=(example|placeholder|changeme|redacted|xxxx|0000|abcdef|123456|lorem))", re.IGNORECASE)
STEP = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 2)]  # a character comes in before one goes
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def entropy_windows(text: str, width: int = WINDOW) -> Iterator[tuple[int, float]]:
    """(start, bits a character) of each window, by counts kept up from one to the next."""
    counts: dict[str, int] = {}
    weight = 0.0  # sum of n * log2(n)
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        weight += STEP[n + 1] - STEP[n]
        if i >= width:
            old = text[i - width]
            n = counts[old]
            counts[old] = n - 1
            weight += STEP[n - 1] - STEP[n]
        if i >= width - 1:
            yield i - width + 1, math.log2(width) - weight / width


def least_bits(hex_only: bool, upper: int, lower: int, digit: int) -> float:
    """What a window with so many letters and digits must reach."""
    if hex_only:
        return HEX_BITS
    if upper and lower:
        return MIXED_BITS
    return ONE_CASE_BITS if upper + lower + digit == WINDOW else math.inf


def entropy_spans(text: str) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if ALLOWED.fullmatch(s):
            continue
        placeholders, begun = PLACEHOLDER.finditer(s), {}  # of those that have begun, by their ends
        following = next(placeholders, None)
        held = -1  # where the last whole placeholder so far begins
        other = digit = upper = lower = 0  # of the window, kept up like the counts
        windows = entropy_windows(s)
        for i, c in enumerate(s):
            for j, sign in ((i, 1), (i - WINDOW, -1)):
                if j >= 0:
                    c = s[j]
                    other += sign * (c not in HEX_DIGITS)
                    digit += sign * c.isdigit()
                    upper += sign * ("A" <= c <= "Z")
                    lower += sign * ("a" <= c <= "z")
            while following and following.start(1) <= i:
                begun[following.end(1)] = following.start(1)
                following = next(placeholders, None)
            held = max(held, begun.pop(i + 1, -1))
            if i < WINDOW - 1:
                continue
            start, bits = next(windows)
            if held >= start or not digit or not upper + lower:
                continue
            if bits >= least_bits(not other, upper, lower, digit):
                a, b = m.start() + start, m.start() + i + 1
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
    return spans


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    if not text:
        return []
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += [("entropy", *x) for x in entropy_spans(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            spans = find_secrets(text)
            base = [x for x in spans if x[0] != "entropy"]
            kinds = [x[0] for x in base]
            rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the known forms, digest of their spans, all spans: one row for each row of docs."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str | None, mask: str) -> str | None:
    """The text with every secret replaced; overlapping and touching spans become one."""
    if not text:
        return text
    out, at, end = [], 0, -1
    for _, a, b in find_secrets(text):
        if a > end:
            out += [text[at:a], mask]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in column text masked and n_chars, where there is one, counted anew; no row goes."""
    has_count = "n_chars" in docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [masked(x, mask) for x in batch.column("text").to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(texts, pa.string())
            if has_count:
                counts = [n if x is None else len(x) for x, n in zip(texts, batch.column("n_chars").to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(rewrite, docs.schema)
