"""Secrets in texts: fixed forms, and random-looking strings by sliding-window entropy."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from riskloom.llm.common import row_wise, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Kind, alphabet, window and least bits per character of a random-looking string.  20 random characters of 62 have 4.0
#: bits on average, with a deviation of 0.15.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 2.9),
    ("entropy_mixed", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.65),
)
#: Strings that look random but are no secrets.  Whole strings: words and numbers between separators.
ALLOWED = re.compile(r"[+/_=-]*(?:(?:[a-z]+[0-9]{0,4}|[0-9]+)(?:[+/_=-]+|$))*", re.IGNORECASE)
#: Pieces between separators, cut out of the string around them: identifiers of public objects and fillers.
CUT = re.compile(r"""(?<![A-Za-z0-9])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![A-Za-z0-9])
    |(?<![A-Za-z0-9])(?=[A-Za-z0-9]*?(?:example|sample|dummy|placeholder|xxxx|abcdefgh|12345678|deadbeef))[A-Za-z0-9]+""", re.IGNORECASE | re.VERBOSE)
ORDER = {"assign": 0, "access": 1, "hex": 2, "entropy_hex": 3, "entropy_mixed": 4}


def window_entropy(s: str, width: int) -> list[float]:
    """Shannon entropy in bits per character of every window, counts moving by one character."""
    if len(s) < width:
        return []
    part = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts = Counter(s[:width])
    total = sum(part[c] for c in counts.values())
    out = [math.log2(width) - total / width]
    for old, new in zip(s, s[width:]):
        if old != new:
            total += part[counts[old] - 1] - part[counts[old]]
            counts[old] -= 1
            total += part[counts[new] + 1] - part[counts[new]]
            counts[new] += 1
        out.append(math.log2(width) - total / width)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _uncut(run: str) -> list[tuple[int, str]]:
    """(start, string) of what is left of a candidate run around the pieces of ``CUT``."""
    out, at = [], 0
    for m in CUT.finditer(run):
        out.append((at, run[at : m.start()]))
        at = m.end()
    return [*out, (at, run[at:])]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Runs of windows at or over the threshold of their character class, allowed strings left out.

    A string of mixed classes must hold digits and letters.
    """
    found = []
    for c in CANDIDATE.finditer(text):
        for begin, s in _uncut(c[0]):
            if ALLOWED.fullmatch(s):
                continue
            taken: list[tuple[int, int]] = []
            for kind, alphabet, width, least in CLASSES:
                for m in alphabet.finditer(s):
                    if ALLOWED.fullmatch(m[0]) or any(a < m.end() and m.start() < b for a, b in taken):
                        continue
                    high = [i for i, e in enumerate(window_entropy(m[0], width)) if e >= least]
                    if not high or kind == "entropy_mixed" and not (any(x.isdigit() for x in m[0]) and any(x.isalpha() for x in m[0])):
                        continue
                    a, b = m.start() + high[0], m.start() + high[-1] + width
                    taken.append((a, b))
                    found.append((c.start() + begin + a, c.start() + begin + b, kind))
    return found


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, base and entropy spans), each by start, then kind; code points, end exclusive.

    An entropy span inside a base span adds nothing and is left out.
    """
    order = lambda x: (x[0], ORDER[x[2]], x[1])
    base = sorted(base_spans(text), key=order)
    more = [s for s in entropy_spans(text) if not any(a <= s[0] and s[1] <= b for a, b, _ in base)]
    return base, sorted(base + more, key=order)


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b, _ in all_spans(text)[1]:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


SPANS = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, counts of fixed forms, a digest of their spans, and all spans of each row.

    A null or empty text has no spans; the digest is then that of the empty string.
    """
    def compute(batches):
        for batch in batches:
            rows = []
            for x in texts(batch, text):
                base, every = all_spans(x)
                n = Counter(kind for _, _, kind in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            yield [list(c) for c in zip(*rows)] or [[] for _ in SPANS]

    return row_wise(docs, keep, text, SPANS, compute)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; null stays null."""
    columns = docs.columns

    def compute(batches):
        for batch in batches:
            nulls = batch.column(batch.schema.get_field_index(text)).is_null().to_pylist()
            yield [[None if n else redact_text(x, mark) for n, x in zip(nulls, texts(batch, text))]]

    return row_wise(docs, columns, text, {text: "string"}, compute).select(*[f"`{c}`" for c in columns])
