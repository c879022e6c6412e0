"""Find secrets in texts: fixed patterns, and literals that are assigned to sensitive names.

Texts that name something sensitive are read as source or configuration: strings, names and operators
become name-value pairs, names that stand for a literal are followed to it, and a literal is scored by
the name it ends up under and by its own look. Such a literal is reported where no pattern has
reported it already.

Defined results: a null text has no findings; every row gets one row; an empty table gives none;
positions are code points, the end is exclusive; other columns of the input do not matter.
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

# Kinds in the order of the report; the patterns are fixed values.
KINDS = ("assign", "access", "hex", "literal")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

# How much a part of a name says about what is kept under it.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.8,
    "secret": 1.0,
    "token": 0.8,
    "apikey": 1.0,
    "credential": 0.9,
    "privatekey": 1.0,
    "accesskey": 0.9,
    "clientkey": 0.8,
    "authkey": 0.8,
    "bearer": 0.7,
}
SENSITIVE_HINT = re.compile("|".join(("pass", "pwd", "secret", "token", "key", "credential", "bearer")))
LEAST_SCORE = 0.5
PLACEHOLDERS = {"changeme", "example", "placeholder", "redacted", "undefined", "your_password", "password"}

# A quote starts a string if an unescaped one of its kind follows on the line; see ``_tokens``.
TOKEN = re.compile(
    r"""(?P<quote>["'])
      | (?P<string>`[^`\n]*`)
      | (?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)
      | (?P<set>:=|=>|={1,3}|:)
      | (?P<join>\+|\|\|)
      | (?P<bare>[^\s"'`=:+,;(){}\[\]<>]+)
      | (?P<end>[\n,;(){}\[\]<>])""",
    re.VERBOSE | re.ASCII,
)
ESCAPE_OR_QUOTE = re.compile(r"""\\[^\n]|["'\n]""")


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all tokens.

    One pass marks the quotes that are not escaped and the line ends. Whether a quote is escaped does
    not depend on where a string starts, as no string starts within a run of backslashes. So every
    string's end is looked up, not searched for, and the text is read twice in all.
    """
    open_quotes: dict[str, list[int]] = {'"': [], "'": [], "\n": []}
    for m in ESCAPE_OR_QUOTE.finditer(text):
        if len(m[0]) == 1:
            open_quotes[m[0]].append(m.start())
    lines, tokens, at = open_quotes["\n"], [], 0
    while m := TOKEN.search(text, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "quote":
            same = open_quotes[text[start]]
            close, line = bisect_right(same, start), bisect_right(lines, start)
            if close == len(same) or (line < len(lines) and lines[line] < same[close]):
                continue
            kind, at = "string", same[close] + 1
        tokens.append((kind, start, at))
    return tokens


def _flat(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def name_weight(name: str) -> float:
    flat = _flat(name)
    return max((w for part, w in SENSITIVE.items() if part in flat), default=0.0)


def literal_weight(text: str) -> float:
    """0 to 1: long, mixed and without spaces looks like a secret."""
    if len(text) < 8 or re.search(r"\s|[<{]|\$[({]", text) or text.lower() in PLACEHOLDERS or len(set(text)) < 5:
        return 0.0
    bits = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
    kinds = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 4) * (0.4 + 0.2 * kinds if kinds < 3 else 1.0)


def _statements(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Target names with the parts of their values: (kind, start, end); kind is string, bare or name."""
    tokens = _tokens(text)
    i = 0
    while i + 2 < len(tokens):
        kind, start, end = tokens[i]
        if kind not in ("name", "string") or tokens[i + 1][0] != "set":
            i += 1
            continue
        target = text[start:end].strip("\"'`")
        # A type between name and value, as in `name: Type = value`.
        j = i + 2
        if text[tokens[i + 1][1]] == ":" and tokens[j][0] == "name" and j + 1 < len(tokens):
            j += 2 if tokens[j + 1][0] == "set" and text[tokens[j + 1][1]] == "=" else 0
        parts = []
        while j < len(tokens) and tokens[j][0] in ("string", "bare", "name"):
            part, a, b = tokens[j]
            parts.append((part, a + 1, b - 1) if part == "string" else (part, a, b))
            if j + 1 < len(tokens) and tokens[j + 1][0] == "join":
                j += 2
            else:
                break
        yield target, parts
        # A value may be the target of the next pair, as in `a = b = "x"`.
        i = j if parts and j + 1 < len(tokens) and tokens[j + 1][0] == "set" else max(j, i + 2)


def assigned_literals(text: str) -> list[tuple[int, int, str, float]]:
    """Literals under sensitive names: start, end, name, score. Names are followed to their literals.

    Of several names that reach a literal the one that says most counts, the first of equals. Names are
    taken in that order, so what one has reached is settled and each name is followed once.
    """
    values: dict[str, list[tuple[str, int, int]]] = {}
    wanted = []
    for target, parts in _statements(text):
        values.setdefault(target, []).extend(parts)
        if weight := name_weight(target):
            wanted.append((target, weight, parts))
    found: dict[tuple[int, int], tuple[str, float]] = {}
    followed, judged = set(), set()
    for target, weight, parts in sorted(wanted, key=lambda w: -w[1]):
        todo = list(parts)
        while todo:
            kind, a, b = todo.pop()
            if (a, b) in judged:
                continue
            judged.add((a, b))
            part = text[a:b]
            if kind == "name" and part in values:
                if part not in followed:
                    followed.add(part)
                    todo.extend(values[part])
                continue
            # A bare word is a literal only if it does not read as a word.
            if kind == "name" and not re.search("[0-9]", part):
                continue
            score = weight * literal_weight(part) * (1.0 if kind == "string" else 0.8)
            if score >= LEAST_SCORE:
                found[a, b] = (target, score)
    return [(a, b, name, score) for (a, b), (name, score) in found.items()]


def findings(text: str) -> list[dict]:
    """All findings of a text, by start and then kind."""
    low = text.lower()
    spans = []
    if any(name in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
                spans.append((m.start(), 0, m.end(), m[1], 1.0))
    if "AKIA" in text:
        spans.extend((m.start(), 1, m.end(), None, 1.0) for m in ACCESS.finditer(text))
    spans.extend((m.start(), 2, m.end(), None, 1.0) for m in HEX.finditer(text))
    if ("=" in text or ":" in text) and SENSITIVE_HINT.search(low):
        base = sorted(spans, key=lambda s: s[0])
        starts, ends = [s[0] for s in base], list(accumulate((s[2] for s in base), max))
        for a, b, name, score in assigned_literals(text):
            before = bisect_left(starts, b)
            if not before or ends[before - 1] <= a:
                spans.append((a, 3, b, name, score))
    return [
        {"kind": KINDS[k], "start": a, "end": b, "name": name, "score": score}
        for a, k, b, name, score in sorted(spans, key=lambda s: s[:3])
    ]


FINDING = "array<struct<kind: string, start: int, end: int, name: string, score: double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())])
    )
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows = batch.slice(at, 1000)
            found = [findings(t or "") for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, kind)], names=["doc_id", "findings"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and its findings, by start and then kind."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_scan, f"doc_id long, findings {FINDING}")


def _joined(found: Column) -> Column:
    return F.concat_ws(
        ",", F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts of the patterns' findings, their digest, and all spans as text."""
    found = F.col("findings")
    count = lambda kind: F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")
    base = F.filter(found, lambda f: f["kind"] != "literal")
    return find_secrets(docs).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(found).alias("spans"),
        count("literal").alias("n_literal"),
    )
