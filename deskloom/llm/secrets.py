"""Secrets in texts, by patterns and by assignment-aware lexing.

The patterns of the base kinds find literal forms of secrets. The lexer reads
the assignments of source code and configuration files (`name = "literal"`,
`name: literal`, `"name": "literal"`, `name => literal`, `<name>literal</name>`,
`--name literal`) as pairs of name and literal. A name given as a value stands for its literal
wherever the constant is defined, through chains of any length. A literal is
scored by the names it reaches, part by part (`dbPassword`, `DB_PASS`), and by
how random it looks; enough makes a span of kind `literal` at the literal
itself, unless a base span covers it.

Cases: null and empty texts have no spans. A match whose value is too short is
dropped and not searched again. A name defined more than once stands for all its
literals; circular definitions end. Repeated rows give equal results. An empty
table gives an empty result. Further columns are ignored. Texts are read whole,
positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

# The base kinds in their order, patterns and least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ["assign", "access", "hex", "literal"]

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
# A maximal run of at least HEX_LEAST is what HEX finds and does not drop.
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)

NAME = r"[A-Za-z_$][\w$.-]{0,80}"
LITERAL = r"""(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([^\s"'`<>,;(){}\[\]]+))"""
# The sign of an assignment comes first in a cheap test: without one there is nothing to lex.
_PAIR = re.compile(
    rf"""(?<![\w$.-])({NAME})["']?\]?[ \t]*(?:=>|:=|[=:](?![=:/]))[ \t]*{LITERAL}""",
    re.ASCII,
)
_ELEMENT = re.compile(rf"<({NAME})>\s*()()()([^<>\s]+)\s*</", re.ASCII)
_OPTION = re.compile(rf"(?<![\w-])--({NAME})[ \t]+{LITERAL}", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_REFERENCE = re.compile(rf"\$?\{{?({NAME})\}}?$", re.ASCII)

# Weight of a part of a name, and of two parts in a row.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "secrets": 3,
    "token": 3, "credential": 3, "credentials": 3, "apikey": 3, "privatekey": 3, "auth": 1, "bearer": 2,
    "key": 1, "salt": 1, "signature": 1, "pin": 1,
}
PAIRED = {("api", "key"): 2, ("private", "key"): 2, ("access", "key"): 2, ("signing", "key"): 2, ("encryption", "key"): 2}
HARMLESS = {"public", "length", "len", "count", "name", "type", "url", "path", "file", "field", "expiry", "ttl", "hint", "min", "max"}
EMPTY = {"none", "null", "nil", "true", "false", "undefined", "changeme", "example", "placeholder", "redacted", "required"}
NEEDED = 5  # points of name and literal together


def sensitivity(name: str) -> int:
    """Points of a name: how clearly it says that its value is secret."""
    parts = [part.lower() for part in _PARTS.findall(name)]
    points = max((SENSITIVE.get(part, 0) for part in parts), default=0)
    points += max((PAIRED.get(pair, 0) for pair in zip(parts, parts[1:], strict=False)), default=0)
    return 0 if parts and parts[-1] in HARMLESS or "public" in parts else points


def randomness(literal: str) -> int:
    """Points of a literal, 0 to 4: length, kinds of characters, entropy."""
    if len(literal) < 6 or literal.lower() in EMPTY or len(set(literal)) < 4 or literal.startswith(("${", "{{", "<")):
        return 0
    kinds = sum(bool(re.search(kind, literal)) for kind in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    entropy = -sum(n / len(literal) * log2(n / len(literal)) for n in Counter(literal).values())
    points = (kinds >= 2) + (kinds >= 3) + (entropy >= 3) + (len(literal) >= 16 and entropy >= 3.5)
    return points if kinds >= 2 or len(literal) >= 20 and entropy >= 3.5 else 0


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def pairs(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, literal, start, end, quoted) of every assignment, in text order."""
    found = []
    if "=" in text or ":" in text:
        found += list(_PAIR.finditer(text))
    if "</" in text:
        found += list(_ELEMENT.finditer(text))
    if "--" in text:
        found += list(_OPTION.finditer(text))
    made = []
    for match in found:
        group = next((i for i in (2, 3, 4, 5) if match[i]), None)
        if group:
            made.append((match[1], match[group], *match.span(group), group < 5))
    return sorted(made, key=lambda pair: pair[2])


def lexed(text: str) -> list[tuple[int, int]]:
    """(start, end) of the literals that reach sensitive names."""
    found = pairs(text)
    if not found:
        return []
    targets: dict[str, set[str]] = {}  # name -> names its value is given to
    for name, literal, _, _, quoted in found:
        reference = None if quoted else _REFERENCE.match(literal)
        if reference:
            targets.setdefault(reference[1], set()).add(name)
    points = {name: sensitivity(name) for name, *_ in found}
    waiting = [name for name, n in points.items() if n]
    sources: dict[str, set[str]] = {}
    for source, names in targets.items():
        for name in names:
            sources.setdefault(name, set()).add(source)
    while waiting:
        name = waiting.pop()
        for source in sources.get(name, ()):
            if points.get(source, 0) < points[name]:
                points[source] = points[name]
                waiting.append(source)
    defined = {name for name, *_ in found}
    spans = []
    for name, literal, start, end, quoted in found:
        own = points[name]
        if own < 2 or not quoted and (reference := _REFERENCE.match(literal)) and reference[1] in defined:
            continue
        if randomness(literal) and own + randomness(literal) >= NEEDED:
            spans.append((start, end))
    return sorted(set(spans))


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, as (start, kind, end)."""
    sure = base(text)
    more = []
    for start, end in lexed(text):
        if not any(a < end and start < b for a, _, b in sure):
            more.append((start, 3, end))
    return sure, sorted(sure + more)


def scan(documents: DataFrame) -> DataFrame:
    """(id, base, found) of every row (id, text): base spans, and all, by start and kind."""
    span = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = lambda found: [{"kind": KINDS[kind], "first": a, "last": b} for a, kind, b in found]
        for batch in batches:
            both = [spans(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([shown(sure) for sure, _ in both], pa.list_(span)),
                    pa.array([shown(every) for _, every in both], pa.list_(span)),
                ],
                ["id", "base", "found"],
            )

    kind = "array<struct<kind: string, first: long, last: long>>"
    return documents.select("id", "text").mapInArrow(run, f"id long, base {kind}, found {kind}")
