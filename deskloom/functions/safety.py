"""Rule expressions for prompt injection and personal data."""

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from deskloom import fixed, kernels


def gate_text(text: Column) -> Column:
    """Lower-case form for the literal gates.

    Both Turkish i's fold to "i", as they do in case-insensitive matching.
    """
    return F.lower(F.translate(text, "İı", "ii"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _possible(rules):
    literals = None

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def possible(lowered: pa.Array) -> pa.Array:
        nonlocal literals
        if literals is None:  # once per worker
            literals = kernels.Literals([rule[3] for rule in rules])
        return pa.array([literals.possible(text or "") for text in lowered.to_pylist()], pa.list_(pa.int32()))

    return possible


_possible_of_fixed_rules = _possible(fixed.INJECTION_RULES)


def possible_rules(lowered: Column, rules=fixed.INJECTION_RULES) -> Column:
    """Numbers of the rules whose literals a text has: one pass of an automaton over
    the gate text finds the literals of all rules.

    Nearly every text is spared nearly all of the single patterns. A rule that is
    possible is judged by its exact pattern.
    """
    test = _possible_of_fixed_rules if rules is fixed.INJECTION_RULES else _possible(rules)
    return test(lowered)


def _matched(text: str, possible: str, rules, value: int) -> Column:
    # One SQL text instead of some thousand calls into the JVM.
    hits = ", ".join(
        f"CASE WHEN array_contains({possible}, {number}) AND rlike({text}, {_quoted('(?iUs)' + rule[2])}) "
        f"THEN {_quoted(rule[value])} END"
        for number, rule in enumerate(rules)
    )
    return F.expr(f"array_compact(array({hits}))")


def injection_reasons(text: str, possible: str, rules=fixed.INJECTION_RULES) -> Column:
    """Reasons of all matching rules, in rule order, repeats kept, from the
    columns with the normalised text and the numbers of its possible rules.

    Patterns are constants, so each compiles once per task, and each runs on the
    texts in which its rule is possible.
    """
    return _matched(text, possible, rules, 1)


def injection_families(text: str, possible: str, rules=fixed.INJECTION_RULES) -> Column:
    return F.array_distinct(_matched(text, possible, rules, 0))


_RULE = {name: (pattern, fold, mark) for name, pattern, fold, mark in fixed.PII_RULES}


def pii_pattern(name: str) -> str:
    pattern, fold, _ = _RULE[name]
    return ("(?iU)" if fold else "(?U)") + pattern


# A necessary condition per group of types, cheaper than their patterns. Every
# number type holds four digits in a row.
GATES = {
    "at": lambda text: F.contains(text, F.lit("@")),
    "digits": lambda text: F.rlike(text, F.lit(r"(?U)\d{4}")),
    "dotted": lambda text: F.rlike(text, F.lit(r"(?U)\d\.\d")),
    "dated": lambda text: F.rlike(text, F.lit(r"(?U)\d[/\-]\d")),
}
_GATE_OF = {"email": "at", "ip_address": "dotted", "date_of_birth": "dated"}


def pii_gates(text: Column) -> Column:
    """All gates of a text as one struct, to be computed once per row."""
    return F.struct(*[gate(text).alias(name) for name, gate in GATES.items()])


def has_pii(name: str, text: Column, gates: Column) -> Column:
    return gates[_GATE_OF.get(name, "digits")] & F.rlike(text, F.lit(pii_pattern(name)))


def mask(name: str, text: Column) -> Column:
    pattern, _, placeholder = _RULE[name]
    placeholder = placeholder or fixed.STRICT_PLACEHOLDERS[name]
    return F.regexp_replace(text, F.lit(pii_pattern(name)), F.lit(placeholder))


def mask_cards(text: Column, gates: Column) -> Column:
    return F.when(has_pii("credit_card", text, gates), mask("credit_card", text)).otherwise(text)


def pii_types(text: Column, cards_masked: Column, gates: Column) -> Column:
    """Types found, in rule order. Cards are masked before the other nine
    patterns run, so that a spaced card number is not also a shorter number."""
    hits = [
        F.when(has_pii(name, text if name == "credit_card" else cards_masked, gates), F.lit(name))
        for name, *_ in fixed.PII_RULES
    ]
    return F.array_compact(F.array(*hits))


def redact(text: Column, strict: bool = False) -> Column:
    """Replace personal data by placeholders, one type after the other.

    By default addresses of machines and dates of birth stay, as they are only
    detected; strict masks them too.
    """
    masked = text
    for name, _, _, placeholder in fixed.PII_RULES:
        if placeholder or strict:
            masked = mask(name, masked)
    names = ["at", "digits", "dotted", "dated"] if strict else ["at", "digits"]
    worth = reduce(lambda a, b: a | b, [GATES[g](text) for g in names])
    return F.when(worth, masked).otherwise(text)


def pii_values(text: Column, types=None) -> Column:
    """All personal-data values of a text, over all types."""
    names = types or [name for name, *_ in fixed.PII_RULES]
    empty = F.array().cast("array<string>")
    found = [
        F.when(GATES[_GATE_OF.get(n, "digits")](text), F.regexp_extract_all(text, F.lit(pii_pattern(n)), F.lit(0))).otherwise(empty)
        for n in names
    ]
    return F.array_distinct(F.concat(*found))
