"""Patterns rewritten for the checking engine.

Its regular expressions know only ASCII word boundaries and classes, so the
Unicode meaning is spelled out.  Look-ahead free patterns only.
"""

from __future__ import annotations

import re

_LEFT = r"(?:^|[^\pL\pN_])"
_RIGHT = r"(?:$|[^\pL\pN_])"


def uni(pattern: str) -> str:
    """``\\b`` before a word character becomes a left edge, after one a right edge."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            rest = pattern[i + 2:]
            before = "".join(out)
            at_start = before == "" or before.endswith("|") or before.endswith("(?:") or before.endswith("(")
            out.append(_LEFT if at_start and rest and rest[0] not in ")|" else _RIGHT)
            i += 2
        elif pattern.startswith(r"\s", i):
            out.append(r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
            i += 2
        elif pattern.startswith(r"\d", i):
            out.append(r"\p{Nd}")
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(column: str, patterns: list[str]) -> str:
    alternatives = "|".join(uni(p) for p in patterns)
    return f"regexp_matches({column}, {lit('(?i)(?:' + alternatives + ')')})"


def case(column: str, rules: dict[str, list[str]], default: str | None = None) -> str:
    whens = " ".join(f"WHEN {matches(column, p)} THEN {lit(label)}" for label, p in rules.items())
    tail = f" ELSE {lit(default)}" if default else ""
    return f"CASE {whens}{tail} END"


def contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def case_contains(column: str, rules: dict[str, list[str]]) -> str:
    whens = " ".join(f"WHEN {contains_any(column, w)} THEN {lit(label)}" for label, w in rules.items())
    return f"CASE {whens} END"
