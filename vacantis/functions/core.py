"""Small helpers shared by all column functions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

# Case-insensitive with Unicode word boundaries and classes.
UNICODE_CI = "(?iU)"
CI = "(?i)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: Column | str) -> Column:
    """Empty text counts as missing."""
    return F.nullif(col(c), F.lit(""))


def spread_nulls(key: Column | str, by: Column | str) -> Column:
    """A text key for a left join in which missing keys meet nothing and do not all go to one partition:
    each becomes a value of its own, made from another column."""
    return F.coalesce(col(key), F.concat(F.lit("\u0000"), F.xxhash64(col(by)).cast("string")))


def is_blank(c: Column | str) -> Column:
    """Null or empty (F3); never null."""
    c = col(c)
    return c.isNull() | (c == "")


def truthy_num(c: Column | str) -> Column:
    """Zero counts as missing."""
    return F.nullif(col(c), F.lit(0))


def has_items(c: Column | str) -> Column:
    """True when the array has at least one element; null arrays give false."""
    return F.coalesce(F.size(col(c)) > 0, F.lit(False))


def any_of(patterns: Iterable[str], flags: str = UNICODE_CI) -> str:
    """One alternation for a list of patterns."""
    return flags + "(?:" + "|".join(patterns) + ")"


# Rule lists longer than this are evaluated through :func:`once`.
_INLINE_RULES = 8


def once(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed one time.

    A plain expression that uses ``value`` in many branches repeats it in each
    of them when Catalyst merges projections or pushes filters down (a JSON
    parse per keyword), and long rule lists outgrow the size limit of a
    generated method.  A one-element ``transform`` binds the value instead.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def _ladder(rules: Mapping[str, list[str]], test):
    def build(text: Column) -> Column:
        out = None
        for label, values in rules.items():
            hit = test(text, values)
            out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
        return out
    return build


# Letters that Unicode matching without case treats as i, k and s.
_ODD, _EVEN = "\u0130\u0131\u212a\u017f", "iiks"


def fold(text: Column) -> Column:
    """Lower case for matching without case: one pass instead of one per pattern."""
    return F.lower(F.translate(text, _ODD, _EVEN))


def needle(pattern: str) -> tuple[str, bool]:
    """Longest literal every match of ``pattern`` contains, and whether it is all of it.

    Anything but plain characters ends a literal; a quantified character is
    not part of it.  An empty needle means that no literal is certain.
    """
    runs, run, i, pure, depth = [], "", 0, True, 0
    while i < len(pattern):
        c = pattern[i]
        step, char = 1, None
        if c == "\\":
            step = 2
            char = pattern[i + 1] if not pattern[i + 1].isalnum() else None
        elif c == "[":
            step = pattern.index("]", i + 2) - i + 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return "", False
        elif c not in ".^$|?*+{}":
            char = c
        nxt = pattern[i + step] if i + step < len(pattern) else ""
        if char is not None and depth == 0 and nxt not in ("?", "*", "{"):
            run += char
        else:
            pure = False
            runs.append(run)
            run = ""
        i += step
    runs.append(run)
    return max(runs, key=len), pure


def folded_match(text: Column, patterns: Iterable[str]) -> Column:
    """Does folded ``text`` match one of the lower-case patterns?

    A byte search for the certain literal of a pattern comes first; the
    regular expression runs only on texts that have it, and not at all for a
    pattern that is a plain word.
    """
    out = None
    for p in patterns:
        word, pure = needle(p)
        hit = text.contains(word) if pure else text.rlike("(?U)" + p)
        if word and not pure:
            hit = text.contains(word) & hit
        out = hit if out is None else out | hit
    return out


def first_label(text: Column, rules: Mapping[str, list[str]]) -> Column:
    """Ordered first-match classification without case."""
    return once(fold(text), _ladder(rules, folded_match))


def _any_word(text: Column, words: Iterable[str]) -> Column:
    out = None
    for w in words:
        hit = text.contains(w)
        out = hit if out is None else out | hit
    return out


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when the text contains one of the literal words."""
    words = list(words)
    if len(words) <= _INLINE_RULES:
        return _any_word(text, words)
    return once(text, lambda t: _any_word(t, words))


def first_contained(text: Column, rules: Mapping[str, list[str]]) -> Column:
    """Ordered first-match over literal words."""
    return once(text, _ladder(rules, _any_word))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match or null (``regexp_extract`` gives '' for no match)."""
    return nz(F.regexp_extract(text, pattern, group))


def first_extract(text: Column, patterns: Iterable[str], group: int = 1, flags: str = "") -> Column:
    """First non-empty extraction over an ordered pattern list."""
    return F.coalesce(*[extract(text, flags + p, group) for p in patterns])


def literal_map(values: Mapping[str, str]) -> Column:
    flat = []
    for k, v in values.items():
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def title_case(c: Column) -> Column:
    """A capital at the start of every run of letters, small letters behind it."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda x: F.initcap(x)), "")


def iso(c: Column | str) -> Column:
    """Timestamp as sortable text."""
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def ts(value) -> Column:
    """A reference time given as text, datetime or column."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def ago(as_of, **units) -> Column:
    """``as_of`` minus days / hours."""
    return ts(as_of) - F.make_interval(
        days=F.lit(int(units.get("days", 0))), hours=F.lit(int(units.get("hours", 0))))
