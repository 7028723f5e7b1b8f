"""Dates, ages and freshness."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import col, once, ts

# Shape of the text → formats to try.  A format is only tried on text of its
# shape, since a failing parse costs an exception inside the parser.  The
# weekday of mail dates is removed first.
_CLOCK = r"\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
DATE_FORMATS = [
    (rf"^\d{{4}}-\d{{2}}-\d{{2}}[T ]{_CLOCK} ?(Z|[+-]\d{{2}}:\d{{2}})$", ["yyyy-MM-dd['T'][ ]H:mm[:ss][.SSSSSS][ ]XXX"]),
    (rf"^\d{{4}}-\d{{2}}-\d{{2}}[T ]{_CLOCK} ?[+-]\d{{4}}$", ["yyyy-MM-dd['T'][ ]H:mm[:ss][.SSSSSS][ ]XX"]),
    (rf"^\d{{4}}-\d{{2}}-\d{{2}}[T ]{_CLOCK}", ["yyyy-MM-dd['T'][ ]H:mm[:ss][.SSSSSS]"]),
    (r"^\d{4}-\d{2}-\d{2}$", ["yyyy-MM-dd"]),
    (r"^\d{8}$", ["yyyyMMdd"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", ["d MMM yyyy HH:mm:ss Z"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [A-Z]+$", ["d MMM yyyy HH:mm:ss z"]),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", ["MMM d[,] yyyy"]),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4}$", ["MMMM d[,] yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3},? \d{4}$", ["d MMM[,] yyyy"]),
    (r"^\d{1,2} [A-Za-z]{4,},? \d{4}$", ["d MMMM[,] yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3},? \d{2}$", ["d MMM[,] yy"]),
    (r"^\d{1,2} [A-Za-z]{4,},? \d{2}$", ["d MMMM[,] yy"]),
    (r"^[A-Za-z]{3},? \d{4}$", ["MMM[,] yyyy"]),
    (r"^[A-Za-z]{4,},? \d{4}$", ["MMMM[,] yyyy"]),
    (r"^[A-Za-z]{3} \d{1,2} \d{1,2}:\d{2}:\d{2} \d{4}$", ["MMM d H:mm:ss yyyy"]),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4},? \d{1,2}:\d{2}(:\d{2})?$", ["MMM d[,] yyyy[,] H:mm[:ss]"]),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4},? \d{1,2}:\d{2}(:\d{2})?$", ["MMMM d[,] yyyy[,] H:mm[:ss]"]),
    (r"^\d{1,2} [A-Za-z]{3},? \d{4},? \d{1,2}:\d{2}(:\d{2})?$", ["d MMM[,] yyyy[,] H:mm[:ss]"]),
    (r"^\d{1,2} [A-Za-z]{4,},? \d{4},? \d{1,2}:\d{2}(:\d{2})?$", ["d MMMM[,] yyyy[,] H:mm[:ss]"]),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4},? \d{1,2}:\d{2}(:\d{2})? [AaPp][Mm]$", ["MMM d[,] yyyy[,] h:mm[:ss] a"]),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4},? \d{1,2}:\d{2}(:\d{2})? [AaPp][Mm]$", ["MMMM d[,] yyyy[,] h:mm[:ss] a"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}( \d{1,2}:\d{2}(:\d{2})?)?$", ["yyyy/M/d[ H:mm][:ss]"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}( \d{1,2}:\d{2}(:\d{2})?)?$", ["M/d/yyyy[ H:mm][:ss]", "d/M/yyyy[ H:mm][:ss]"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})? [AaPp][Mm]$", ["M/d/yyyy h:mm[:ss] a", "d/M/yyyy h:mm[:ss] a"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["M-d-yyyy", "d-M-yyyy"]),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ["M.d.yyyy", "d.M.yyyy"]),
]
#: What is taken out or written the usual way before a form is looked for: weekdays in front, "5th", "Jan.", "Sept",
#: digits of a second beyond the sixth, small am and pm.
_USUAL = [
    (r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), (r"(?i)(?<=\d)(?:st|nd|rd|th)\b", ""),
    (r"(?i)\b(jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec)\.", "$1"), (r"(?i)\bsept\b", "Sep"), (r"(:\d{2}\.\d{6})\d+", "$1"),
    (r"(?<=\d )[Aa][Mm]$", "AM"), (r"(?<=\d )[Pp][Mm]$", "PM"), (r"\s+", " "),
]
_PLAIN = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def parse_date(c: Column | str) -> Column:
    """Lenient date parse, null when no known form fits.

    Offsets are applied (the instant is kept), not dropped; a month without a
    day is its first day, and a year of two digits is one of this century.
    """
    def read(text: Column) -> Column:
        return F.coalesce(*[F.when(text.rlike(shape), F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]))
                            for shape, formats in DATE_FORMATS])

    def usual(text: Column) -> Column:
        out = text
        for pattern, put in _USUAL:
            out = F.regexp_replace(out, pattern, put)
        return F.when(text.rlike(_PLAIN), text).otherwise(out)

    return once(F.trim(col(c)), lambda t: once(usual(t), read))


def days_between(start: Column | str, end) -> Column:
    """Whole 24-hour days from ``start`` to ``end``, rounded down."""
    return F.floor((F.unix_micros(ts(end)) - F.unix_micros(col(start))) / F.lit(86_400_000_000))


def days_since(start: Column | str, as_of) -> Column:
    """Whole days of an interval, cut towards zero."""
    micros = F.unix_micros(ts(as_of)) - F.unix_micros(col(start))
    return (micros / F.lit(86_400_000_000)).cast("bigint")


def duration_s(start: Column | str, end: Column | str) -> Column:
    """Seconds between two instants."""
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))) / F.lit(1_000_000.0)


def freshness(posted: Column | str, as_of, half_life: float = 7.0) -> Column:
    """0.5 ** (whole days / half life); future is 1.0, unknown 0.5."""
    days = days_between(posted, as_of)
    days = F.when(days < 0, F.lit(0)).otherwise(days)
    return F.coalesce(F.pow(F.lit(0.5), days / F.lit(float(half_life))), F.lit(0.5))


def freshness_exact(posted: Column | str, as_of, half_life: float = 7.0) -> Column:
    """D3: the fractional-day form; unknown is 0.5 and the future exceeds 1."""
    days = (F.unix_micros(ts(as_of)) - F.unix_micros(col(posted))) / F.lit(86_400_000_000.0)
    return F.coalesce(F.pow(F.lit(0.5), days / F.lit(float(half_life))), F.lit(0.5))


def posted_phrase(posted: Column | str, as_of) -> Column:
    """Today, yesterday, n days ago (under a week), else null."""
    days = days_between(posted, as_of)
    return (F.when(days == 0, F.lit("Posted today"))
            .when(days == 1, F.lit("Posted yesterday"))
            .when(days < 7, F.format_string("Posted %d days ago", days)))


def stale(c: Column | str, as_of, *, days: int = 0, hours: int = 0) -> Column:
    """never, or longer ago than the given age."""
    from .core import ago

    return col(c).isNull() | (col(c) < ago(as_of, days=days, hours=hours))


def recent(c: Column | str, as_of, *, days: int = 0, hours: int = 0) -> Column:
    """inside the window that ends at ``as_of``."""
    from .core import ago

    return col(c) >= ago(as_of, days=days, hours=hours)


def feed_recent(date_text: Column | str, as_of, max_age_days: int = 30) -> Column:
    """F8: a feed item younger than the limit; unreadable dates count as recent."""
    from .core import ago

    return F.coalesce(parse_date(date_text) > ago(as_of, days=max_age_days), F.lit(True))
