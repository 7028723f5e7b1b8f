"""Classifiers: title, text, URL and page → label."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, functions as F

from ..rules import boards, locations as loc, misc, roles, skills as sk
from .core import (CI, UNICODE_CI, _any_word, any_of, col, contains_any, extract, first_contained, fold, folded_match,
                   first_extract, first_label, literal_array, needle, nz, once)

# ------------------------------------------------------------------ titles


def role_family(title: Column | str) -> Column:
    """L1: first matching family, else "other".

    Patterns are unanchored on purpose: "cto" also hits "Director".
    """
    return F.coalesce(first_label(col(title), roles.ROLE_FAMILIES), F.lit(roles.DEFAULT_ROLE_FAMILY))


def role_specialization(title: Column | str) -> Column:
    """L2: first matching specialisation, else null."""
    return first_label(col(title), roles.SPECIALIZATIONS)


def field_family(field: Column | str) -> Column:
    """Sign-up field to role family."""
    by_family = defaultdict(list)
    for name, family in roles.FIELD_FAMILIES.items():
        by_family[family].append(name)
    field = col(field)
    out = None
    for family, names in by_family.items():
        hit = field.isin(names)
        out = F.when(hit, F.lit(family)) if out is None else out.when(hit, F.lit(family))
    return out.otherwise(F.lit(roles.DEFAULT_ROLE_FAMILY))


def _band(years: Column) -> Column:
    out = None
    for bound, level in roles.EXPERIENCE_BANDS:
        out = F.when(years < bound, F.lit(level)) if out is None else out.when(years < bound, F.lit(level))
    return out.when(years.isNotNull(), F.lit(roles.EXPERIENCE_TOP))


def seniority_from_experience(description: Column | str) -> Column:
    """Level from the first stated years of experience, else from a range of years."""
    def read(text: Column) -> Column:
        number = lambda pattern, group: extract(text, "(?U)" + pattern, group).try_cast("decimal(38,0)")
        stated = F.when(text.contains("exp"), number(roles.YEARS_OF_EXPERIENCE, 1))
        middle = F.floor((number(roles.YEARS_RANGE, 1) + number(roles.YEARS_RANGE, 2)) / F.lit(2))
        return F.when(text.contains("y"), F.coalesce(once(stated, _band), once(middle, _band)))
    return once(fold(col(description)), read)


def seniority(title: Column | str, description: Column | str) -> Column:
    """L3: title rules, then experience in the description, then "mid"."""
    return F.coalesce(first_label(col(title), roles.SENIORITY_TITLES),
                      seniority_from_experience(description), F.lit(roles.DEFAULT_SENIORITY))


def employment_type(raw: Column | str) -> Column:
    """L8."""
    return first_contained(F.lower(col(raw)), roles.EMPLOYMENT_TYPES)


# ------------------------------------------------------------------ locations

_ALL_COUNTRY = [p for patterns in loc.COUNTRIES.values() for p in patterns]


def _state_pattern() -> str:
    """Any state code as a word, grouped by first letter so a mismatch fails at once."""
    seconds: dict[str, str] = defaultdict(str)
    for code in loc.US_STATES.values():
        seconds[code[0]] += code[1]
    return r"(?U)\b(?:" + "|".join(f"{a}[{rest}]" for a, rest in seconds.items()) + r")\b"


def _looks_like_place(text: Column, folded: Column) -> Column:
    # for a yes/no answer one letter before the comma is as good as a word, and
    # the search stays linear
    city_state = loc.CITY_COMMA_STATE.replace("[A-Za-z]+", "[A-Za-z]", 1)
    return (contains_any(F.lower(text), loc.TECH_HUBS) | text.rlike(_state_pattern())
            | once(folded, lambda f: folded_match(f, _ALL_COUNTRY)) | text.rlike(city_state))


def location_type(raw: Column | str) -> Column:
    """L4: hybrid beats remote when both are said; a bare place is on site."""
    text = F.trim(nz(raw))
    said = once(fold(text), lambda t: F.when(folded_match(t, loc.HYBRID), F.lit("hybrid"))
                .when(folded_match(t, loc.REMOTE), F.lit("remote"))
                .when(folded_match(t, loc.ONSITE), F.lit("onsite")))
    place = once(text, lambda t: F.when(_looks_like_place(t, fold(t)), F.lit("onsite")))
    return F.coalesce(said, place)


def clean_location(text: Column) -> Column:
    out = F.regexp_replace(text, UNICODE_CI + loc.LOCATION_PREFIX, "")
    out = F.regexp_replace(out, UNICODE_CI + loc.LOCATION_SUFFIX, "")
    for pattern in loc.REMOTE + loc.HYBRID:
        out = F.regexp_replace(out, UNICODE_CI + pattern, "")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    out = F.regexp_replace(out, r"^[ ,;-]+|[ ,;-]+$", "")
    return once(out, lambda t: F.when(F.length(t) > 1, t))


def locations(raw: Column | str) -> Column:
    """Hubs in table order, then countries, else the cleaned text.

    Hub keys are substrings: "la" also hits "Atlanta".
    """
    none = F.array().cast("array<string>")

    def known(text: Column) -> Column:
        lower = once(F.lower(text), lambda t: F.array(*[F.when(t.contains(k), F.lit(v)) for k, v in loc.TECH_HUBS.items()]))
        lands = once(fold(text), lambda t: F.array(*[F.when(folded_match(t, p), F.lit(c)) for c, p in loc.COUNTRIES.items()]))
        return F.array_distinct(F.array_compact(F.concat(lower, lands)))

    def read(text: Column) -> Column:
        return once(known(text), lambda found: F.when(F.size(found) > 0, found).otherwise(
            F.array_compact(F.array(clean_location(text)))))
    return F.coalesce(once(F.trim(nz(raw)), read), none)


def is_us_location(raw: Column | str) -> Column:
    """``struct<is_us, location>``; words for other countries are tested first.

    Tests are substrings: "Milwaukee" contains "uk" and counts as abroad.
    """
    return once(nz(raw), _us_of)


def _us_of(text: Column) -> Column:
    lower = F.lower(text)
    abroad = contains_any(lower, loc.NON_US_WORDS)
    codes = [c.lower() for c in loc.US_STATES.values()]
    # one pass for ", ca" and ",ca" of any state
    after_comma = lower.rlike(", ?(?:" + "|".join(codes) + ")")
    domestic = (contains_any(lower, loc.US_WORDS) | contains_any(lower, loc.US_CITIES)
                | contains_any(lower, loc.US_STATES) | after_comma
                | F.coalesce(extract(text, "(?U)" + loc.STATE_AFTER_COMMA).isin(list(loc.US_STATES.values())),
                             F.lit(False))
                | text.rlike("(?U)" + loc.ZIP_CODE))
    is_us = F.coalesce(~abroad & domestic, F.lit(False))
    return F.struct(is_us.alias("is_us"), F.when(~abroad, text).alias("location"))


def is_us_domain(domain: Column | str) -> Column:
    """L18."""
    return F.coalesce(col(domain).endswith(".us"), F.lit(False))


def location_from_html(html: Column | str) -> Column:
    """First address-like text of 6 to 199 characters over six patterns."""
    options = []
    for pattern in loc.LOCATION_SNIPPETS:
        text = F.regexp_replace(F.trim(extract(col(html), UNICODE_CI + pattern)), r"(?U)\s+", " ")
        options.append(once(text, lambda t: F.when((F.length(t) > 5) & (F.length(t) < 200), t)))
    return F.coalesce(*options)


# ---------------------------------------------------------------------------
# Sources whose companies count as domestic without a location.
# ---------------------------------------------------------------------------
TRUSTED_US_SOURCES = ["yc_directory", "yc_directory_waas", "github_orgs", "funding_news",
                      "job_aggregators"]
# ---------------------------------------------------------------------------


def us_gate(country, location, careers_url, ats_type, source) -> Column:
    """May the discovered company enter the catalogue?

    A US country decides at once.  A stated location decides next, either
    way.  Without one, a platform board, a careers-page source or a trusted
    source is enough.
    """
    on_board = nz(careers_url).isNotNull() & nz(ats_type).isNotNull()
    source = F.coalesce(col(source), F.lit(""))
    trusted = on_board | source.contains("_careers") | source.isin(TRUSTED_US_SOURCES)
    return (F.when(F.upper(col(country)) == "US", F.lit(True))
            .when(nz(location).isNotNull(), is_us_location(location)["is_us"])
            .otherwise(trusted))


# ------------------------------------------------------------------ skills

_ALIAS_SKILLS: dict[str, list[str]] = defaultdict(list)
for _name, _aliases in sk.SKILL_ALIASES.items():
    for _a in _aliases:
        _ALIAS_SKILLS[_a].append(_name)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _prefix_skills(alias: str) -> list[str]:
    """Skills of every alias that also matches, with its boundaries, where ``alias`` does."""
    out = set()
    for other, names in _ALIAS_SKILLS.items():
        if alias == other or (alias.startswith(other) and _word(alias[len(other) - 1]) != _word(alias[len(other)])):
            out.update(names)
    return sorted(out)


def _alias_tree() -> str:
    """One alternation, grouped by first character and longest first inside a group."""
    groups: dict[str, list[str]] = defaultdict(list)
    for alias in _ALIAS_SKILLS:
        groups[alias[0]].append(alias[1:])
    parts = []
    for head, tails in groups.items():
        tails = sorted(tails, key=len, reverse=True)
        body = "|".join(re.escape(t) + r"\b" for t in tails)
        parts.append(re.escape(head) + "(?:" + body + ")")
    return "|".join(parts)


# A look-ahead finds the longest alias at every word start, so overlapping
# names ("ruby on rails", "rails") are all seen in one pass over the text.
SKILL_PATTERN = UNICODE_CI + r"\b(?=(" + _alias_tree() + "))"


def skills(title: Column | str, description: Column | str) -> Column:
    """Sorted canonical skills named in title or description, in one text scan."""
    text = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(description), F.lit("")))
    hits = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SKILL_PATTERN), F.lit(1)),
                                        lambda m: F.lower(m)))
    flat = []
    for alias in _ALIAS_SKILLS:
        flat += [F.lit(alias), literal_array(_prefix_skills(alias))]
    table = F.create_map(*flat)
    names = F.flatten(F.transform(hits, lambda m: F.coalesce(F.try_element_at(table, m),
                                                             F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(names))


def normalize_skill(skill: Column | str) -> Column:
    """Alias to canonical name; unknown skills only lose case and outer spaces."""
    s = F.trim(F.lower(col(skill)))
    out = None
    for name, aliases in sk.SKILL_ALIASES.items():
        hit = s.isin(aliases)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(s)


def related_skills(skill: Column | str) -> Column:
    """Skills that usually go with a skill."""
    flat = []
    for name, others in sk.SKILL_RELATIONS.items():
        flat += [F.lit(name), literal_array(others)]
    return F.coalesce(F.try_element_at(F.create_map(*flat), normalize_skill(skill)),
                      F.array().cast("array<string>"))


# ------------------------------------------------------------------ platforms


def ats_from_url(url: Column | str) -> Column:
    """``struct<ats_type, ats_identifier>``; both null when no platform is named.

    Some hundred patterns: bound once, or every later use of a field would
    repeat them.  A byte search for the literals that a platform's patterns
    must contain comes before its regular expressions.
    """
    url = col(url)
    return once(F.struct(url.alias("url"), F.lower(url).alias("low")), _platform_of)


def _platform_of(both: Column) -> Column:
    url, low, found = both["url"], both["low"], None
    for label, patterns in boards.URL_PATTERNS.items():
        words = {needle(p)[0] for p in patterns}
        hit = url.rlike(any_of(patterns, CI))
        if all(words):
            words = sorted(w for w in words if not any(v != w and v in w for v in words))
            hit = _any_word(low, words) & hit
        # the first pattern that matches gives the identifier
        values = [F.regexp_extract(url, CI + p, 1) if re.compile(p).groups else F.lit("") for p in patterns]
        value = values[-1]
        for p, v in reversed(list(zip(patterns[:-1], values[:-1]))):
            value = F.when(url.rlike(CI + p), v).otherwise(value)
        named = F.struct(F.lit(label).alias("ats_type"), value.alias("ats_identifier"))
        found = F.when(hit, named) if found is None else found.when(hit, named)
    return once(found, _without_own_names)


def _without_own_names(found: Column) -> Column:
    ident = found["ats_identifier"]
    valid = F.when((ident != "") & ~F.lower(ident).isin(boards.NOT_IDENTIFIERS), ident)
    return F.struct(found["ats_type"].alias("ats_type"), valid.alias("ats_identifier"))


def ats_from_url_quick(url: Column | str, current: Column | str) -> Column:
    """Substring form, fills only missing types."""
    return F.coalesce(col(current), first_contained(F.lower(col(url)), boards.QUICK_URL))


def ats_from_html(html: Column | str) -> Column:
    """First platform whose mark occurs in the lower-cased page."""
    return first_contained(F.lower(col(html)), boards.PAGE_MARKS)


def _from_segment_start(pattern: str) -> str:
    """A leading ``([^.]+)`` finds the same leftmost match when it may start only
    after a dot; without that the search is quadratic in the distance of dots."""
    lead = re.match(r"\(\[\^([./]+)\]\+\)", pattern)
    return f"(?<![^{lead.group(1)}])" + pattern if lead else pattern


def ats_identifier(html: Column | str, ats_type: Column | str) -> Column:
    """The company's identifier in a page of a known platform."""
    html, ats_type = col(html), col(ats_type)
    out = None
    for label, patterns in boards.PAGE_IDENTIFIERS.items():
        options = [extract(html, _from_segment_start(p)) for p in patterns]
        if label == "greenhouse":
            options = [F.when(~o.isin(boards.NOT_PAGE_TOKENS), o) for o in options]
            links = F.regexp_extract_all(html, F.lit(boards.GREENHOUSE_BOARD_LINK), F.lit(1))
            own = F.filter(links, lambda s: ~F.lower(s).isin(boards.NOT_PAGE_TOKENS) & (F.length(s) > 2))
            options.append(F.try_element_at(own, F.lit(1)))
        value = F.coalesce(*options)
        out = F.when(ats_type == label, value) if out is None else out.when(ats_type == label, value)
    return out


def embed_sources(html: Column | str) -> Column:
    """Addresses of scripts and frames, in page order."""
    return F.regexp_extract_all(
        col(html), F.lit(r"""(?i)<(?:script|iframe)[^>]+src=["']([^"']+)["']"""), F.lit(1))


def ats_from_embeds(html: Column | str) -> Column:
    """First script or frame address that names a platform."""
    hits = F.filter(F.transform(embed_sources(html), lambda u: ats_from_url(u)),
                    lambda s: s["ats_type"].isNotNull())
    return F.try_element_at(hits, F.lit(1))


def ats_from_page(html: Column | str) -> Column:
    """First board link in a page, in platform order."""
    html = col(html)
    kind, ident = [], []
    for label, pattern in boards.PAGE_LINK_PATTERNS:
        value = extract(html, CI + pattern)
        kind.append(F.when(~F.lower(value).isin(boards.NOT_LINK_IDENTIFIERS),
                           F.struct(F.lit(label).alias("ats_type"), value.alias("ats_identifier"))))
    return F.coalesce(*kind)


# ------------------------------------------------------------------ news and pages


def funding_stage(text: Column | str) -> Column:
    """Stage named in the text; later rounds win."""
    def stage_of(t: Column) -> Column:
        out = None
        for phrase, stage in misc.FUNDING_STAGES.items():
            hit = t.contains(phrase)
            out = F.when(hit, F.lit(stage)) if out is None else out.when(hit, F.lit(stage))
        return out
    return once(F.lower(col(text)), stage_of)


def looks_like_careers(html: Column | str) -> Column:
    """Two career words and one role word."""
    def look(t: Column) -> Column:
        count = sum((t.contains(w).cast("int") for w in boards.CAREER_WORDS), F.lit(0))
        return (count >= 2) & contains_any(t, boards.ROLE_WORDS)
    return once(F.lower(col(html)), look)


def has_careers_phrase(html: Column | str) -> Column:
    """L22, second form: any of ten phrases."""
    return contains_any(F.lower(col(html)), misc.CAREERS_PHRASES)


def needs_rendering(html: Column | str) -> Column:
    """The page builds itself with scripts."""
    return contains_any(F.lower(col(html)), misc.RENDER_MARKS)
