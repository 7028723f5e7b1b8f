"""Text, URL, name and salary functions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from ..rules import boards, misc
from .core import (CI, col, contains_any, extract, first_extract, has_items, literal_array, nz, once, title_case)

# Character references as HTML5 reads them; the names come from the standard table of the language.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_USUAL = ["amp;", "nbsp;", "quot;", "lt;", "gt;", "copy;", "middot;", "rsquo;", "lsquo;", "ldquo;", "rdquo;", "ndash;", "mdash;", "bull;", "hellip;", "apos;"]
# Numbers 128 to 159 mean the characters of the Windows code page.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}


def clean_text(c: Column | str) -> Column:
    """G1: collapse whitespace and trim; empty becomes null."""
    return nz(F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")))


def _names() -> Column:
    """Name (with its semicolon, if it needs one) to character, as one constant."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _number(text: Column, base: int) -> Column:
    """Character of a decimal or hexadecimal number; the replacement character for what is none."""
    digits = F.regexp_replace(F.regexp_extract(text, "([0-9a-fA-F]+);?$", 1), "^0+(?=.)", "")
    n = F.when(F.length(digits) <= 8, F.conv(digits, base, 10).cast("bigint")).otherwise(F.lit(0x110000))
    odd = F.create_map(*[F.lit(x) for n, c in _WINDOWS.items() for x in (n, c)])
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    control = ((n >= 1) & (n <= 8)) | ((n >= 14) & (n <= 31)) | (n == 127) | (n == 11) | ((n >= 0xFDD0) & (n <= 0xFDEF)) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return once(n, lambda _: F.when((n == 0) | ((n >= 0xD800) & (n <= 0xDFFF)) | (n > 0x10FFFF), "\ufffd").when(n == 13, "\r")
                .when((n >= 128) & (n < 160), F.try_element_at(odd, n.cast("int"))).when(control, "").otherwise(plain))


def _named(name: Column) -> Column:
    """A named reference: the whole name, else its longest known beginning and the rest as it is."""
    known = _names()
    usual = F.when(name == _USUAL[0], html5[_USUAL[0]])
    for n in _USUAL[1:]:
        usual = usual.when(name == n, html5[n])
    lengths = F.filter(F.sequence(F.length(name), F.lit(1), F.lit(-1)), lambda n: F.map_contains_key(known, F.left(name, n)))
    best = F.try_element_at(lengths, F.lit(1))
    beginning = once(best, lambda n: F.when(n.isNull(), F.concat(F.lit("&"), name)).otherwise(
        F.concat(F.try_element_at(known, F.left(name, n)), F.substring(name, n + 1, F.length(name)))))
    # the usual names are asked one by one, others in the table, and only what is in neither by its beginnings
    return F.coalesce(usual, F.try_element_at(known, name), beginning)


def unescape_entities(c: Column | str) -> Column:
    """All character references, numeric and named, in one pass: what a reference yields is not read again."""
    def one(ref: Column) -> Column:
        return (F.when(ref.rlike("^&#[xX]"), _number(ref, 16)).when(ref.startswith("&#"), _number(ref, 10))
                .otherwise(_named(F.substring(ref, 2, 40))))

    def whole(text: Column) -> Column:
        parts = F.split(text, _REFERENCE, -1)
        found = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), one)
        woven = F.zip_with(parts, found, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
        return F.when(text.contains("&"), F.array_join(woven, "")).otherwise(text)

    return once(col(c), whole)


def unescape_json(c: Column | str) -> Column:
    """Escapes of a JSON string body that matter in prose."""
    out = F.replace(col(c), F.lit('\\"'), F.lit('"'))
    out = F.replace(out, F.lit("\\n"), F.lit(" "))
    return F.replace(out, F.lit("\\t"), F.lit(" "))


def strip_tags(c: Column | str) -> Column:
    """Tags to spaces, whitespace collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), "<[^>]+>", " "), r"(?U)\s+", " "))


def html_to_text(c: Column | str) -> Column:
    """Unescape entities and JSON escapes, then drop tags and collapse spaces."""
    return strip_tags(unescape_json(unescape_entities(c)))


def truncate(c: Column | str, n: int) -> Column:
    """Tags removed, trimmed, cut to ``n`` characters with an ellipsis."""
    text = F.trim(F.regexp_replace(col(c), "<[^>]+>", ""))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def host_of(url: Column | str) -> Column:
    """Lower-cased host of an absolute URL; null when there is none."""
    return extract(F.lower(col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def strip_www(domain: Column | str) -> Column:
    return F.regexp_replace(col(domain), r"^www\.", "")


def derive_domain(website: Column | str, careers: Column | str) -> Column:
    """Host of the website, else of the careers page unless a platform hosts it.

    A port is not part of the result.
    """
    own = host_of(careers)
    own = F.when(~contains_any(own, misc.DOMAIN_PLATFORM_PARTS), own)
    return strip_www(F.coalesce(host_of(website), own))


def base_domain(domain: Column | str) -> Column:
    """The last two labels."""
    d = F.lower(col(domain))
    return F.coalesce(extract(d, r"([^.]*\.[^.]*)$"), d)


def first_label_of(domain: Column | str) -> Column:
    return F.substring_index(col(domain), ".", 1)


def normalize_url(c: Column | str) -> Column:
    """Trailing slashes go first, then the query, then case; null becomes ''."""
    u = F.coalesce(col(c), F.lit(""))
    return F.lower(F.regexp_replace(F.regexp_replace(u, "/+$", ""), r"\?.*$", ""))


def listing_key(title: Column | str, url: Column | str) -> Column:
    """Normalised URL, else lower-cased title, else ''."""
    return (F.when(nz(url).isNotNull(), normalize_url(url))
            .otherwise(F.coalesce(F.trim(F.lower(col(title))), F.lit(""))))


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Protocol-relative, root-relative, absolute and plain links."""
    base, href = col(base), col(href)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return (F.when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .when(href.startswith("http"), href)
            .otherwise(F.concat(origin, F.lit("/"), href)))


def name_from_slug(c: Column | str) -> Column:
    """Separators to spaces, a capital at the start of every run of letters."""
    return title_case(F.translate(col(c), "-_", "  "))


def parent_name(domain: Column | str) -> Column:
    """G9 for parents: short first labels are acronyms."""
    label = first_label_of(domain)
    return F.when(F.length(label) <= 3, F.upper(label)).otherwise(title_case(label))


def company_slugs(name: Column | str, domain: Column | str) -> Column:
    """Up to six distinct board slugs, in order of likelihood."""
    base = F.lower(first_label_of(domain))
    clean = F.trim(F.regexp_replace(F.lower(col(name)), r"[^a-zA-Z0-9\s-]", ""))
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    options = F.array(
        base, F.replace(base, F.lit("-"), F.lit("")), F.replace(base, F.lit("_"), F.lit("")),
        F.array_join(words, ""), F.array_join(words, "-"), F.try_element_at(words, F.lit(1)))
    return F.array_distinct(F.filter(options, lambda s: s.isNotNull() & (s != "")))


def norm_company(c: Column | str) -> Column:
    """Lower case, one legal suffix and punctuation removed."""
    out = F.regexp_replace(F.lower(col(c)), misc.COMPANY_SUFFIX, "")
    return F.trim(F.regexp_replace(out, r"(?U)[^\w\s]", ""))


def company_slug(c: Column | str) -> Column:
    """Professional-network form of a company name."""
    out = F.regexp_replace(F.trim(F.lower(col(c))), misc.SLUG_SUFFIX, "")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", ""), r"(?U)[^\w-]", "")


def sig_words(c: Column | str) -> Column:
    """Words of three or more ASCII letters that are not stop words (repeats kept)."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)\b([a-z]+)\b"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(misc.STOP_WORDS))


def join_location(city, state, country, fallback=None) -> Column:
    """The non-empty parts joined by commas."""
    joined = nz(F.concat_ws(", ", nz(city), nz(state), nz(country)))
    return joined if fallback is None else F.coalesce(joined, col(fallback))


def _by_type(ats_type: Column, ident: Column, urls: dict[str, str]) -> Column:
    out = None
    for label, form in urls.items():
        value = F.format_string(form, ident)
        out = F.when(ats_type == label, value) if out is None else out.when(ats_type == label, value)
    return out


def board_url(ats_type: Column | str, ident: Column | str) -> Column:
    """Public board address for a platform and identifier."""
    ident = col(ident)
    return F.coalesce(_by_type(col(ats_type), ident, boards.BOARD_URLS),
                      F.concat(F.lit("https://"), ident))


def api_url(ats_type: Column | str, ident: Column | str, careers_url: Column | str) -> Column:
    """The address that a fetcher should read, else the careers page."""
    return F.coalesce(_by_type(col(ats_type), nz(ident), boards.API_URLS), col(careers_url))


def provider_job_id(ats_type: Column | str, url: Column | str) -> Column:
    """The provider's job id inside a posting URL."""
    ats_type, url = col(ats_type), col(url)
    out = None
    for label, patterns in misc.JOB_ID_PATTERNS.items():
        value = first_extract(url, patterns)
        out = F.when(ats_type == label, value) if out is None else out.when(ats_type == label, value)
    return out


def content_hash(c: Column | str) -> Column:
    """G18."""
    return F.sha2(col(c), 256)


# ------------------------------------------------------------------ salary

def parse_salary(c: Column | str) -> Column:
    """``struct<min_salary, max_salary>`` from the first one or two numbers."""
    text = F.translate(col(c), ",$£€", "")
    text = F.regexp_replace(text, r"(?i)(\d+)k", "$1000")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)),
                          lambda n: n.try_cast("bigint"))
    pair = F.slice(numbers, 1, 2)
    some = has_items(numbers)
    return F.struct(F.when(some, F.array_min(pair)).alias("min_salary"),
                    F.when(some, F.array_max(pair)).alias("max_salary"))


def salary_snippet(c: Column | str) -> Column:
    """First salary-looking piece of free text."""
    return first_extract(col(c), misc.SALARY_SNIPPETS, group=0, flags=CI)


def jsonld_salary(currency, low, high) -> Column:
    """``CUR min - max``, ``CUR min+`` or ``Up to CUR max``."""
    cur = F.coalesce(col(currency), F.lit("USD"))
    low, high = F.nullif(col(low), F.lit(0)), F.nullif(col(high), F.lit(0))
    show = lambda v: F.format_number(v, 0)
    return (F.when(low.isNotNull() & high.isNotNull(),
                   F.concat(cur, F.lit(" "), show(low), F.lit(" - "), show(high)))
            .when(low.isNotNull(), F.concat(cur, F.lit(" "), show(low), F.lit("+")))
            .when(high.isNotNull(), F.concat(F.lit("Up to "), cur, F.lit(" "), show(high))))


def safe_ratio(a: Column, b: Column, scale: int | None = None) -> Column:
    """A / b, zero when there is nothing to divide by."""
    ratio = F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return ratio if scale is None else F.round(ratio, scale)


# ------------------------------------------------------------------ URL predicates

def is_valid_careers_url(url: Column | str) -> Column:
    """not news, social, community or a link shortener."""
    url = col(url)
    bad = "(?i)(?:" + "|".join(boards.BAD_CAREERS_URL) + ")"
    return F.coalesce((url != "") & ~url.rlike(bad), F.lit(False))


def _ends_with_any(host: Column, suffixes: list[str]) -> Column:
    out = None
    for s in suffixes:
        hit = host.endswith(s)
        out = hit if out is None else out | hit
    return out


def url_belongs_to(url: Column | str, domain: Column | str) -> Column:
    """same base domain, a known platform, or the company's label in host or path."""
    host = F.coalesce(host_of(url), F.lit(""))
    own = F.lower(col(domain))
    label = first_label_of(own)
    return ((base_domain(host) == base_domain(own))
            | _ends_with_any(host, boards.PLATFORM_HOSTS)
            | host.contains(label) | F.lower(path_of(url)).contains(label))


def parent_redirect(domain: Column | str, final_url: Column | str) -> Column:
    """base domain of another company the careers page redirects to, else null."""
    host = host_of(final_url)
    other = base_domain(host)
    moved = (nz(domain).isNotNull() & host.isNotNull()
             & ~_ends_with_any(host, boards.REDIRECT_PLATFORM_HOSTS)
             & (base_domain(domain) != other))
    return F.when(moved, other)


def domains_match(a: Column | str, b: Column | str) -> Column:
    """equal, subdomain either way, or the same first label of more than three letters."""
    ours = F.replace(F.lower(nz(a)), F.lit("www."), F.lit(""))
    theirs = F.replace(F.lower(nz(b)), F.lit("www."), F.lit(""))
    label = first_label_of(ours)
    return F.coalesce(
        (ours == theirs)
        | ours.endswith(F.concat(F.lit("."), theirs)) | theirs.endswith(F.concat(F.lit("."), ours))
        | ((label == first_label_of(theirs)) & (F.length(label) > 3)), F.lit(False))


def is_candidate_domain(domain: Column | str) -> Column:
    """could be a company's own domain."""
    d = F.lower(col(domain))
    return (~d.isin(boards.SKIP_DOMAINS) & ~contains_any(d, boards.SKIP_DOMAIN_PARTS)
            & (F.length(d) >= 4) & d.contains("."))


def is_invalid_identifier(c: Column | str) -> Column:
    """template left-overs, markup, over-long or placeholder identifiers."""
    c = col(c)
    bad = "(?i)(?:" + "|".join(misc.BAD_IDENTIFIER) + ")"
    return F.coalesce((c == "") | c.rlike(bad) | (F.length(c) > 100)
                      | F.trim(c).isin(misc.PLACEHOLDER_IDENTIFIERS), F.lit(True))


def is_company_like(name, description, site) -> Column:
    """not a school, public body, sports team, church, museum or code host page."""
    name = F.lower(F.coalesce(col(name), F.lit("")))
    desc = F.lower(F.coalesce(col(description), F.lit("")))
    site = F.coalesce(col(site), F.lit(""))
    words = misc.ORG_EDU_WORDS + misc.ORG_SKIP_WORDS
    return ~(contains_any(name, words) | contains_any(desc, words)
             | contains_any(site, [".edu", "github.com", "github.io"]))


def is_job_title(c: Column | str, min_length: int = 5) -> Column:
    """long enough and not navigation text."""
    c = col(c)
    nav = "(?U)(?:" + "|".join(misc.NAVIGATION_TEXT) + ")"
    return F.coalesce((F.length(c) > min_length) & ~F.trim(F.lower(c)).rlike(nav), F.lit(False))


def has_any_keyword(title, description, words=None) -> Column:
    """any keyword in lower-cased title and description.

    A missing part reads as the word "none", as the printed null does in the
    product this follows; no keyword list contains it.
    """
    none = F.lit("None")
    text = F.lower(F.concat_ws(" ", F.coalesce(col(title), none), F.coalesce(col(description), none)))
    return contains_any(text, words or misc.FUNDING_KEYWORDS)


def in_or_unconstrained(value: Column | str, allowed: Column | str) -> Column:
    """member of the row's list, or the list or the value is missing."""
    value, allowed = nz(value), col(allowed)
    return ~has_items(allowed) | value.isNull() | F.array_contains(allowed, value)


__all__ = [n for n in dir() if not n.startswith("_")]
