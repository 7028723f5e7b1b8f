"""Match scoring and explanation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..rules import roles
from .core import col, has_items, literal_array, literal_map, nz, truthy_num
from .dates import posted_phrase

# ---------------------------------------------------------------------------
# Weights, defaults and bounds of the match score.
# ---------------------------------------------------------------------------
WEIGHT_SKILLS, WEIGHT_FRESHNESS, WEIGHT_SEMANTIC, WEIGHT_LOCATION, WEIGHT_SPECIAL = .3, .3, .2, .1, .1
UNKNOWN = 0.5
LOCATION_SAME, LOCATION_PART, LOCATION_OTHER = 1.0, 0.7, 0.3
SPECIAL_KNOWN = 0.8
HARD_MATCH_BOOST = 1.1
SALARY_BUFFER = 0.8
BANDS = [(0.9, "Excellent match"), (0.8, "Strong match"), (0.7, "Good match"), (0.6, "Moderate match")]
LOWEST_BAND = "Potential match"
# ---------------------------------------------------------------------------


def lower_set(a: Column | str) -> Column:
    """Distinct lower-cased members."""
    return F.array_distinct(F.transform(col(a), lambda x: F.lower(x)))


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two distinct lists; a half when either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.when(has_items(a) & has_items(b), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(UNKNOWN))


def skills_score(candidate: Column | str, job: Column | str) -> Column:
    """M1: Jaccard overlap of lower-cased skills; a half when either side is missing."""
    return set_overlap(lower_set(candidate), lower_set(job))


def shared_skills(candidate: Column | str, job: Column | str) -> Column:
    """M2: number of skills in common, case kept."""
    both = F.array_intersect(col(candidate), col(job))
    return F.coalesce(F.nullif(F.size(both), F.lit(-1)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """M3: cosine similarity; null for a missing or zero vector."""
    a, b = col(a), col(b)
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def semantic_score(a: Column | str, b: Column | str) -> Column:
    """M3: cosine moved to 0–1; a half when either vector is missing or zero."""
    return F.coalesce((cosine(a, b) + F.lit(1.0)) / F.lit(2.0), F.lit(UNKNOWN))


def place_overlap(a: Column, b: Column) -> Column:
    """M4 on lower-cased lists: same place, one name inside the other, elsewhere, unknown."""
    part = F.exists(a, lambda x: F.exists(b, lambda y: y.contains(x) | x.contains(y)))
    return (F.when(~has_items(a) | ~has_items(b), F.lit(UNKNOWN))
            .when(F.arrays_overlap(a, b), F.lit(LOCATION_SAME))
            .when(part, F.lit(LOCATION_PART)).otherwise(F.lit(LOCATION_OTHER)))


def location_score(candidate: Column | str, job: Column | str) -> Column:
    """M4."""
    return place_overlap(lower_set(candidate), lower_set(job))


def seniority_compatible(candidate: Column | str, job: Column | str) -> Column:
    """M5: at most one step apart; an unknown level passes."""
    order = literal_array(roles.SENIORITY_LEVELS)
    a = F.coalesce(F.array_position(order, col(candidate)), F.lit(0))
    b = F.coalesce(F.array_position(order, col(job)), F.lit(0))
    return (a == 0) | (b == 0) | (F.abs(a - b) <= 1)


def weighted_score(skills: Column, fresh: Column, semantic: Column, location: Column,
                   specialization: Column) -> Column:
    """M6 without the upper limit."""
    fresh = F.coalesce(truthy_num(fresh), F.lit(UNKNOWN))
    special = F.when(nz(specialization).isNotNull(), F.lit(SPECIAL_KNOWN)).otherwise(F.lit(UNKNOWN))
    total = (skills * WEIGHT_SKILLS + fresh * WEIGHT_FRESHNESS + semantic * WEIGHT_SEMANTIC
             + location * WEIGHT_LOCATION + special * WEIGHT_SPECIAL)
    return total * HARD_MATCH_BOOST


def match_score(skills: Column, fresh: Column, semantic: Column, location: Column,
                specialization: Column) -> Column:
    """M6: weighted mean, boosted for passing the hard constraints, at most 1."""
    return F.least(F.lit(1.0), weighted_score(skills, fresh, semantic, location, specialization))


def score_band(score: Column | str) -> Column:
    """M7."""
    score = col(score)
    out = None
    for bound, label in BANDS:
        out = F.when(score >= bound, F.lit(label)) if out is None else out.when(score >= bound, F.lit(label))
    return out.otherwise(F.lit(LOWEST_BAND))


def reasons(c: dict[str, Column]) -> Column:
    """Map with only the reasons whose rule fired.

    ``c`` names the columns: candidate side ``c_*``, job side ``j_*``, plus
    the computed ``skills_score``.
    """
    entries = [
        ("role_match", has_items(c["c_role_families"]) & nz(c["j_role_family"]).isNotNull(),
         F.concat(F.lit("Matches your "), F.replace(c["j_role_family"], F.lit("_"), F.lit(" ")),
                  F.lit(" preference"))),
        ("seniority_match", nz(c["c_seniority"]).isNotNull() & nz(c["j_seniority"]).isNotNull(),
         F.concat(F.lit("Matches your "), c["j_seniority"], F.lit(" level"))),
        ("location_type_match", has_items(c["c_location_types"]) & nz(c["j_location_type"]).isNotNull(),
         F.concat(F.initcap(c["j_location_type"]), F.lit(" position"))),
        ("salary_match", truthy_num(c["c_min_salary"]).isNotNull() & truthy_num(c["j_max_salary"]).isNotNull()
         & (truthy_num(c["j_min_salary"]) >= c["c_min_salary"]),
         F.lit("Meets your salary requirements")),
        ("skills_match", (c["skills_score"] > 0.5) & has_items(c["j_skills"]),
         F.concat(F.lit("Matches "), shared_skills(c["c_skills"], c["j_skills"]).cast("string"),
                  F.lit(" of your skills"))),
        ("freshness", F.coalesce(truthy_num(c["j_freshness_score"]), F.lit(UNKNOWN)) > 0.7,
         F.lit("Posted recently")),
    ]
    items = [F.when(rule, F.struct(F.lit(key).alias("key"), value.alias("value")))
             for key, rule, value in entries]
    return F.map_from_entries(F.array_compact(F.array(*items)))


def headline(seniority: Column | str, specialization: Column | str, family: Column | str,
             company: Column | str) -> Column:
    """G17: "Senior Backend role at Acme"."""
    level = nz(seniority)
    shown = F.coalesce(F.try_element_at(literal_map(roles.SENIORITY_DISPLAY), level), F.initcap(level))
    what = F.coalesce(F.initcap(nz(specialization)),
                      F.initcap(F.replace(nz(family), F.lit("_"), F.lit(" "))))
    return F.concat_ws(" ", shown, what, F.lit("role at"), col(company))


def factors(reason_map: Column | str, location_type: Column | str, locations: Column | str,
            posted: Column | str, skills: Column | str, as_of, most: int | None = None) -> Column:
    """Factors, reasons first; all of them, or the first ``most`` that a page shows."""
    place, first = nz(location_type), F.try_element_at(col(locations), F.lit(1))
    where = (F.when(place == "remote", F.lit("Fully remote position"))
             .when(place == "hybrid", F.concat(F.lit("Hybrid role ("),
                                               F.coalesce(first, F.lit("flexible location")), F.lit(")")))
             .when(place.isNotNull() & first.isNotNull(), F.concat(F.lit("Based in "), first)))
    count = F.when(has_items(skills), F.concat(F.lit("Requires "), F.size(col(skills)).cast("string"),
                                               F.lit(" skills you may have")))
    extra = F.array_compact(F.array(where, posted_phrase(posted, as_of), count))
    given = F.coalesce(F.map_values(col(reason_map)), F.array().cast("array<string>"))
    told = F.concat(given, extra)
    return told if most is None else F.slice(told, 1, most)
