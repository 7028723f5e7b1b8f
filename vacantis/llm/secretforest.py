"""Secret scan: candidates by pattern, false positives removed by a random forest.

Runs on DataFrame functions only; the forest is Spark's own and is applied as a
Column expression, so a text is judged, and cleaned, in the row it stands in.

A candidate is a private key block, a signed token of three parts, what is
assigned (8 characters or more, punctuation included), or a run of ``LEAST``
characters as keys have them.  Its features: length, shares of digits, capitals
and different characters, character transitions (changes of class, letter to
digit, vowel to consonant), whether it is hexadecimal, how much of it a
dictionary covers (the ``PARTS`` three-letter parts most frequent in the words
around the corpus' own candidates), the text around it (a key word, an
assignment, quotes, words that tell of examples, the neighbouring words' lengths)
and the path it comes from.  The forest is fitted on a bounded sample of labelled
findings, ``FIT_EACH`` of either label spread by hash, and keeps a candidate whose
mean leaf probability is ``KEEP`` or more.

Labelled findings can be given; where a corpus has none, :func:`labelled` takes as
true those whose form leaves no doubt, each shown in other spellings of its bytes
too (capitals, base 64, a short one with punctuation), and as false the others,
but not doubtful ones: those that follow a key word or look drawn at random have
no label.  What a commit, sum or other digest's name stands before is false.  Forms
beyond doubt are kept, and digests named so are not, whatever the trees say.

Defined results: null and empty texts hold no candidate; null ids and paths,
repeated rows and long texts are judged like others; without findings of both
labels every candidate is kept that is verified by form; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, stored

LEAST, KEEP = 16, 0.5
FIT_EACH, TREES, DEPTH = 2000, 20, 5
#: Three-letter parts in the dictionary by which coverage is measured.
PARTS = 400
_RUN = "[A-Za-z0-9_+/-]"
_PEM = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:\s*+[A-Za-z0-9+/=]{4,80})*+(?:\s*-----END [A-Z ]{0,24}PRIVATE KEY-----)?"
_SIGNED = r"eyJ(?<![A-Za-z0-9_-]eyJ)[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
_ASSIGNED = r"(?<=[=:\"' ])(?<=[=:][\"' ]{0,2})(?![/\"'=: ]|-----BEGIN)(?=[^\s\"'<>]{0,40}[0-9A-Z!-.@^_~])[^\s\"'<>,;]{8,}"
_LONG = f"(?<!{_RUN}){_RUN}{{{LEAST},}}+"
CANDIDATE = f"(?:{_ASSIGNED}|{_SIGNED}|{_LONG}|{_PEM})"  # what fails soonest comes first
#: One of these is in every candidate that is not a mere run of characters, or before it.
_SIGNS = ("=", ":", "eyJ", "-----BEGIN")
_KEY = r"(?i)(?:passw|pwd|secret|token|api.?key|access.?key|credential|auth|private.?key|\bkey)"
_TOLD = r"(?i)(?:\b(?:examples?|samples?|dummy|placeholder|changeme|tests?)\b|docs?/)"
_NAMED = r"(?i)(?:commit|revision|sha-?\d*(?:sum)?|md5(?:sum)?|check.?sum|digest|hash|etag|uuid|guid|sum)\W{1,4}(?:is\W)?$"
_ASSIGN = r"[=:]\s*[\"']?$"
#: Published forms of tokens, which need no context.
_FORMS = (r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{20,}|glpat-[\w-]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[\w-]{10,}"
          r"|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})$|^-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----")



def _threes(text: Column) -> Column:
    """All parts of three characters."""
    n = F.length(text) - 2
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


FEATURES: dict[str, Callable[[dict[str, Column]], Column]] = {
    "length": lambda c: F.length(c["value"]),
    "digits": lambda c: F.regexp_count(c["value"], F.lit("[0-9]")) / F.length(c["value"]),
    "capitals": lambda c: F.regexp_count(c["value"], F.lit("[A-Z]")) / F.length(c["value"]),
    "different": lambda c: F.size(F.array_distinct(F.split(c["value"], ""))) / F.length(c["value"]),
    "changes": lambda c: F.regexp_count(c["value"], F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) / F.length(c["value"]),
    "letter_digit": lambda c: F.regexp_count(c["value"], F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) / F.length(c["value"]),
    "vowel_change": lambda c: F.regexp_count(F.lower(c["value"]), F.lit("[aeiou](?=[bcdfghj-np-tv-z])|[bcdfghj-np-tv-z](?=[aeiou])")) / F.length(c["value"]),
    "hexadecimal": lambda c: c["value"].rlike("^[0-9a-fA-F]+$").cast("int"),
    "covered": lambda c: F.size(F.filter(_threes(F.lower(c["value"])), lambda t: t.isin(c["parts"]))) / F.length(c["value"]),
    "key_before": lambda c: c["before"].rlike(_KEY + r"[\w.\"' ]{0,12}[=:]?\s*[\"']?$").cast("int"),
    "assigned": lambda c: c["before"].rlike(_ASSIGN).cast("int"),
    "quoted": lambda c: (c["before"].rlike("[\"']$") & c["after"].rlike("^[\"']")).cast("int"),
    "told": lambda c: (c["before"].rlike(_TOLD) | c["value"].rlike(_TOLD)).cast("int"),
    "word_before": lambda c: F.length(F.regexp_extract(c["before"], r"(\S*)\s*$", 1)),
    "word_after": lambda c: F.length(F.regexp_extract(c["after"], r"^\S*\s+(\S*)", 1)),
    "named": lambda c: c["before"].rlike(_NAMED).cast("int"),
    "path_told": lambda c: c["path"].rlike(_TOLD).cast("int"),
    "path_depth": lambda c: F.regexp_count(c["path"], F.lit("/")),
}


def _signed(text: Column) -> Column:
    """Whether other candidates than runs may be in a text."""
    out = text.contains(_SIGNS[0])
    for sign in _SIGNS[1:]:
        out = out | text.contains(sign)
    return out


def _long_words(text: Column) -> Column:
    """What a text has between spaces that is long enough for a run."""
    return F.array_join(F.filter(F.split(text, " "), lambda w: F.octet_length(w) >= LEAST), " ")


def holds(text: Column) -> Column:
    """Whether a text has a candidate; most have no sign and few long words."""
    return F.when(_signed(text), text.rlike(CANDIDATE)).otherwise(_long_words(text).rlike(f"{_RUN}{{{LEAST}}}"))


def _cut(text: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a struct of a text's candidates (values) and of the parts between them, which are looked for once."""
    whole = F.coalesce(text, F.lit(""))
    parts = F.when(_signed(whole), F.split(whole, CANDIDATE, -1)).otherwise(F.split(whole, _LONG, -1))
    values = F.when(_signed(whole), F.regexp_extract_all(whole, F.lit(CANDIDATE), 0)).otherwise(F.regexp_extract_all(_long_words(whole), F.lit(_LONG), 0))
    return F.element_at(F.transform(F.array(F.struct(parts.alias("parts"), values.alias("values"))), of), 1)


def _found(cut: Column, path: Column) -> Column:
    """The candidates of a text that was cut, as structs of value, before, after and path."""
    return F.transform(cut["values"], lambda v, i: F.struct(
        v.alias("value"), F.right(F.get(cut["parts"], i), F.lit(48)).alias("before"), F.left(F.get(cut["parts"], i + 1), F.lit(48)).alias("after"),
        F.coalesce(path, F.lit("")).alias("path")))


def features(c: dict[str, Column]) -> dict[str, Column]:
    return {k: F.coalesce(f(c).cast("double"), F.lit(0.0)) for k, f in FEATURES.items()}


def verified(value: Column, before: Column) -> Column:
    """Beyond doubt by form: a published token form, or a long hexadecimal value assigned to a key word."""
    assigned = before.rlike(_KEY + r"[\w.]{0,12}[\"']?\s*[=:]\s*[\"']?$") & ~before.rlike(_TOLD)
    return value.rlike(_FORMS) | (value.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$") & assigned)


def named(value: Column, before: Column) -> Column:
    """A digest by name: a commit, a sum."""
    return before.rlike(_NAMED) & ~value.rlike(_FORMS) & ~before.rlike(_KEY + r"[\w.\"' ]{0,12}[=:]?\s*[\"']?$")


def doubtful(value: Column, before: Column) -> Column:
    """No label is given: a key word stands before, or the characters look drawn at random."""
    drawn = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.regexp_count(value, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) * 6 >= F.length(value))
    return before.rlike(_KEY + r"[\w.\"' ]{0,12}[=:]?\s*[\"']?$") | drawn


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, nth, value, before, after, path): every candidate of every text, nth from 0."""
    rows = only(docs, id_col, text_col, path_col).toDF("doc_id", "text", "path")
    found = _cut(F.col("text"), lambda cut: _found(cut, F.col("path")))
    return (rows.where(holds(F.col("text"))).select("doc_id", F.posexplode(found).alias("nth", "c"))
            .select("doc_id", "nth", "c.*"))


def labelled(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1 beyond doubt, also in other spellings, 0 for the rest, but none for doubtful ones."""
    v, b = F.col("value"), F.col("before")
    label = F.when(verified(v, b), 1).when(named(v, b), 0).when(~doubtful(v, b), 0)
    known = found.withColumn("label", label).where(F.col("label").isNotNull())
    bytes_ = F.base64(F.unhex(F.left(v, F.lit(64))))
    other = F.when((F.col("label") == 1) & v.rlike("^(?:[0-9a-fA-F]{2}){8,}$"), F.array(
        v, F.upper(v), F.lower(v), bytes_, F.regexp_replace(bytes_, "=", ""), F.concat(F.left(bytes_, F.lit(9)), F.lit("!"))))
    return known.withColumn("value", F.explode(F.coalesce(other, F.array(v))))


def dictionary(found: DataFrame, most: int = PARTS) -> list[str]:
    """The most frequent three-letter parts of the words around all findings."""
    words = found.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit("[a-z]{3,}"), 0)).alias("w"))
    part = words.select(F.explode(_threes(F.col("w"))).alias("part"))
    rows = part.groupBy("part").count().orderBy(F.desc("count"), "part").limit(most).collect()
    return sorted(r.part for r in rows)


def _tree(text: list[str], at: int, score: dict[str, float] | None = None) -> tuple[tuple | float, int]:
    line = text[at].strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1]), at + 1
    name, op, value = re.match(r"If \(feature (\d+) (<=|>) ([-\dE.e]+)\)", line).groups()
    yes, at = _tree(text, at + 1)
    no, at = _tree(text, at + 1)
    return ((int(name), float(value), yes, no) if op == "<=" else (int(name), float(value), no, yes)), at


class Forest:
    """Trees of (feature, threshold, branch if not above, branch if above), leaves 0 or 1; applied as a Column."""

    def __init__(self, trees: list, parts: list[str] | None = None):
        self.trees, self.parts = trees, parts or []

    @staticmethod
    def fit(sample: DataFrame, parts: list[str] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest | None:
        """From rows with ``label`` and a double column per feature; None without both labels."""
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        if sample.select("label").distinct().count() < 2:
            return None
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select(
            F.col("label").cast("double").alias("label"), "features")
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
        return Forest([_tree(t.toDebugString.splitlines()[1:], 0)[0] for t in model.trees], parts)

    def score(self, c: dict[str, Column]) -> Column:
        x = list(c.values())

        def walk(t):
            return F.lit(t) if isinstance(t, float) else F.when(x[t[0]] <= t[1], walk(t[2])).otherwise(walk(t[3]))

        total = walk(self.trees[0])
        for t in self.trees[1:]:
            total = total + walk(t)
        return total / len(self.trees)


def train(found: DataFrame, each: int = FIT_EACH) -> Forest | None:
    """Fit on at most ``each`` findings of either label, (value, before, after, path, label)."""
    found = stored(found.select("value", "before", "after", "path", "label"), "labelled")
    spread = F.xxhash64("value", "before", "after")
    samples = [found.where(F.col("label") == k).orderBy(spread, "value", "before", "after").limit(each) for k in (0, 1)]
    words = dictionary(found)
    fields = {c: F.col(c) for c in ("value", "before", "after", "path")} | {"parts": words}
    sample = samples[0].union(samples[1])
    return Forest.fit(stored(sample.select("label", *(v.alias(k) for k, v in features(fields).items())), "findings"), words)


def _score(forest: Forest | None, c: dict[str, Column], known: dict[str, Column] | None = None) -> Column:
    """1 for forms beyond doubt, 0 for digests by name, else what the forest says."""
    sure = verified(c["value"], c["before"])
    if forest is None:
        return sure.cast("double")
    if known is None:  # every feature is worked out once, not at every node that asks for it
        own = F.struct(*(v.alias(k) for k, v in features(c | {"parts": forest.parts}).items()))
        said = F.element_at(F.transform(F.array(own), lambda f: forest.score({k: f[k] for k in FEATURES})), 1)
    else:
        said = forest.score(known)
    return F.when(sure, 1.0).when(named(c["value"], c["before"]), 0.0).otherwise(said)


def secrets(docs: DataFrame, forest: Forest | None = None, labels: DataFrame | None = None, keep: float = KEEP,
            id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Per secret: doc_id, nth (of the text's candidates), value, score; the forest is fitted if none is given."""
    found = stored(findings(docs, id_col, text_col, path_col), "candidates")
    forest = forest or train(labels if labels is not None else labelled(found))
    fields = {c: F.col(c) for c in ("value", "before", "after", "path")}
    if forest is None:
        scored = found.withColumn("score", _score(None, fields))
    else:
        scored = found.withColumns(features(fields | {"parts": forest.parts}))
        scored = scored.withColumn("score", _score(forest, fields, {k: F.col(k) for k in FEATURES}))
    return scored.where(F.col("score") >= keep).select("doc_id", "nth", "value", "score")


def redact(docs: DataFrame, forest: Forest | None, mark: str = "[SECRET]", keep: float = KEEP,
           text_col: str = "text", path_col: str = "source") -> DataFrame:
    """The documents with every secret replaced by ``mark``, all columns, in their rows."""
    text, path = F.col(f"`{text_col}`"), F.col(f"`{path_col}`")

    def woven(cut: Column) -> Column:
        clean = F.transform(_found(cut, path), lambda c: F.when(_score(forest, {k: c[k] for k in ("value", "before", "after", "path")}) >= keep, mark)
                            .otherwise(c["value"]))
        return F.array_join(F.flatten(F.zip_with(cut["parts"], clean, lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))), "")

    return docs.withColumn(text_col, F.when(holds(text), _cut(text, woven)).otherwise(text))
