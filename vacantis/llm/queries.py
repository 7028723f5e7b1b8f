"""The registered queries of this folder, as the contracts word them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_line_crf(spark, sf_dir):
    from .linecrf import judge, train

    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op2_factorization(spark, sf_dir):
    from .factorization import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op5_concat_cut(spark, sf_dir):
    from .packing import pieces

    return pieces(table(spark, sf_dir, "documents"), with_ids=False)


_BITS = [f"{n:04b}" for n in range(16)], [f"{n:05b}" for n in range(32)]
#: SHA-1 in base 32: hexadecimal digits to bits, five bits to a letter.
ORACLES["op7_zip_warc"] = f"""
    WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, array_to_string(list_transform(range(1, 41),
        lambda i: ({_BITS[0]})[instr('0123456789abcdef', x[i])]), '') AS bits FROM d)
    SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32),
        lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_position({_BITS[1]}, substr(bits, 5 * i + 1, 5))::INT, 1)), '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS intact FROM f"""


@query
def op7_zip_warc(spark, sf_dir):
    from .archive import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


@query
def op6_spaced_seeds(spark, sf_dir):
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_url_tree(spark, sf_dir):
    from .urltree import examples_of, judge

    pages = table(spark, sf_dir, "pages")
    return judge(pages, examples_of(pages, table(spark, sf_dir, "labels")))


@query
def op10_secret_forest(spark, sf_dir):
    from .secretforest import secrets

    return secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "nth", F.length("value").alias("length"), F.left("value", F.lit(4)).alias("begins"),
        F.sha2("value", 256).alias("digest"), "score")


@query
def op8_pitman_yor(spark, sf_dir):
    from .pitmanyor import scores

    return scores(table(spark, sf_dir, "documents"))


@query
def op4_patience(spark, sf_dir):
    from .licenses import notices

    return notices(table(spark, sf_dir, "documents"))


#: (source turn, lines of its schedule: begin, weight there, slope, integral before, integral after)
_LINES = {0: [(0.0, 6.0, -2.0, 0.0, 5.0)], 1: [(0.0, 2.0, 0.0, 0.0, 2.0)], 2: [(0.0, 0.5, 0.0, 0.0, 0.25), (0.5, 0.5, 4.0, 0.25, 1.0)]}
_DUE = "CASE " + " ".join(
    f"WHEN turn = {turn} AND y * {lines[-1][4]} < {high} THEN CASE WHEN y * {lines[-1][4]} - {low} <= 0 THEN {s} ELSE {s} + "
    f"2 * (y * {lines[-1][4]} - {low}) / ({v} + sqrt(greatest({v * v} + {2 * slope} * (y * {lines[-1][4]} - {low}), 0.0))) END"
    for turn, lines in _LINES.items() for s, v, slope, low, high in lines) + " END"
ORACLES["op13_curriculum"] = f"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
        coalesce(md5(doc_id::VARCHAR), '') AS digest FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM s),
    w AS (SELECT *, [5, 2, 1][turn + 1] AS weight, sum(source_size) OVER () AS words, sum([5, 2, 1][turn + 1]) OVER () AS weights FROM r),
    b AS (SELECT *, words - 3 * (sum(source_size) OVER n - source_size) AS rest, weights - (sum(weight) OVER n - weight) AS remains FROM w
        WINDOW n AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT source, source_size, turn, least(weight * (SELECT max_by(rest, rest / remains) FROM b)::DOUBLE
        / (SELECT max_by(remains, rest / remains) FROM b)::DOUBLE, (3 * source_size)::DOUBLE) AS target FROM w),
    c AS (SELECT d.*, t.source_size, t.turn, t.target, round(t.target)::BIGINT AS demand, (sum(size) OVER (PARTITION BY d.source
        ORDER BY digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS earlier FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    u AS (SELECT *, greatest(0, least(size, demand - earlier)) + greatest(0, least(size, demand - earlier - source_size))
        + greatest(0, least(size, demand - earlier - 2 * source_size)) AS taken, earlier / demand AS y FROM c)
    SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN {_DUE} END AS position FROM u"""


@query
def op13_curriculum(spark, sf_dir):
    from .curriculum import assigned, in_order

    return in_order(assigned(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLES["op12_hard_negatives"] = """
    WITH e AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
        AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r, a.id AS anchor_id, a.label = b.label AS same, b.id, b.r AS o, list_inner_product(a.v, b.v)::BIGINT AS score
        FROM e a JOIN e b ON a.r <> b.r WHERE a.id % 50 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id, o) AS k FROM s WHERE same),
    n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.id, s.o) AS rank,
        s.id AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON p.r = s.r AND NOT s.same
        AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.k <= 5)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@query
def op12_hard_negatives(spark, sf_dir):
    from .hardneg import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 50 == 0)


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLES["op11_collocations"] = f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    g AS (SELECT lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase FROM w),
    f AS (SELECT lang, phrase, count(*)::HUGEINT AS f, string_split(phrase, ' ') AS w, sum(CASE WHEN NOT contains(phrase, ' ') THEN count(*) END) OVER (PARTITION BY lang) AS n
        FROM g GROUP BY lang, phrase),
    c AS (SELECT * FROM f WHERE len(w) > 1 AND f >= 10),
    cut AS (SELECT *, unnest(range(1, len(w))) AS k FROM c),
    s AS (SELECT cut.*, x.f AS l, y.f AS r, 1000000 * cut.f * cut.f // (x.f * y.f) AS score FROM cut
        JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[:k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[k + 1:], ' ')),
    m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN (SELECT lang, f, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS part FROM c WHERE len(w) = 3) t
        ON s.lang = t.lang AND s.phrase = t.part AND 100 * t.f >= 50 * s.f),
    o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, f DESC, m.phrase) AS rank FROM m ANTI JOIN inside USING (lang, phrase))
    SELECT lang, rank::BIGINT AS rank, phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000"""


@query
def op11_collocations(spark, sf_dir):
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
