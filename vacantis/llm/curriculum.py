"""Mixing sources to target weights along a curriculum that changes with training.

Every source has a weight schedule: straight lines between knots (time, weight),
time running from 0 to 1.  Its integral W(t) gives the source's weight W(1), from
which its target follows, and its demand by time t: target * W(t) / W(1) words.
A document whose words begin c words into its source's order is due when the
demand reaches c, so its training position is the inverse t = W^-1(c W(1) / target);
sorting by position gives a stream in which each source's share follows its
schedule at every moment.  A source that is wanted more than once is passed over
again, and the last pass ends where the target does, within a document.

Targets share out all words by weight; none goes beyond ``MOST`` times its source,
and what is above goes to the other sources by weight until none is above.  The
level at which this rests is found in one pass over the sources by falling need.

Sources and documents are ordered by range partitions, and sums before a row are
those of its partition plus those of the partitions before, so a source with most
of the rows is cut like any other.  Within a source documents are ordered by the
MD5 digest of their id, so reruns agree.

Defined results: null texts have no words; a null source is the last one; null
ids come first in their source; rows that are equal are told apart by nothing and
taken one after the other; a document that is not taken has no position; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, per_batch, prepared, stored, utf8

#: A source is used at most so many times.
MOST = 3
#: Schedules of the sources in turn, (time, weight): one that falls, one that stays, one that rises; their means are 5, 2 and 1.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
#: Bytes looked at together, so that a very long text stays within bounds.
BLOCK = 1 << 20

Schedule = Sequence[tuple[float, float]]


def words_in(text: bytes) -> int:
    """Number of words, counted at their first bytes."""
    found, gap_before = 0, True
    for begin in range(0, len(text), BLOCK):
        a = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - begin), begin)
        gap = (a == 32) | (a - np.uint8(9) < 5)
        found += int(np.count_nonzero(gap[:-1] & ~gap[1:])) + int(gap_before and not gap[0])
        gap_before = bool(gap[-1])
    return found


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size) of every row."""
    def columns(batch):
        return {"doc_id": batch.column(0), "source": batch.column(1),
                "size": pa.array([words_in(t) for t in utf8(batch.column(2))], pa.int64())}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = only(docs, id_col, source_col, text_col).toDF("doc_id", "source", "text")
    return rows.withColumn("source", F.col("source").cast("string")).mapInArrow(
        per_batch(columns), f"doc_id {kind}, source string, size long")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], kind: str) -> DataFrame:
    """``df`` with the sums over all rows before each one in this order.

    The order is cut into ranges; the table of sums per range has a row for each.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), kind)
    totals = dealt.groupBy("part").agg(*(F.sum(c).alias(f"of_{k}") for k, c in sums.items()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", *(F.sum(f"of_{k}").over(earlier).alias(f"base_{k}") for k in sums))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return (dealt.withColumns({k: F.coalesce(F.sum(c).over(within), zero) for k, c in sums.items()})
            .join(bases, "part").withColumns({k: F.col(k) + F.coalesce(F.col(f"base_{k}"), zero) for k in sums})
            .drop("part", *(f"base_{k}" for k in sums)))


def weight(schedule: Schedule) -> float:
    """The integral of a schedule."""
    return sum((t - s) * (v + w) / 2 for (s, v), (t, w) in zip(schedule, schedule[1:]))


def due(schedule: Schedule, share: Column) -> Column:
    """The time by which this share of a schedule's integral has passed."""
    whole, before, at = weight(schedule), 0.0, F.lit(float(schedule[-1][0]))
    lines = []
    for (s, v), (t, w) in zip(schedule, schedule[1:]):
        area = (t - s) * (v + w) / 2
        if area:
            lines.append((s, v, (w - v) / (t - s), before, before + area))
            before += area
    for s, v, slope, low, high in reversed(lines):
        rest = share * whole - low
        # the root of v x + slope x x / 2 = rest that stays exact as the slope goes to 0
        x = 2 * rest / (v + F.sqrt(F.greatest(F.lit(v * v) + 2 * slope * rest, F.lit(0.0))))
        at = F.when(share * whole < high, F.when(rest <= 0, F.lit(s)).otherwise(F.lit(s) + x)).otherwise(at)
    return at


def targets(rows: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST) -> DataFrame:
    """(source, source_size, before, turn, target): ``before`` are the words of earlier sources, ``turn`` the schedule's number."""
    of = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(of, [F.col("source").asc_nulls_last()], {"before": F.col("source_size"), "place": F.lit(1)}, "sources")
    weights = F.array(*(F.lit(float(weight(s))) for s in schedules))
    ranked = stored(ranked.withColumn("turn", (F.col("place") % len(schedules)).cast("int"))
                    .withColumn("weight", F.element_at(weights, F.col("turn") + 1)), "ranked")
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    words, all_weight = whole[0] or 0, whole[1] or 1.0
    # in the order of size by weight, the level if all before are at their bound; it is highest where none after is
    full = F.col("source_size") * most
    by_need = running(ranked, [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()],
                      {"bound": full, "taken_weight": F.col("weight")}, "needs")
    rest, left = F.lit(words) - F.col("bound"), F.lit(all_weight) - F.col("taken_weight")
    level = by_need.agg(F.max_by(F.struct(rest.alias("rest"), left.alias("left")), rest / left)).first()[0]
    rest, left = (level["rest"], level["left"]) if level else (0, 1.0)
    fair = F.col("weight") * F.lit(float(rest)) / F.lit(float(left))
    return ranked.select("source", "source_size", "before", "turn", F.least(fair, full.cast("double")).alias("target"))


def assigned(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST, id_col: str = "doc_id",
             source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, passes) of every row; passes: (pass, words, position) of each use."""
    prepared(docs.sparkSession)
    rows = stored(sized(docs, id_col, source_col, text_col), "sizes").withColumn(
        "digest", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")))
    of = targets(rows, schedules, most)
    placed = running(rows, [F.col("source").asc_nulls_last(), F.col("digest"), F.col("doc_id"), F.col("size")], {"earlier": F.col("size")}, "placed")
    known = placed.join(of.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    demand = F.round("target").cast("long")
    uses = []
    for n in range(most):
        start = F.col("earlier") - F.col("before") + n * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), demand - start))
        share = F.try_divide(start, demand)
        at = F.lit(None).cast("double")
        for turn, schedule in enumerate(schedules):
            at = F.when(F.col("turn") == turn, due(schedule, share)).otherwise(at)
        uses.append(F.struct(F.lit(n).alias("pass"), words.alias("words"), at.alias("position")))
    passes = F.filter(F.array(*uses), lambda u: u["words"] > 0)
    return known.withColumn("passes", passes).select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("passes", F.lit(0).cast("long"), lambda s, u: s + u["words"]).alias("taken"), "passes")


def mixed(marked: DataFrame) -> DataFrame:
    """The uses of all documents in the order of training: (position, doc_id, source, pass, words), sorted by ranges of position."""
    uses = marked.select("doc_id", "source", F.explode("passes").alias("u")).select("u.position", "doc_id", "source", "u.pass", "u.words")
    order = ["position", "source", "doc_id", "pass"]
    return uses.repartitionByRange(*order).sortWithinPartitions(*order)


def in_order(marked: DataFrame) -> DataFrame:
    """The documents sorted by ranges of their first position, those that are not taken last."""
    first = marked.withColumn("position", F.get("passes", F.lit(0))["position"])
    order = [F.col("position").asc_nulls_last(), F.col("source"), F.col("doc_id")]
    return first.drop("passes").repartitionByRange(*order).sortWithinPartitions(*order)
