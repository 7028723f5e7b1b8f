"""Hard negatives for contrastive training, found by coordinate pruning over length buckets.

Vectors are made whole numbers, x -> floor(256 x), so scores are exact.  An
anchor's positives are the best rows of its own label; a hard negative of a
positive is among the best rows of other labels whose score lies between two
shares of the positive's score.

Rows are put in order of label and falling length and cut into *buckets* of
similar length, each stored with its rows' unit vectors as one sorted list per
coordinate.  A search for scores of at least s with an anchor q over a bucket
whose longest row is l needs a cosine of c = s / (|q| l): none if c > 1.  A unit
vector within the angle acos(c) of the anchor's direction has, at coordinate f,
an angle to the axis that differs by at most as much from the anchor's own, so
its value lies in a feasible range, a stretch of the sorted list.  The lists of
the anchor's ``FOCUS`` largest coordinates are cut that way and intersected; only
rows in all stretches are scored.  The bar s rises with the best rows found so
far in the buckets gone through before, longest rows first.

Anchors meet rows in blocks: a *shelf* of buckets with at most some ``TOGETHER``
anchors, each pair being one group of a co-group.  The pairs come from a join on
the labels that shelves hold (positives), or from each block of anchors with every
shelf that is long enough for its lowest bar (negatives).  What a block finds, at
most k rows an anchor or band, is merged by Spark.

Defined results: rows with a null id, label or vector or a component that is null
or not finite take no part; vectors shorter than others count as ended by zeros;
scores have to fit a long; rows with equal ids are rows of their own, and as
anchors each is answered; ties go to the smaller id; an anchor without
positives, or a positive without rows in its band (always where its score is
negative), gives no row; an empty table gives an empty result.
"""

from __future__ import annotations

from math import acos, cos, pi

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, stored

SCALE = 256
#: Rows in a bucket, in a shelf, and anchors that meet a shelf in one task, about.
BUCKET, SHELF, TOGETHER = 2048, 16_384, 2048
#: A block has up to two to this power anchors.
BLOCK_BITS = 8
#: Coordinates by which candidates are cut.
FOCUS = 4
#: Beyond this a sum of whole numbers is not exact as a double.
EXACT = float(1 << 53)
#: More than the rounding of any cosine or coordinate.
SLACK = 1e-9


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, id, label, vec, length) of the rows that take part; vec holds whole numbers."""
    vec = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: F.floor(x * SCALE).cast("long"))
    ok = F.forall(F.col(f"`{vector_col}`"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    known = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                           F.col(f"`{label_col}`").cast("long").alias("label"), F.when(ok, vec).alias("vec")).dropna()
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return known.withColumn("length", length)


def _matrix(vecs: pa.Array) -> np.ndarray:
    """Rows of whole numbers, ended by zeros where they are shorter."""
    sizes = np.diff(vecs.offsets.to_numpy())
    flat = vecs.flatten().to_numpy()
    out = np.zeros((len(vecs), max(1, sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """The same numbers in the least bytes."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    return a.astype(np.result_type(np.min_scalar_type(low), np.min_scalar_type(high), np.int8))


def _coordinate_order(m: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per coordinate the rows in the order of their unit vectors' values there."""
    return np.argsort((m / np.maximum(lengths, 1e-300)[:, None]).T, axis=1, kind="stable")


def shelves(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per bucket: its shelf, labels, lengths, numbers and coordinate lists, in the least bytes."""
    columns = ("shelf long, bucket int, n int, dims int, longest double, labels array<long>, ids binary, rows binary, "
               "of binary, lengths binary, kind string, numbers binary, order binary")

    def run(batches):
        shelf, nth, held, have = TaskContext.get().partitionId(), 0, [], 0

        def cut(table):
            nonlocal nth
            col = {k: table[k].combine_chunks() for k in ("id", "row", "label", "vec", "length")}
            m, lengths, labels = _matrix(col["vec"]), col["length"].to_numpy(), col["label"].to_numpy()
            small, order = _small(m), _coordinate_order(m, lengths)
            nth += 1
            return pa.RecordBatch.from_pylist([{
                "shelf": shelf, "bucket": nth - 1, "n": len(table), "dims": m.shape[1], "longest": float(lengths.max()), "labels": np.unique(labels).tolist(),
                "ids": col["id"].to_numpy().tobytes(), "rows": col["row"].to_numpy().tobytes(), "of": labels.tobytes(), "lengths": lengths.tobytes(),
                "kind": small.dtype.str, "numbers": small.tobytes(), "order": order.astype(np.uint16).tobytes()}], schema=_arrow(columns))

        def ready(table, last):
            """A bucket ends where it is full, or where the label changes and it is not very small."""
            while len(table) and (last or len(table) >= bucket):
                labels = table["label"].to_numpy()[:bucket]
                change = np.flatnonzero(labels[1:] != labels[:-1]) + 1
                change = change[change >= bucket // 8]
                n = int(change[0]) if len(change) else min(bucket, len(table))
                yield cut(table.slice(0, n))
                table = table.slice(n)
            return table

        for batch in batches:
            held.append(batch)
            have += batch.num_rows
            if have >= bucket:
                left = yield from ready(pa.Table.from_batches(held), False)
                held, have = left.to_batches(), len(left)
        if have:
            yield from ready(pa.Table.from_batches(held), True)

    return rows.mapInArrow(run, columns)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(k, kinds[v]) for k, v in (c.split(" ") for c in ddl.split(", "))])


class Bucket:
    """A bucket in a task."""

    def __init__(self, r: dict):
        self.n, self.dims, self.longest = r["n"], r["dims"], r["longest"]
        self.ids, self.rows, self.labels = (np.frombuffer(r[k], np.int64) for k in ("ids", "rows", "of"))
        numbers = np.frombuffer(r["numbers"], r["kind"]).reshape(self.n, self.dims)
        self.largest = int(np.abs(numbers.astype(np.int64)).max(initial=0))
        self.numbers = numbers.astype(np.float64 if self.largest < EXACT else np.int64)
        self.whole = None if self.largest < EXACT else self.numbers
        self.lengths = np.frombuffer(r["lengths"], np.float64)
        self.order = np.frombuffer(r["order"], np.uint16).reshape(self.dims, self.n)
        self.lists: dict[int, np.ndarray] = {}

    def sorted_list(self, f: int) -> np.ndarray:
        if f not in self.lists:
            mine = self.order[f]
            self.lists[f] = self.numbers[mine, f] / np.maximum(self.lengths[mine], 1e-300)
        return self.lists[f]

    def candidates(self, q: "Anchor", bar: float) -> np.ndarray | None:
        """Rows that may score at least ``bar``; None for all, where no list cuts anything off."""
        if bar <= 0:
            return None
        if q.length * self.longest <= 0 or (c := bar / (q.length * self.longest)) > 1 + SLACK:
            return np.zeros(0, np.int64)
        wide, found, cuts = acos(min(1.0, c)), None, 0
        for f in q.focus:
            if f >= self.dims:
                continue
            own = acos(max(-1.0, min(1.0, q.unit[f])))
            low, high = cos(min(pi, own + wide)) - SLACK, cos(max(0.0, own - wide)) + SLACK
            values = self.sorted_list(f)
            a, b = np.searchsorted(values, low), np.searchsorted(values, high, "right")
            if a == 0 and b == self.n:
                continue
            found = np.zeros(self.n, np.uint8) if found is None else found
            found[self.order[f][a:b]] += 1
            cuts += 1
        return None if found is None else np.flatnonzero(found == cuts)

    def scores(self, q: "Anchor", some: np.ndarray | None) -> np.ndarray:
        """Exact scores of these rows."""
        d = min(self.dims, len(q.vec))
        m = self.numbers[:, :d] if d < self.dims else self.numbers
        m = m if some is None else m[some]
        if self.whole is None and q.largest * self.largest * max(d, 1) < EXACT:
            return (m @ q.vec[:d].astype(np.float64)).astype(np.int64)
        return m.astype(np.int64) @ q.vec[:d]


class Anchor:
    def __init__(self, row: int, label: int, vec: np.ndarray, length: float):
        self.row, self.label, self.vec, self.length = row, label, vec, length
        self.unit = vec / max(length, 1e-300)
        self.focus = np.argsort(-np.abs(self.unit), kind="stable")[:FOCUS].tolist()
        self.largest = int(np.abs(vec).max(initial=0))


class Best:
    """The best k rows so far whose score lies between two bounds; ``bar`` is the score a further one must reach."""

    def __init__(self, k: int, low: int, high: int | None):
        self.k, self.low, self.high, self.held = k, low, high, []
        self.bar = low

    def offer(self, s: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        hit = s >= self.bar
        if self.high is not None:
            hit &= s <= self.high
        at = np.flatnonzero(hit)
        if len(at):
            if len(at) > self.k:
                at = at[np.lexsort((rows[at], ids[at], -s[at]))[:self.k]]
            self.held = sorted(self.held + [(-int(s[i]), int(ids[i]), int(rows[i])) for i in at])[:self.k]
            if len(self.held) == self.k:
                self.bar = max(self.low, -self.held[-1][0])


LEAST = -(1 << 63)
_FOUND = "row long, label long, anchor_id long, band long, score long, other_id long, other_row long"


def _positives(k: int):
    """For a co-group: the best k rows of the same label per anchor."""
    return lambda q, bucket: (q.label == bucket.labels) & (q.row != bucket.rows), lambda bands: [(None, Best(k, LEAST, None))]


def _negatives(k: int, low: int, high: int):
    """For a co-group: the best k rows of other labels per band, from ``low`` to ``high`` hundredths of a positive's score."""
    return lambda q, bucket: q.label != bucket.labels, lambda bands: [(b, Best(k, -(-low * b // 100), high * b // 100)) for b in bands]


def _meet(rules):
    """A co-group's work: the anchors of a block against the buckets of a shelf, longest rows first."""
    mine, wanted = rules

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        vecs, small = _matrix(left["vec"].combine_chunks()), left.drop_columns(["vec"]).to_pylist()
        anchors = [(Anchor(a["row"], a["label"], v, a["length"]), a["anchor_id"], wanted(a["bands"] or [])) for a, v in zip(small, vecs)]
        for r in sorted(right.to_pylist(), key=lambda r: (-r["longest"], r["bucket"])):
            bucket = Bucket(r)
            for q, _, bests in anchors:
                ok = mine(q, bucket)
                if not ok.any():
                    continue
                bar = min(b.bar for _, b in bests)
                some = bucket.candidates(q, float(bar))
                at = np.flatnonzero(ok) if some is None else some[ok[some]]
                if not len(at):
                    continue
                s = bucket.scores(q, None if len(at) == bucket.n else at)
                good = np.flatnonzero(s >= bar)
                if len(good):
                    at, s = at[good], s[good]
                    for _, b in bests:
                        b.offer(s, bucket.ids[at], bucket.rows[at])
        rows = [(q.row, q.label, name, band, -s, i, r) for q, name, bests in anchors for band, best in bests for s, i, r in best.held]
        return pa.Table.from_pylist([dict(zip(_FOUND_NAMES, r)) for r in rows], schema=_arrow(_FOUND))

    return run


_FOUND_NAMES = [c.split(" ")[0] for c in _FOUND.split(", ")]


def _blocks(anchors: DataFrame, pairs: DataFrame, buckets: DataFrame, rules) -> DataFrame:
    """What every block of anchors finds on each shelf that it is paired with (block, shelf)."""
    counts = anchors.groupBy("block").agg(F.count("*").alias("many"))
    sized = pairs.join(counts, "block")
    slots = sized.groupBy("shelf").agg(F.ceil(F.sum("many") / TOGETHER).alias("slots"))
    dealt = stored(sized.join(slots, "shelf").select("block", "shelf", F.pmod(F.xxhash64("block"), "slots").alias("slot")), "pairs")
    left = anchors.join(dealt, "block").select("shelf", "slot", "row", "anchor_id", "label", "vec", "length", "bands")
    wanted = dealt.select(F.col("shelf").alias("at_shelf"), F.col("slot").alias("at_slot")).distinct()
    right = buckets.join(wanted, F.col("shelf") == F.col("at_shelf")).drop("shelf")
    return left.groupBy("shelf", "slot").cogroup(right.groupBy("at_shelf", "at_slot")).applyInArrow(_meet(rules), _FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of what was found, per anchor and band, ranked."""
    order = Window.partitionBy("row", "label", "anchor_id", "band").orderBy(F.desc("score"), "other_id", "other_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), see the module's text.

    ``anchors`` is a condition on the column ``id``; a negative's score is from ``low`` to ``high`` hundredths of the positive's.
    """
    spark = prepared(vectors.sparkSession)
    rows = stored(whole(vectors, id_col, vector_col, label_col), "vectors")
    order = ["label", F.desc("length"), "id", "row"]
    buckets = stored(shelves(rows.repartitionByRange(max(1, -(-rows.count() // SHELF)), *order).sortWithinPartitions(*order)), "buckets")
    last = buckets.agg(F.max("shelf")).first()[0]
    # anchors of a block follow each other in that order, so they share label and length as far as can be
    asked = rows.where(anchors).repartitionByRange(*order).sortWithinPartitions(*order).withColumnRenamed("id", "anchor_id")
    asked = stored(asked.withColumn("block", F.shiftrightunsigned(F.monotonically_increasing_id(), BLOCK_BITS)), "anchors")
    shelf_labels = buckets.select("shelf", F.explode("labels").alias("label")).distinct()
    none = F.lit(None).cast("array<long>")
    near = asked.select("block", "label").distinct().join(shelf_labels, "label").select("block", "shelf").distinct()
    best = stored(_merged(_blocks(asked.withColumn("bands", none), near, buckets, _positives(positives)), positives)
                  .select("row", "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    banded = stored(asked.join(best.where("positive_score >= 0").groupBy("row").agg(F.collect_set("positive_score").alias("bands")), "row"), "bands")
    # a block may skip a shelf whose longest row cannot bring its longest anchor to its lowest bar
    need = banded.groupBy("block").agg(F.max("length").alias("far"), F.min(F.array_min("bands")).alias("least"))
    reach = buckets.groupBy("shelf").agg(F.max("longest").alias("longest"))
    every = need.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))).alias("shelf")).join(reach, "shelf")
    pairs = every.where(F.col("far") * F.col("longest") * (1 + SLACK) * 100 >= F.col("least") * low).select("block", "shelf")
    found = _merged(_blocks(banded, pairs, buckets, _negatives(negatives, low, high)), negatives)
    return best.join(found.select("row", F.col("band").alias("positive_score"), "rank", F.col("other_id").alias("negative_id"),
                                  F.col("score").alias("negative_score")), ["row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
