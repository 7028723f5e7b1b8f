"""Nearest neighbours for many targets (T9): exact, and by random-hyperplane signatures.

Both ways meet targets and rows in *blocks*.  A key says which rows a target is
compared with: one key for all rows of a length of vector (exact), or one per
band of a signature (approximate).  A key's rows and targets are cut into parts of
bounded size, the rows of a part are sent to every part of the targets and the
other way round, and each pair of parts is one group: a matrix product and, per
target, the best k of the block.  Spark merges those; nothing is joined without a
key, and a bucket that holds a third of all rows is cut like any other, copies too.

Approximate: the signs of a vector's products with fixed random planes make
``bands`` signatures of ``bits`` bits; a target meets the rows that agree with it
on a whole band.  Two vectors at an angle t agree on a bit with 1 - t / pi, so
they meet with 1 - (1 - (1 - t / pi)**bits)**bands; what meets is scored exactly.

Defined results: rows and targets with a null id or vector, with a null or
non-finite component or of length zero are no one's neighbours; vectors of other
dimensions never meet; similarities are compared to twelve decimals and ties go to
the smaller id; rows with equal ids are returned each; a target that is among the
rows finds itself; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and targets in a part.
ROWS, TARGETS = 8192, 4096
BANDS, BITS, SEED = 24, 6, 7
#: Decimals by which similarities are told apart, more than their rounding, and targets in one matrix product.
DECIMALS, SLACK, SLICE = 12, 1e-11, 256


def _usable(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    """(name, vec) of the rows that can be neighbours."""
    fine = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    return (df.select(F.col(f"`{id_col}`").alias(name), F.col(f"`{vector_col}`").cast("array<double>").alias("vec")).dropna()
            .withColumn("vec", F.when(F.forall("vec", lambda x: ~F.coalesce(F.isnan(x), F.lit(False))), F.col("vec"))).dropna().filter(fine))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row", F.monotonically_increasing_id())


def _unit(vecs: pa.ChunkedArray) -> np.ndarray:
    flat = vecs.combine_chunks()
    m = flat.flatten().to_numpy().reshape(len(flat), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # before the squares, which could overflow
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _best(k: int, least: float, schema: pa.Schema):
    """For a co-group of rows and targets: the best k rows per target, at least so similar."""
    def run(rows: pa.Table, targets: pa.Table) -> pa.Table:
        if not rows.num_rows or not targets.num_rows:
            return schema.empty_table()
        place = np.empty(rows.num_rows, np.int64)  # among the ids, for ties
        place[pc.sort_indices(rows["id"].combine_chunks()).to_numpy()] = np.arange(rows.num_rows)
        a, b, found, similar = _unit(rows["vec"]), _unit(targets["vec"]), [], []
        for begin in range(0, len(b), SLICE):
            for s in b[begin:begin + SLICE] @ a.T:
                at = np.flatnonzero(s >= least - SLACK)
                if len(at) > 4 * k:  # no tie at the last place is cut off here
                    at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k] - SLACK]
                s = np.round(s[at], DECIMALS)
                best = np.lexsort((place[at], -s))
                best = best[s[best] >= least][:k]
                found.append(at[best])
                similar.append(s[best])
        at, of = np.concatenate(found), np.repeat(np.arange(len(b)), [len(f) for f in found])
        return pa.Table.from_arrays([targets["target_id"].take(pa.array(of)), rows["id"].take(pa.array(at)), rows["row"].take(pa.array(at)),
                                     pa.array(np.concatenate(similar))], schema=schema)

    return run


def _met(rows: DataFrame, targets: DataFrame, key: list[str], k: int, least: float) -> DataFrame:
    """(target_id, id, similarity): what each block of a key's rows and targets finds."""
    def parts(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.ceil(F.count("*") / size).alias(name))

    sizes = parts(rows, ROWS, "row_parts").join(parts(targets, TARGETS, "target_parts"), key)
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = (rows.join(sizes, key).withColumn("row_part", F.pmod(F.xxhash64("row"), "row_parts"))
            .withColumn("target_part", copies("target_parts")))
    right = (targets.join(sizes, key).withColumn("target_part", F.pmod(F.xxhash64("target_id", "vec"), "target_parts"))
             .withColumn("row_part", copies("row_parts")))
    by = [*key, "row_part", "target_part"]
    kinds = f"target_id {targets.schema['target_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, row long, similarity double"
    right = right.select(*[F.col(c).alias(f"t_{c}") for c in by], "target_id", "vec").groupBy(*[f"t_{c}" for c in by])
    return (left.select(*by, "row", "id", "vec").groupBy(*by).cogroup(right)
            .applyInArrow(_best(k, least, to_arrow_schema(T.DataType.fromDDL(kinds))), kinds))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("target_id").orderBy(F.desc("similarity"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("target_id", "rank", "id", "similarity")


def similar_many(rows: DataFrame, targets: DataFrame, k: int = 10, min_sim: float = 0.5, id_col: str = "id", vector_col: str = "embedding",
                 target_id: str = "id", target_vector: str = "embedding") -> DataFrame:
    """(target_id, rank, id, similarity), the exact k nearest rows of every target; each target's id is taken once."""
    dims = F.size("vec").alias("dims")
    r = _numbered(_usable(rows, id_col, vector_col, "id")).select("*", dims)
    t = _usable(targets, target_id, target_vector, "target_id").select("*", dims)
    return _ranked(_met(r, t, ["dims"], k, min_sim), k)


def signatures(vec: Column, bands: int = BANDS, bits: int = BITS, seed: int = SEED) -> Column:
    """The bands' signatures of a vector, one whole number each."""
    @F.arrow_udf("array<int>")
    def sign(v: pa.Array) -> pa.Array:
        sizes, out = pc.list_value_length(v).to_numpy(), np.zeros((len(v), bands), np.int32)
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            planes = np.random.default_rng([seed, d]).standard_normal((d, bands * bits))
            above = v.take(pa.array(at)).flatten().to_numpy().reshape(-1, d) @ planes > 0
            out[at] = above.reshape(-1, bands, bits) @ (1 << np.arange(bits))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * bands), pa.array(out.reshape(-1)))

    return sign(vec)


def similar_banded(rows: DataFrame, targets: DataFrame, k: int = 10, min_sim: float = 0.5, bands: int = BANDS, bits: int = BITS,
                   id_col: str = "id", vector_col: str = "embedding", target_id: str = "id", target_vector: str = "embedding") -> DataFrame:
    """T9, approximate: as :func:`similar_many`, among the rows that agree with the target on a band."""
    def banded(df: DataFrame) -> DataFrame:
        return df.select("*", F.size("vec").alias("dims"), F.posexplode(signatures(F.col("vec"), bands, bits)).alias("band", "signature"))

    found = _met(banded(_numbered(_usable(rows, id_col, vector_col, "id"))), banded(_usable(targets, target_id, target_vector, "target_id")),
                 ["dims", "band", "signature"], k, min_sim)
    return _ranked(found.distinct(), k)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """One row: how many of the exact neighbours the approximate form found."""
    hit = exact.select("target_id", "id").join(approximate.select("target_id", "id", F.lit(1).alias("hit")), ["target_id", "id"], "left")
    return hit.agg(F.count("*").alias("neighbours"), F.count("hit").alias("found")).withColumn("recall", F.try_divide("found", "neighbours"))
