"""Near-duplicate documents by SimHash, linked through covering-code anchors.

A fingerprint has 64 bits.  Two that differ in at most three bits differ in at
most one bit in one of their halves.  Over each half lies a covering code: the
perfect Hamming code of length 31 (every word is within one bit of exactly one
code word) times one free bit, so its covering radius is 1.  A fingerprint is at
*home* at the anchor nearest to its half and *visits* every anchor within
radius + 1 = 2 bits of it: 17 anchors per half, 2 where the half is itself an
anchor.  If two halves differ in one bit, the second lies within 2 bits of the
first one's home, so homes met with visitors at equal anchors miss no link;
the whole fingerprints are compared there.  A half has 2**27 anchors, so random
fingerprints rarely meet: with F distinct ones about 34 F F / 2**27 comparisons.

Only distinct fingerprints take part, so copies never multiply, and groups are
found by contracting links: no document or link reaches the driver.

Defined results: null or empty texts have fingerprint zero and link like any
other; a null id takes part with its text, is never a smallest id, and its
group has a null id where no member has one; repeated rows are all returned;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, per_batch, prepared, stored, utf8

HASH = partial(xxhash.xxh64_intdigest, seed=42)
SHINGLE_WORDS, THRESHOLD = 3, 3
#: Shingles hashed at a time, so that a very long text stays within bounds.
BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text over its word shingles, as a signed 64-bit number."""
    w = text.lower().split()
    n = max(len(w) - words + 1, min(1, len(w)))
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for begin in range(0, n, BLOCK):
        part = w[begin:begin + min(BLOCK, n - begin) + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter(map(HASH, shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    def columns(batch):
        return {"doc_id": batch.column(0),
                "fp": pa.array([fingerprint(t) for t in utf8(batch.column(1))], pa.int64())}

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, id_col, text_col).mapInArrow(per_batch(columns), f"doc_id {kind}, fp long")


def _syndrome(half: Column) -> Column:
    """Place (1..31) of the bit in which the 31 low bits leave the code, 0 at a code word."""
    s = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        s = s + (F.bit_count(half.bitwiseAND(F.lit(mask))) % 2) * (1 << k)
    return s


def _flips(s: int) -> tuple[int, list[int]]:
    """For a syndrome: the bits to flip to reach home, and to reach each anchor within 2 bits."""
    home = 1 << (s - 1) if s else 0
    pairs = [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if s and i < i ^ s]
    return home, [home, home | 1 << 31, *pairs]


def links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v), u < v: every two of the distinct fingerprints ``nodes.fp`` that differ in at most ``threshold`` bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("the two-half code covers thresholds from 0 to 3")
    halves = (nodes.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
              .withColumn("h", F.when(F.col("half") == 0, F.col("fp"))
                          .otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF)))
              .withColumn("s", _syndrome(F.col("h")) + 1))
    tables = [_flips(s) for s in range(32)]
    lists = ", ".join("array(" + ", ".join(f"{m}L" for m in visits) + ")" for _, visits in tables)
    to_home = F.expr("element_at(array(" + ", ".join(f"{home}L" for home, _ in tables) + "), s)")
    key = F.col("half").cast("long") * F.lit(1 << 32)
    homes = halves.select((key + F.col("h").bitwiseXOR(to_home)).alias("anchor"), F.col("fp").alias("u"))
    visitors = (halves.select("half", "h", "fp", F.explode(F.expr(f"element_at(array({lists}), s)")).alias("m"))
                .select((key + F.col("h").bitwiseXOR(F.col("m"))).alias("anchor"), F.col("fp").alias("v")))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    first_half = F.bit_count(differ.bitwiseAND(F.lit(0xFFFFFFFF))) <= 1
    # 17 visitors a half come out of a table that is small when it is read: neither side is to be broadcast
    return (homes.join(visitors.hint("merge"), "anchor")
            .where((F.col("u") < F.col("v")) & (F.bit_count(differ) <= threshold)
                   & ((F.col("anchor") < 1 << 32) == first_half))  # the half that must find a link reports it
            .select("u", "v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an edge.

    Each round moves every node to its smallest neighbour and carries the edges
    along, until none is left; rounds grow with the logarithm of a group's size.
    """
    edges, roots = stored(edges.select("u", "v"), "links"), None
    while not edges.isEmpty():
        ends = edges.union(edges.select("v", "u"))
        moves = stored(ends.groupBy("u").agg(F.min("v").alias("v"))
                       .select(F.col("u").alias("node"), F.least("u", "v").alias("to")), "moves")
        if roots is None:
            roots = moves.select("node", F.col("to").alias("root"))
        else:
            roots = roots.join(moves.select(F.col("node").alias("root"), "to"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root"))
        roots = stored(roots, "roots")
        moved = (edges.join(moves.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").select("v", "a")
                 .join(moves.select(F.col("node").alias("v"), F.col("to").alias("b")), "v"))
        edges = stored(moved.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
                       .distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) if roots is None else roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) of every row; see the module's text."""
    prepared(docs.sparkSession)
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes, threshold))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("low"))
    low = stored(linked.select("fp", "root").join(smallest, "root").select("fp", "low"), "lows")
    of_fp = stored(nodes.join(low, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id")), "groups")
    return marked.join(of_fp, "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that are not the smallest id of their group; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
