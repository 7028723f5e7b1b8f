"""Benchmark decontamination by spaced seeds.

Words are cut at white space, lower-cased (A-Z) and stripped of ASCII
punctuation at their ends.  A mask names places within a short span; the words
at those places, hashed together, are a seed, and the places between are
ignored, so a seed survives substitutions there.  The seeds of the benchmark's
items are a table and so are those of the documents; they are joined by hash,
and around each hit the item is laid against the document at that distance.

An item of ``OVERLAP`` words or more leaks where an aligned stretch of that many
words, agreeing at both ends, has at least ``IDENTITY`` of its words the same.  A
shorter item leaks where at least that share of all its words agree, wherever the
others are; words beyond the document's ends do not agree.  For it the masks are
the parts of which one must be untouched: of 10 to 12 words with two substitutions
a third, of 6 to 9 words with one a half, of 5 words any four, below that the item.

One pass is made over the documents, whatever the benchmark's size: a filter of
fixed size over the benchmark's seeds drops most of a document's seeds before they
become rows; it drops only what no item has.  Equal items are one until the end.
Seeds that stand in many documents and items are cut by salt on both sides.

Defined results: null and empty texts leak nothing, and items without words are no
evidence; a null item id is reported as null; repeated items and documents are
reported each; an empty table on either side gives an empty result.  ``docs`` must
give its rows in the same order when it is read again, as stored tables do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, bits_at, eased, only, per_batch, prepared, stored, utf8

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 6), (0, 2, 3, 5, 8))
#: Masks of items that are shorter than OVERLAP.
SHORT_MASKS = ((0,), (0, 1), (0, 1, 2), (0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4), (0, 1, 2, 3, 4))
EVERY_MASK = tuple(dict.fromkeys([*MASKS, *SHORT_MASKS]))
IDENTITY, OVERLAP = 0.8, 13
#: Bits, as a power of two, of the filter over the benchmark's seeds, and how many of them a seed sets.
TABLE, PROBES = 25, 3
#: Places of a seed, in documents or items, that meet in one group.
TOGETHER = 5000
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MIX = [np.uint64(2 * xxhash.xxh64_intdigest(f"place {k}") + 1 & (1 << 64) - 1) for k in range(16)]


def word_hashes(text: bytes) -> np.ndarray:
    words = [w for w in (w.strip(PUNCTUATION) for w in text.lower().split()) if w]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the mask's words at every start where it fits; masks differ in the hash too."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, EVERY_MASK.index(mask), np.uint64) * _MIX[-1]
    for k, place in enumerate(mask):
        out += words[place:place + n] * _MIX[k]
    return out ^ (out >> np.uint64(31))


def item_seeds(words: np.ndarray, identity: float = IDENTITY, overlap: int = OVERLAP) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(mask numbers, seeds, starts) of an item: all of a long one, those of which one must be untouched of a short one."""
    n = len(words)
    if n >= overlap:
        parts = [(m, start) for m in MASKS for start in range(max(0, n - m[-1]))]
    else:
        wrong = n - needed(n, identity)
        if n == 5 and wrong == 1:
            parts = [((0, 1, 2, 3), 0), ((0, 1, 2, 3), 1), ((0, 2, 3, 4), 0), ((0, 1, 3, 4), 0), ((0, 1, 2, 4), 0)]
        else:
            cuts = [n * k // (wrong + 1) for k in range(wrong + 2)]
            parts = [(tuple(range(min(b - a, 5))), a) for a, b in zip(cuts, cuts[1:]) if b > a]
    kinds = [EVERY_MASK.index(m) for m, _ in parts]
    by = {m: seeds(words, m) for m in {m for m, _ in parts}}
    return kinds, np.array([by[m][start] for m, start in parts], np.uint64), np.array([start for _, start in parts], np.int64)


def needed(n: int, identity: float) -> int:
    """How many words of a short item must agree."""
    return int(np.ceil(identity * n - 1e-9))


def probes(seed: np.ndarray) -> list[np.ndarray]:
    """The filter's bits of seeds."""
    return [(seed * _MIX[k]) >> np.uint64(64 - TABLE) for k in range(PROBES)]


def stretch(item: np.ndarray, doc: np.ndarray, shift: int, identity: float, overlap: int) -> tuple[int, int, int, int] | None:
    """(words, agreeing, -document start, -item start) of what an item leaks at one distance, if it does."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[low:high] == doc[low + shift:high + shift]
    if len(item) < overlap:
        agree = int(same.sum())
        return (high - low, agree, -(low + shift), -low) if agree and agree >= needed(len(item), identity) else None
    begin, size, agree = longest(same, identity)
    return (size, agree, -(low + shift + begin), -(low + begin)) if size >= overlap else None


def longest(same: np.ndarray, identity: float) -> tuple[int, int, int]:
    """(begin, size, agreeing) of the longest stretch, agreeing at both ends, with at least that share of agreement."""
    at = np.flatnonzero(same)
    best = (0, 0, 0)
    if not len(at):
        return best
    # agreement minus share, summed before each place; a stretch is good if the sum does not fall
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - identity, -identity))])
    lows = np.minimum.accumulate(total[at])  # lowest sum before any agreeing place so far
    for e in at[::-1].tolist():
        if e + 1 - at[0] <= best[1]:
            break
        k = int(np.searchsorted(-lows, -(total[e + 1] + 1e-9), "left"))  # first place from which the sum does not fall
        begin = int(at[k]) if k < len(at) else e + 1
        if begin <= e and e + 1 - begin > best[1]:
            best = (begin, e + 1 - begin, int(same[begin:e + 1].sum()))
    return best


def _items(benchmark: DataFrame, identity: float, overlap: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(key, item_id) of the items that have words, and (key, words, masks, seeds, starts) of the distinct ones."""
    kind = benchmark.schema[item_col].dataType.simpleString()

    def columns(batch):
        words = [word_hashes(t) for t in utf8(batch.column(1))]
        return {"item_id": batch.column(0), "words": pa.array([w.tobytes() for w in words], pa.binary())}

    def own(batch):
        found = [item_seeds(np.frombuffer(w, np.uint64), identity, overlap) for w in batch.column(1).to_pylist()]
        return {"key": batch.column(0), "words": batch.column(1), "masks": pa.array([sorted(set(k)) for k, _, _ in found], pa.list_(pa.int32())),
                "seeds": pa.array([s.view(np.int64) for _, s, _ in found], pa.list_(pa.int64())), "starts": pa.array([t for _, _, t in found], pa.list_(pa.int64()))}

    items = stored(only(benchmark, item_col, text_col).mapInArrow(eased(per_batch(columns)), f"item_id {kind}, words binary")
                   .where(F.length("words") > 0).withColumn("key", F.sha2("words", 256)), "benchmark")
    distinct = items.groupBy("key").agg(F.first("words").alias("words"))
    return items.select("key", "item_id"), stored(distinct.mapInArrow(
        eased(per_batch(own)), "key string, words binary, masks array<int>, seeds array<long>, starts array<long>"), "items")


def _filter(distinct: DataFrame) -> bytes:
    """The filter over all seeds of the benchmark: built in parts where the seeds are, merged by Spark."""
    def columns(batch):
        flat = batch.column(0).flatten().to_numpy().view(np.uint64)
        return {"slot": pa.array(np.unique(np.concatenate(probes(flat))).astype(np.int64))}

    return bit_table(distinct.select("seeds").mapInArrow(eased(per_batch(columns)), "slot long"), TABLE)


def _hits(docs: DataFrame, distinct: DataFrame, text_col: str) -> DataFrame:
    """(row, words, seeds, places) of the documents that have a seed which the filter lets through."""
    masks = [EVERY_MASK[r.mask] for r in distinct.select(F.explode("masks").alias("mask")).distinct().orderBy("mask").collect()]  # at most all masks
    shared = docs.sparkSession.sparkContext.broadcast(_filter(distinct))

    def run(batches):
        for batch in batches:
            out = {"row": [], "words": [], "seeds": [], "places": []}
            for row, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = word_hashes(text)
                found, places = [], []
                for mask in masks:
                    own = seeds(words, mask)
                    good = np.arange(len(own))
                    for slot in probes(own):
                        good = good[bits_at(shared.value, slot[good])]
                    found.append(own[good])
                    places.append(good)
                if sum(map(len, found)):
                    out["row"].append(row)
                    out["words"].append(words.tobytes())
                    out["seeds"].append(np.concatenate(found).view(np.int64))
                    out["places"].append(np.concatenate(places))
            yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int64()), pa.array(out["words"], pa.binary()), pa.array(out["seeds"], pa.list_(pa.int64())),
                                              pa.array(out["places"], pa.list_(pa.int64()))], ["row", "words", "seeds", "places"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text"))
    return stored(rows.mapInArrow(eased(run), "row long, words binary, seeds array<long>, places array<long>"), "hits")


def _near(hits: DataFrame, distinct: DataFrame) -> DataFrame:
    """(row, key, shifts): the distances at which a document and an item share a seed."""
    there = hits.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    here = distinct.select("key", F.explode(F.arrays_zip("seeds", "starts")).alias("s")).select("key", F.col("s.seeds").alias("seed"), F.col("s.starts").alias("start"))
    parts = lambda df, name: df.groupBy("seed").agg(F.ceil(F.count("*") / TOGETHER).alias(name))
    sizes = parts(here, "h").join(parts(there, "t"), "seed")
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = there.join(sizes, "seed").withColumn("tp", F.pmod(F.xxhash64("row", "place"), "t")).withColumn("hp", copies("h")).drop("h", "t")
    right = here.join(sizes, "seed").withColumn("hp", F.pmod(F.xxhash64("key", "start"), "h")).withColumn("tp", copies("t")).drop("h", "t")
    met = left.join(right, ["seed", "tp", "hp"])
    return met.groupBy("row", "key").agg(F.collect_set(F.col("place") - F.col("start")).alias("shifts"))


def _found(docs: DataFrame, benchmark: DataFrame, identity: float, overlap: int, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(key, item_id) of the items; (row, key, doc_start, item_start, n_words, n_same) of every leak, the longest per document and item."""
    prepared(docs.sparkSession)
    items, distinct = _items(benchmark, identity, overlap, item_col, item_text)
    hits = _hits(docs, distinct, text_col)
    near = stored(_near(hits, distinct), "near")
    both = near.join(hits.select("row", "words"), "row").join(distinct.select("key", F.col("words").alias("item")), "key")

    def run(batches):
        for batch in batches:
            row, key, rest = [], [], []
            for r, k, shifts, words, item in zip(*(batch.column(c).to_pylist() for c in range(5))):
                d, q = np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64)
                if best := max(filter(None, (stretch(q, d, s, identity, overlap) for s in shifts)), default=None):
                    row.append(r)
                    key.append(k)
                    rest.append((-best[2], -best[3], best[0], best[1]))
            columns = np.array(rest, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key, pa.string()), *(pa.array(c) for c in columns)],
                                             ["row", "key", "doc_start", "item_start", "n_words", "n_same"])

    return items, stored(both.select("row", "key", "shifts", "words", "item").mapInArrow(
        eased(run), "row long, key string, doc_start long, item_start long, n_words long, n_same long"), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, identity: float = IDENTITY, overlap: int = OVERLAP,
          id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document and item that it leaks: doc_id, item_id, doc_start, item_start, n_words, n_same (places in words)."""
    items, found = _found(docs, benchmark, identity, overlap, text_col, item_col, item_text)
    ids = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"))
    return found.join(items, "key").join(ids, "row").select("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, identity: float = IDENTITY, overlap: int = OVERLAP,
               text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that leak nothing, all columns."""
    _, found = _found(docs, benchmark, identity, overlap, text_col, item_col, item_text)
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    gone = stored(found.select(F.col("row").alias(name)).distinct(), "gone")
    return docs.withColumn(name, F.monotonically_increasing_id()).join(gone, name, "left_anti").drop(name)
