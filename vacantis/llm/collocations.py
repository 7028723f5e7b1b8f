"""Phrase collocations by counting in burstable tries over word ids.

Phrases of one to three words are counted in passes over the texts, each word
count or phrase count in a *trie* of its task: a phrase is the row of its words'
ids (``WORD_BITS`` bits each, given out in the task as words appear), inner nodes
of the trie deal phrases out by the next ``FAN_BITS`` bits of that row, and leaves
are hash containers, open addressing in two arrays, that burst into a node of
containers once they hold more than ``BURST`` phrases; so frequent beginnings get
deeper paths and the trie stays shallow.  Beyond ``HELD`` phrases the largest whole
subtrees are spilled, each as a run sorted by its phrases, until half is left.
Spark then merges the runs per partition of phrases: the prefix by which they are
dealt is the whole row of words, since one first word may begin a third of all phrases.

A phrase cannot be frequent unless its parts are.  Each pass leaves out what holds
an infrequent word or pair, told by a bit table of fixed size that is made of what
was counted before.  Several phrases may share a bit, so the table lets through a
few that need not be counted and never drops one that must: the counts are exact
at every size, and with more phrases than bits only more of them are counted.

A word is told by the 64-bit hash of language and word in what is shuffled; the
word counts are by the words themselves, and should two of them share a hash the
counting starts again with another seed.

A candidate is a phrase of two or three words found at least ``LEAST`` times.  It is
scored by its cut with the lowest floor(10**6 a a / (l r)), with exact decimals.

Defined results: null texts are empty; a null language is ``und``, together with
texts that say so; repeated rows count each; texts without words give nothing; an
empty table gives an empty result; other columns are ignored.  Very long texts are
read in blocks that end between words, and phrases go across them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, bits_at, only, prepared, stored

LEAST, TOP, SHARE = 10, 2000, 50
WORD_BITS, FAN_BITS = 21, 7
#: Phrases in a container before it bursts; phrases and words that a task holds; bytes of text looked at together.
BURST, HELD, WORDS, BLOCK = 1 << 15, 1 << 20, 1 << 19, 1 << 22
#: Bits, as a power of two, of the tables of frequent words and pairs.
WORD_TABLE, PAIR_TABLE = 25, 27
#: A bit of a pair is told by its first word's hash and the second's, turned by so many bits.
TURN = 17

_CASE_AND_CUTS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9 + b" ")
_GAP = re.compile(rb"[\x09-\x0D .,;:!?]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Container:
    """Counts of phrases in a hash table of two arrays."""

    def __init__(self, bits: int = 6):
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.size = bits, 0
        self.keys, self.counts = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds to the counts of these distinct phrases."""
        bits = self.bits
        while 2 * (self.size + len(keys)) > 1 << bits:
            bits += 1
        if bits > self.bits:
            old = self.items()
            self._make(bits)
            self._put(*old)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == _EMPTY
            if free.any():  # of those that go for the same free place the last one gets it
                self.keys[at[free]] = keys[free]
                self.size += int(np.count_nonzero(self.keys[at[free]] == keys[free]))
            here = self.keys[at] == keys
            self.counts[at[here]] += counts[here]
            on = ~here
            keys, counts, at = keys[on], counts[on], (at[on] + 1) & mask

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.keys != _EMPTY
        return self.keys[used], self.counts[used]


class Node:
    """Deals phrases out to its children by ``FAN_BITS`` of their bits."""

    def __init__(self, shift: int):
        self.shift, self.size = shift, 0
        self.children: list[Container | Node | None] = [None] * (1 << FAN_BITS)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` are sorted and distinct."""
        digit = (keys >> np.uint64(self.shift)) & np.uint64((1 << FAN_BITS) - 1)
        ends = np.flatnonzero(np.diff(digit)) + 1
        for begin, end in zip([0, *ends.tolist()], [*ends.tolist(), len(keys)]):
            d = int(digit[begin])
            child = self.children[d]
            child = Container() if child is None else child
            before = child.size
            child.add(keys[begin:end], counts[begin:end])
            self.size += child.size - before
            if isinstance(child, Container) and child.size > BURST and self.shift:
                node, (k, c) = Node(self.shift - FAN_BITS), child.items()
                order = np.argsort(k)
                node.add(k[order], c[order])
                child = node
            self.children[d] = child

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All phrases below, in their order."""
        for child in self.children:
            if isinstance(child, Node):
                yield from child.runs()
            elif child is not None:
                k, c = child.items()
                order = np.argsort(k)
                yield k[order], c[order]


class Trie(Node):
    """Counts of phrases of up to three words."""

    def __init__(self):
        super().__init__(3 * WORD_BITS - FAN_BITS)

    def count(self, phrases: np.ndarray) -> None:
        if len(phrases):
            self.add(*np.unique(phrases, return_counts=True))

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Gives up the largest subtrees, each as one sorted run, until at most ``keep`` phrases are left."""
        for d in sorted((i for i, c in enumerate(self.children) if c is not None), key=lambda i: -self.children[i].size):
            if self.size <= keep:
                break
            subtree = Node(self.shift)
            subtree.children[d] = self.children[d]
            self.size -= self.children[d].size
            self.children[d] = None
            parts = list(subtree.runs())
            yield np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])


def blocks(texts: list[bytes]) -> Iterator[tuple[bytes, bool]]:
    """(block, whether it goes on where the last one ended): texts apart from each other, cut only between words."""
    waiting, size = [], 0
    for t in texts:
        if len(t) > BLOCK:
            if waiting:
                yield b".".join(waiting), False
                waiting, size = [], 0
            begin = 0
            while begin < len(t):
                m = _GAP.search(t, begin + BLOCK)
                end = m.start() if m else len(t)
                yield t[begin:end], begin > 0
                begin = end
        else:
            waiting.append(t)
            size += len(t) + 1
            if size >= BLOCK:
                yield b".".join(waiting), False
                waiting, size = [], 0
    if waiting:
        yield b".".join(waiting), False


def words_of(block: bytes) -> pa.DictionaryArray:
    """The words of a block and, as ".", the cuts between its pieces."""
    flat = block.translate(_CASE_AND_CUTS).replace(b".", b" . ")
    parts = pc.ascii_split_whitespace(pa.array([flat], pa.binary()).cast(pa.string())).flatten()
    return parts.filter(pc.not_equal(parts, "")).dictionary_encode()


def hash_of(lang: str, word: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{lang}\n{word}", seed)


def _pair_slot(a, b):
    """For numpy: the bit of a pair of words."""
    turned = (b << np.uint64(TURN)) | (b >> np.uint64(64 - TURN))
    return (a ^ turned) >> np.uint64(64 - PAIR_TABLE)


def _counted(texts: DataFrame, size: int, seed: int, frequent=None, pairs=None) -> DataFrame:
    """Sorted runs of the counts of phrases of ``size`` words: (lang, w, a, n) for words, (a, b[, c], n) for more."""
    names = "abc"[:size]
    columns = ("lang string, w string, " if size == 1 else "") + ", ".join(f"{c} long" for c in names) + ", n long"

    def run(batches):
        trie, ids, hashes, said = Trie(), {}, [0], [("", "")]

        def rows(keys, counts):
            known = np.array(hashes, np.uint64)
            parts = [(keys >> np.uint64(WORD_BITS * (2 - i))).astype(np.int64) & ((1 << WORD_BITS) - 1) for i in range(size)]
            out = {c: pa.array(known[p].view(np.int64)) for c, p in zip(names, parts)} | {"n": pa.array(counts)}
            if size == 1:
                out = {"lang": pa.array([said[i][0] for i in parts[0].tolist()], pa.string()),
                       "w": pa.array([said[i][1] for i in parts[0].tolist()], pa.string())} | out
            order = np.lexsort([np.asarray(out[c]) for c in reversed(names)])
            return pa.RecordBatch.from_pydict(out).take(pa.array(order))

        for batch in batches:
            langs = pc.fill_null(batch.column(0).cast(pa.string()), "und").dictionary_encode()
            bodies = pc.fill_null(batch.column(1).cast(pa.string()), "").cast(pa.binary())
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                last = np.zeros(0, np.uint64)
                for block, goes_on in blocks(bodies.filter(pc.equal(langs.indices, k)).to_pylist()):
                    coded = words_of(block)
                    words = coded.dictionary.to_pylist()
                    h = np.fromiter((hash_of(lang, w, seed) for w in words), np.uint64, len(words))
                    wanted = np.fromiter((w != "." for w in words), bool, len(words))
                    if frequent is not None:
                        wanted &= bits_at(frequent.value, h >> np.uint64(64 - WORD_TABLE))
                    own = np.zeros(len(words), np.uint64)
                    for i in np.flatnonzero(wanted).tolist():
                        at = ids.get(key := int(h[i]) if size > 1 else (lang, words[i]))
                        if at is None:
                            at = ids[key] = len(hashes)
                            hashes.append(int(h[i]))
                            if size == 1:
                                said.append(key)
                        own[i] = at
                    row = own[coded.indices.to_numpy()] if len(words) else own
                    carried = last if goes_on else last[:0]
                    row = np.concatenate([carried[len(carried) - min(len(carried), size - 1):], row])
                    last = row[max(0, len(row) - 2):]
                    trie.count(_phrases(row, size, hashes, pairs))
                    if trie.size > HELD:
                        for run_ in trie.spill(HELD // 2):
                            yield rows(*run_)
                    if len(hashes) > WORDS and not goes_on:
                        for run_ in trie.spill(0):
                            yield rows(*run_)
                        trie, ids, hashes, said, last = Trie(), {}, [0], [("", "")], last[:0]
        for run_ in trie.spill(0):
            yield rows(*run_)

    return texts.mapInArrow(run, columns)


def _phrases(row: np.ndarray, size: int, hashes: list[int], pairs) -> np.ndarray:
    """The rows of words of all phrases of this size that are worth counting."""
    n = len(row) - size + 1
    if n <= 0:
        return row[:0]
    parts = [row[i:i + n] for i in range(size)]
    ok = reduce(np.logical_and, [p > 0 for p in parts])
    parts = [p[ok] for p in parts]
    if pairs is not None and len(parts[0]):
        known = np.array(hashes, np.uint64)
        h = [known[p.astype(np.int64)] for p in parts]
        ok = reduce(np.logical_and, [bits_at(pairs.value, _pair_slot(a, b)) for a, b in zip(h, h[1:])])
        parts = [p[ok] for p in parts]
    return sum((p << np.uint64(WORD_BITS * (2 - i)) for i, p in enumerate(parts)), np.zeros(len(parts[0]), np.uint64))


def _slot(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits)


def _pair_column(a: str, b: str) -> Column:
    turned = F.shiftleft(b, TURN).bitwiseOR(F.shiftrightunsigned(b, 64 - TURN))
    return _slot(F.col(a).bitwiseXOR(turned), PAIR_TABLE)


def _merged(runs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The runs' counts, added up per phrase, of those found often enough."""
    dealt = runs.repartition(*keys)  # the tries have added up what a task has; adding again before the shuffle would gain little
    return dealt.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrase_counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, pairs, triples): (lang, w, a, n) of every word, (a, b, n) and (a, b, c, n) of the phrases found ``least`` times.

    Words are named by hash in phrases; a hash belongs to one word of one language.
    """
    context = prepared(docs.sparkSession).sparkContext
    texts = only(docs, lang_col, text_col)
    for seed in range(100):
        words = stored(_merged(_counted(texts, 1, seed), ["lang", "w", "a"], 1), "words")
        if words.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            break
    frequent = words.where(F.col("n") >= least)
    of_words = context.broadcast(bit_table(frequent.select(_slot(F.col("a"), WORD_TABLE).alias("slot")), WORD_TABLE))
    pairs = stored(_merged(_counted(texts, 2, seed, of_words), ["a", "b"], least), "pairs")
    of_pairs = context.broadcast(bit_table(pairs.select(_pair_column("a", "b").alias("slot")), PAIR_TABLE))
    triples = stored(_merged(_counted(texts, 3, seed, of_words, of_pairs), ["a", "b", "c"], least), "triples")
    return words, pairs, triples


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10**6 a a / (l r)), exact: 33 digits by 32."""
    whole = lambda c: c.cast("decimal(16,0)")
    up = (whole(a) * whole(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    down = (whole(left) * whole(right)).cast("decimal(32,0)")
    return F.call_function("div", up.cast("decimal(38,0)"), down)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases, see the module's text.

    A phrase goes if a longer candidate that holds it has at least ``share`` hundredths of its count.
    """
    words, pairs, triples = phrase_counts(docs, least, lang_col, text_col)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.where(F.col("n") >= least)

    def word(name):
        return frequent.select(F.col("lang").alias(f"lang_{name}"), F.col("w").alias(f"w_{name}"), F.col("a").alias(name), F.col("n").alias(f"n_{name}"))

    inner = triples.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("p"), "n")
    longer = inner.groupBy("p").agg(F.max("n").alias("longest")).select("p.a", "p.b", "longest")
    two = (pairs.join(longer, ["a", "b"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("n")))
           .join(word("a"), "a").join(word("b"), "b")
           .select(F.col("lang_a").alias("lang"), F.concat_ws(" ", "w_a", "w_b").alias("phrase"), F.col("n").alias("a"), F.col("n_a").alias("l"), F.col("n_b").alias("r")))
    two = two.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    three = (triples.join(pairs.select("a", "b", F.col("n").alias("n_ab")), ["a", "b"])
             .join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("n_bc")), ["b", "c"])
             .join(word("a"), "a").join(word("b"), "b").join(word("c"), "c"))
    one, other = _score(F.col("n"), F.col("n_a"), F.col("n_bc")), _score(F.col("n"), F.col("n_ab"), F.col("n_c"))
    three = three.withColumns({"one": one, "other": other}).withColumn("first", F.col("one") <= F.col("other")).select(
        F.col("lang_a").alias("lang"), F.concat_ws(" ", "w_a", "w_b", "w_c").alias("phrase"), F.col("n").alias("a"),
        F.when(F.col("first"), F.col("n_a")).otherwise(F.col("n_ab")).alias("l"), F.when(F.col("first"), F.col("n_bc")).otherwise(F.col("n_c")).alias("r"),
        F.least("one", "other").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
