"""Language-model scores from a hierarchical Pitman-Yor model whose seating is drawn by Gibbs.

Tokens are the words of a text and one end.  Every token sits in the restaurant
of its context, which is the word before it, whichever it is; the first word
follows an end.  All restaurants have one parent, whose customers are their
tables and whose base is uniform over the known words and one unknown.  With c
customers and t tables for word w of context k, c_k and t_k in all, and C, T for
the parent,

    p(w | k) = (c - d t) / (q + c_k) + (q + d t_k) / (q + c_k) * P(w)
    P(w)     = (c' - d' t') / (q' + C) + (q' + d' T) / (q' + C) / (V + 1)

A sweep draws the tables of each word in each restaurant from their conditional
given the sweep before, P(t) ~ S_d(c, t) a**t, where a is the weight of a new table and
S_d are generalised Stirling numbers, which sum over all seatings with t tables:
exactly up to ``EXACT`` customers, by its saddle point beyond.  Predictive
probabilities are averaged over the last ``KEPT_SWEEPS`` sweeps.

Work is spread over words: pairs of a context and a word are counted in the
bucket of the word, which draws their tables and those of its words in the parent.
A context's pairs are in many buckets, so after a sweep each sends what its
contexts have there to the contexts' own buckets (*homes*), and gets their sums back.
Pairs learned from once have one table and are never drawn, only counted.  Then
occurrences go to the buckets and the sums of their scores back to the documents.

Words with ``SHARE`` of all tokens, of which there are at most 1 / SHARE, are
modelled like others but never gathered: after a rarer word, they are in that
word's bucket; occurrences after each other stay with their block, and their
counts, at most 1 / SHARE**2, are summed beforehand; their tables are summed on the driver.

Words are told apart by 64-bit hashes.  Defined results: null and empty texts
are the end alone; rows with a null id are learned from; repeated rows are
learned from and scored each; without training rows every probability is that
of the uniform base; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, eased, fold, let_go, only, prepared, shuffles_removed, stored

SHARE = 1 / 1000
SWEEPS, KEPT_SWEEPS = 4, 2
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
EXACT = 64
#: Tokens counted at a time, in a block of documents and in a bucket of words, about; documents in a block and in a slice.
COUNT_TOKENS, BLOCK_TOKENS, BUCKET_TOKENS, BLOCK_DOCS, SLICE_DOCS = 1_000_000, 500_000, 1_000_000, 50_000, 400
#: Numbers in a piece of work on small counts, and bytes of sums that a task holds before it passes them on.
DRAWN_AT_ONCE, HELD_BYTES = 400_000, 16 << 20
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line end


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of an array of texts, an end after each text, and how many each has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    values = parts.flatten()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    real = pc.binary_length(values).to_numpy() > 0
    coded = values.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    hashes = known[coded.indices.to_numpy()[real]] if len(known) else np.zeros(0, np.uint64)
    sizes = np.bincount(row[real], minlength=len(texts))
    return np.insert(hashes, np.cumsum(sizes), END), sizes + 1


def _slices(batches):
    """Smaller batches, and freed memory goes back between them."""
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE_DOCS):
            yield batch.slice(begin, SLICE_DOCS)
        pa.default_memory_pool().release_unused()


def _kind(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, id_col, text_col).toDF("doc_id", "text").select(
        "doc_id", "text", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(h, c): training tokens by word hash, summed in the task before the shuffle."""
    def run(batches):
        waiting, size = [], 0

        def flush():
            h, c = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "c": pa.array(c.astype(np.int64))})

        for batch in _slices(batches):
            if batch.num_rows:
                h, n = tokens(batch.column(1))
                waiting.append(h[np.repeat(~batch.column(2).to_numpy(zero_copy_only=False), n)])
                size += len(waiting[-1])
                if size >= COUNT_TOKENS:
                    yield flush()
                    waiting, size = [], 0
        if size:
            yield flush()

    return rows.mapInArrow(eased(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


_FLOW = ("bucket int, kind int, block long, docs int, words binary, per_word binary, contexts binary, at binary, doc binary, n binary, "
         "doc_ids array<{id}>, held array<boolean>, sizes array<long>")
COLD, HOT, META, SENT, TOTAL = 0, 1, 2, 3, 4


def _packed(a: np.ndarray, dtype) -> bytes:
    return a.astype(dtype).tobytes()


def _small(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return _packed(a, np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


def _ints(b: bytes, n: int) -> np.ndarray:
    """``n`` numbers of :func:`_small`."""
    return np.frombuffer(b, f"u{len(b) // n}" if n else np.uint8).astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where a word is at home; it rises with the hash."""
    return (h >> np.uint64(32)).astype(np.int64) * buckets >> 32


def _ranks(hot: np.ndarray):
    """A function that gives a frequent word's place among them, and -1 to others."""
    order = hot.argsort()
    ranked = hot[order]

    def place(h):
        at = np.minimum(np.searchsorted(ranked, h), max(len(hot) - 1, 0))
        return np.where(ranked[at] == h, order[at], -1) if len(hot) else np.full(len(h), -1)
    return place


def flow(rows: DataFrame, hot: np.ndarray, buckets: int, kind: str, counting: bool = False) -> DataFrame:
    """Pairs of a context and a word per block of documents, by bucket: the word's, or the context's if only that is rarer.

    Pairs of two frequent words, and ids, stay with their block.  When ``counting``, pairs come with
    how often they are learned from, else with their documents, where a document's
    place is 2 * index + (1 if it is learned from).
    """
    place, n_hot = _ranks(hot), max(1, len(hot))

    def run(batches):
        part, seen, batch_list, size, n_docs = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            block = part << 32 | seen
            sizes = np.concatenate([b[1] for b in batch_list])
            held = np.concatenate([b[2] for b in batch_list])
            ids = pa.chunked_array([b[3] for b in batch_list]).combine_chunks()
            docs = len(sizes)
            doc = np.repeat(2 * np.arange(docs) + ~held, sizes)
            words, code = np.unique(np.concatenate([b[0] for b in batch_list]), return_inverse=True)
            rank, of, m = place(words), _bucket(words, buckets), len(words)
            before = np.empty_like(code)
            before[0], before[1:] = np.searchsorted(words, END), code[:-1]
            out = []

            def row(bucket, kind_, **more):
                out.append({"bucket": bucket, "kind": kind_, "block": block, "docs": docs} | more)

            some = (rank[code] >= 0) & (rank[before] >= 0)
            spot, pair, here = hash(block) % buckets, rank[before] * n_hot + rank[code], doc[some]
            if counting:
                pair, n = np.unique(pair[some][here & 1 > 0], return_counts=True)
                row(spot, HOT, at=_packed(pair, np.uint32), n=_packed(n, np.uint32))
                del pair, here
                key, which = np.unique(code[~some] * m + before[~some], return_inverse=True)
                n = np.bincount(which, doc[~some] & 1, len(key))
            else:
                key, n = np.unique(here * n_hot ** 2 + pair[some], return_counts=True)
                row(spot, HOT, at=_packed(key % n_hot ** 2, np.uint32), doc=_packed(key // n_hot ** 2, np.uint32), n=_packed(n, np.uint32))
                row(spot, META, doc_ids=ids.to_pylist(), held=held.tolist(), sizes=sizes.tolist())
                key, n = np.unique((code[~some] * m + before[~some]) * (2 * docs) + doc[~some], return_counts=True)
                key, doc = key // (2 * docs), key % (2 * docs)
            own, context = key // m, key % m
            home = np.where(rank[own] >= 0, of[context], of[own])
            order = np.argsort(home, kind="stable")
            cut = np.searchsorted(home[order], np.arange(buckets + 1))
            for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                at = order[cut[b]:cut[b + 1]]
                first = np.flatnonzero(np.concatenate([[True], own[at][1:] != own[at][:-1]]))
                there, which = np.unique(context[at], return_inverse=True)
                row(b, COLD, words=words[own[at[first]]].tobytes(), per_word=_small(np.diff(np.append(first, len(at)))),
                    contexts=words[there].tobytes(), at=_small(which), n=_small(n[at]), doc=None if counting else _small(doc[at]))
            lists = lambda c, t: pa.array([r.get(c) for r in out], pa.list_(t))
            return pa.RecordBatch.from_pydict({
                **{c: pa.array([r[c] for r in out], t) for c, t in (("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("docs", pa.int32()))},
                **{c: pa.array([r.get(c) for r in out], pa.binary()) for c in ("words", "per_word", "contexts", "at", "doc", "n")},
                "doc_ids": lists("doc_ids", ids.type), "held": lists("held", pa.bool_()), "sizes": lists("sizes", pa.int64())})

        for batch in _slices(batches):
            h, n = tokens(batch.column(1))
            batch_list.append((h, n, batch.column(2).to_numpy(zero_copy_only=False).astype(bool), batch.column(0)))
            size, n_docs = size + len(h), n_docs + batch.num_rows
            if size >= BLOCK_TOKENS or n_docs >= BLOCK_DOCS:
                yield flush()
                seen, batch_list, size, n_docs = seen + 1, [], 0, 0
        if batch_list:
            yield flush()

    return rows.mapInArrow(eased(run), _FLOW.format(id=kind))


def _together(rows: list[dict], hot: int, place) -> tuple[np.ndarray, ...]:
    """Of a bucket's rows: the words and the rarer contexts, of each entry its word and context (frequent ones come first), and how many a row has."""
    lists = [np.frombuffer(r["words"], np.uint64) for r in rows]
    words, which = np.unique(np.concatenate(lists), return_inverse=True)
    per_word = [_ints(r["per_word"], len(own)) for r, own in zip(rows, lists)]
    word, sizes = np.repeat(which.astype(np.int32), np.concatenate(per_word)), [n.sum() for n in per_word]
    lists = [np.frombuffer(r["contexts"], np.uint64) for r in rows]
    contexts, which = np.unique(np.concatenate(lists), return_inverse=True)
    rank = place(contexts)
    number = np.where(rank >= 0, rank, hot + np.cumsum(rank < 0) - 1)[which].astype(np.int32)
    begin = np.cumsum([0, *map(len, lists)])
    k = np.concatenate([number[b + _ints(r["at"], n)] for b, r, n in zip(begin, rows, sizes)])
    return words, contexts[rank < 0], word, k, np.array(sizes)


#: A bucket's frequent words and its contexts, how many pairs of each are learned from once, and the pairs learned from
#: more often; its words' customers and tables, and of the kept sweeps (tables, words' customers and tables, the contexts'
#: tables); sums that go to the contexts' homes, and to the driver.
_STATE = ("bucket int, kind int, owner int, n_words int, rank binary, alone binary, contexts binary, alone_there binary, n_pairs int, word binary, k binary, "
          "c binary, customers binary, tables binary, had binary, v binary, kept array<binary>")


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema)


def _sent(bucket: int, contexts: np.ndarray, buckets: int, *v: np.ndarray) -> list[dict]:
    """A bucket's sums by context, one row for each home of contexts."""
    home = _bucket(contexts, buckets)
    first = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, int)
    ends = np.append(first, len(home))
    return [{"bucket": bucket, "kind": SENT, "owner": int(home[i]), "contexts": contexts[i:j].tobytes(), "v": _small(np.concatenate([x[i:j] for x in v]))}
            for i, j in zip(ends[:-1], ends[1:])]


def answers(table: DataFrame, sums: int) -> DataFrame:
    """(bucket, owner, n, v): what the contexts that a bucket sent have in all buckets, in its order; each came with so many sums."""
    ddl = "bucket int, owner int, n int, v binary"
    schema = _schema(ddl)

    def add(sent: pa.Table) -> pa.Table:
        rows = sent.to_pylist()
        lists = [np.frombuffer(r["contexts"], np.uint64) for r in rows]
        known, which = np.unique(np.concatenate(lists), return_inverse=True)
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        came = np.concatenate([_ints(r["v"], sums * len(x)).reshape(sums, -1) for r, x in zip(rows, lists)], axis=1)
        all_ = [np.split(np.bincount(which, own, len(known)).astype(np.int64)[which], cuts) for own in came]
        return _table([{"bucket": r["bucket"], "owner": r["owner"], "n": len(v[0]), "v": _small(np.concatenate(v))} for r, *v in zip(rows, *all_)], schema)

    return table.where(F.col("kind") == SENT).select("bucket", "owner", "contexts", "v").groupBy("owner").applyInArrow(add, ddl)


def _answered(rows: list[dict], sums: int, owner: str = "owner", n: str = "n", v: str = "v") -> np.ndarray:
    """The answers to one bucket in the order of its contexts, a row for each of the sums."""
    parts = [_ints(r[v], sums * r[n]).reshape(sums, -1) for r in sorted(rows, key=lambda r: r[owner])]
    return np.concatenate([np.zeros((sums, 0), np.int64), *parts], axis=1)


def restaurants(flowing: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """The buckets before the first sweep; sums are the contexts' customers and pairs learned from once, and the pairs learned from once and twice."""
    place, schema = _ranks(hot), _schema(_STATE)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket, out = rows[0]["bucket"], []
        frequent = [r for r in rows if r["kind"] == HOT]
        if frequent:
            pair, which = np.unique(np.concatenate([np.frombuffer(r["at"], np.uint32) for r in frequent]), return_inverse=True)
            n = np.bincount(which, np.concatenate([np.frombuffer(r["n"], np.uint32) for r in frequent]), len(pair))
            out.append({"bucket": bucket, "kind": HOT, "k": _packed(pair, np.uint32), "c": _packed(n, np.uint64)})
        cold = [r for r in rows if r["kind"] == COLD]
        if cold:
            words, contexts, word, k, sizes = _together(cold, len(hot), place)
            ways = len(hot) + len(contexts)
            n = np.concatenate([_ints(r["n"], size) for r, size in zip(cold, sizes)])
            del rows, table, frequent, cold
            key = word.astype(np.int64) * ways + k
            del word, k
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            pairs, c = key[first], np.add.reduceat(n, first)
            del key, n, order, first
            word, k, once, more = pairs // ways, pairs % ways, c == 1, c > 1
            alone, there, customers = (np.bincount(*x) for x in ((word[once], None, len(words)), (k[once], None, ways), (word, c, len(words))))
            out.append({"bucket": bucket, "kind": COLD, "n_words": len(words), "rank": _packed(place(words), np.int32), "alone": _small(alone),
                        "contexts": contexts.tobytes(), "alone_there": _small(there), "n_pairs": int(more.sum()), "word": _packed(word[more], np.uint32),
                        "k": _packed(k[more], np.uint32), "c": _small(c[more]), "customers": _small(customers), "tables": _small(np.minimum(customers, 1)), "kept": []})
            out += _sent(bucket, contexts, buckets, np.bincount(k, c, ways)[len(hot):], there[len(hot):])
            out.append({"bucket": bucket, "kind": TOTAL, "v": _packed(np.array([once.sum(), (c == 2).sum()]), np.int64)})
        let_go()  # a task has several buckets
        return _table(out, schema)

    with shuffles_removed(flowing.sparkSession):
        return stored(flowing.groupBy("bucket").applyInArrow(merge, _STATE), "restaurants")


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t): S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t)."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        s[c + 1, 1:c + 1] = s[c, 1:c + 1] + np.log(c - t * d)
        s[c + 1, 2:c + 2] = np.logaddexp(s[c + 1, 2:c + 2], s[c, 1:c + 1])
    return s


def draw_tables(c: np.ndarray, a: np.ndarray, d: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each word from P(t) ~ S_d(c, t) a**t; none where there is no customer."""
    t = np.minimum(c, 1).astype(np.int64)
    u = rng.random(len(c))
    small = np.flatnonzero((c > 1) & (c <= EXACT))
    small = small[np.argsort(c[small], kind="stable")]
    cuts = np.searchsorted(c[small], np.arange(2, EXACT + 2))
    for size, lo, hi in zip(range(2, EXACT + 1), cuts[:-1], cuts[1:]):
        step = DRAWN_AT_ONCE // size
        for begin in range(lo, hi, step):
            rows = small[begin:min(hi, begin + step)]
            w = table[size, 1:size + 1] + np.log(a[rows])[:, None] * np.arange(1, size + 1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[rows] = 1 + (w < u[rows, None] * w[:, -1:]).sum(axis=1)
    big = np.flatnonzero(c > EXACT)
    if len(big):
        n, weight = c[big].astype(float), a[big]
        low, high = np.full(len(big), -700.0), np.zeros(len(big))  # of log(1 - z)
        for _ in range(60):  # weight * z * (1 - z)**(d - 1) = n
            mid = (low + high) / 2
            over = np.log(weight) + np.log1p(-np.exp(np.minimum(mid, -1e-12))) + (d - 1) * mid > np.log(n)
            low, high = np.where(over, mid, low), np.where(over, high, mid)
        y = np.exp((low + high) / 2)
        z = 1 - y
        g, g1, g2 = -np.expm1(d * np.log(y)) / d, y ** (d - 1), (1 - d) * y ** (d - 2)
        mean = np.clip(weight * g, 1e-9, n)
        slope = g1 / g + z * g2 / g - z * (g1 / g) ** 2
        spread = 1 / np.maximum(1 / mean + g1 / g * n / (mean ** 2 * np.maximum(slope, 1e-12)), 1e-12)
        spread = np.minimum(spread, mean)
        drawn = np.where(mean < 30, 1 + rng.poisson(np.minimum(mean, 30)), np.rint(mean + np.sqrt(spread) * rng.standard_normal(len(big))))
        t[big] = np.clip(drawn, 1, n).astype(np.int64)
    return t


@dataclass
class Totals:
    """What a sweep leaves for all: tables per context, customers and tables of the parent, and those of the frequent words."""

    tables: np.ndarray
    customers: float
    parents: float
    own_customers: np.ndarray | None = None
    own_tables: np.ndarray | None = None


@dataclass
class Model:
    train_tokens: int
    words: int
    customers: np.ndarray  # per context
    d: float
    d_root: float
    totals: list[Totals] = field(default_factory=list)

    def inside(self, s: int, tables: np.ndarray, customers: np.ndarray) -> Model:
        """The model with a bucket's rarer contexts after the frequent ones: their tables after sweep ``s``, and their customers."""
        g = self.totals[s]
        own = replace(g, tables=np.concatenate([g.tables, tables]))
        return replace(self, customers=np.concatenate([self.customers, customers]), totals=[*self.totals[:s], own])

    def shared(self, s: int, rank: np.ndarray | None, customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of words in the parent, where frequent ones have those of all buckets."""
        if rank is None or not len(self.totals[s].own_tables):
            return customers, tables
        return tuple(np.where(rank >= 0, of[rank], own) for of, own in ((self.totals[s].own_customers, customers), (self.totals[s].own_tables, tables)))

    def sweep(self, s: int, word: np.ndarray, k: np.ndarray, c: np.ndarray, seed: int, alone: np.ndarray, customers: np.ndarray, tables: np.ndarray,
              rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sweep after ``s``: tables of pairs learned from more than once, and the words' customers and tables in the parent.

        A pair learned from once has one table and needs no draw: ``alone`` says how many each word has.  ``rank`` tells frequent words, -1 others.
        """
        rng = np.random.default_rng([seed, s])
        a = (STRENGTH + self.d * self.totals[s].tables[k]) * self.parent(s, *self.shared(s, rank, customers, tables))[word]
        t = draw_tables(c, a, self.d, stirling(self.d), rng)
        customers = alone + np.bincount(word, t, len(alone)).astype(np.int64)
        return t, customers, draw_tables(customers, np.full(len(alone), self.new(s)), self.d_root, stirling(self.d_root), rng)

    def replay(self, word: np.ndarray, k: np.ndarray, c: np.ndarray, seed: int, sweeps: int, rank: np.ndarray | None = None):
        """Each sweep's (tables, parent's customers, parent's tables) of some words, from their counts and earlier totals."""
        many, m = c > 1, int(word.max()) + 1 if len(word) else 0
        alone = np.bincount(word[c == 1], minlength=m)
        customers = np.bincount(word, c, m).astype(np.int64)
        tables = np.minimum(customers, 1)
        for s in range(sweeps):
            t, customers, tables = self.sweep(s, word[many], k[many], c[many].astype(np.int64), seed, alone, customers, tables, rank)
            full = np.minimum(c, 1).astype(np.int64)
            full[many] = t
            yield full, customers, tables

    def new(self, s: int) -> float:
        """The weight of a word's new table in the parent."""
        return (ROOT_STRENGTH + self.d_root * self.totals[s].parents) / (self.words + 1)

    def parent(self, s: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """P(w) of words under the totals of sweep ``s``."""
        g, q = self.totals[s], ROOT_STRENGTH
        return (customers - self.d_root * tables) / (q + g.customers) + (q + self.d_root * g.parents) / (q + g.customers) / (self.words + 1)

    def predictive(self, s: int, word, k, c, t, customers, tables, rank: np.ndarray | None = None) -> np.ndarray:
        """Each pair's predictive probability after sweep ``s``."""
        room = STRENGTH + self.customers[k]
        p = self.parent(s, *self.shared(s, rank, customers, tables))
        return (c - self.d * t) / room + (STRENGTH + self.d * self.totals[s].tables[k]) / room * p[word]

    def log_predictive(self, word, k, c, seed: int, rank: np.ndarray | None = None) -> np.ndarray:
        """log10 of each pair's predictive probability, averaged over the last sweeps; needs the totals of all."""
        last = len(self.totals) - 1
        p = np.zeros(len(c))
        for s, (t, customers, tables) in enumerate(self.replay(word, k, c, seed, last, rank), 1):
            if s > last - KEPT_SWEEPS:
                p += self.predictive(s, word, k, c, t, customers, tables, rank)
        return np.log10(p / min(last, KEPT_SWEEPS))

    def log_base(self, c_word: np.ndarray) -> np.ndarray:
        return np.log10((c_word + 0.5) / (self.train_tokens + 0.5 * (self.words + 1)))


HOT_SEED = 1 << 40


def _discount(n1: float, n2: float) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 + n2 else 0.5


def scores(docs: DataFrame, sweeps: int = SWEEPS, share: float = SHARE, bucket_tokens: int = BUCKET_TOKENS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark, kind = prepared(docs.sparkSession), _kind(docs, id_col)
    rows = _rows(docs, id_col, text_col)
    with shuffles_removed(spark):
        counts = stored(word_counts(rows), "vocabulary")
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"),
                       F.count_if(F.col("c") == 2).alias("n2")).first()
    total, vocabulary = whole["n"] or 0, whole["v"]
    frequent = counts.where(F.col("c") >= max(1.0, share * total)).orderBy("h").collect()  # at most 1 / share rows
    dropped(counts)
    hot, hot_c = np.array([r.h for r in frequent], np.int64).view(np.uint64), np.array([r.c for r in frequent], np.int64)
    place, n_hot = _ranks(hot), max(1, len(hot))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_tokens))
    schema = _schema(_STATE)
    table = restaurants(flow(rows, hot, buckets, kind, counting=True), hot, buckets)

    def hot_counts(batches):
        for batch in batches:
            for k, c in zip(*(batch.column(i).to_pylist() for i in range(2))):
                yield pa.RecordBatch.from_pydict({"pair": pa.array(np.frombuffer(k, np.uint32).astype(np.int64)), "c": pa.array(np.frombuffer(c, np.uint64).astype(np.int64))})

    def cold_counts(batches):
        for batch in batches:
            for v in batch.column(0).to_pylist():
                v = np.frombuffer(v, np.int64)
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(v))), "v": pa.array(v)})

    def summed(table, size):
        """The buckets' totals, added up; some two rows per frequent word."""
        out = np.zeros(size, np.int64)
        for r in (table.where(F.col("kind") == TOTAL).select("v").mapInArrow(eased(cold_counts), "i long, v long")
                  .groupBy("i").agg(F.sum("v").alias("v")).collect()):
            out[r.i] = r.v
        return out

    got = (table.where(F.col("kind") == HOT).select("k", "c").mapInArrow(eased(hot_counts), "pair long, c long")
           .groupBy("pair").agg(F.sum("c").alias("c")).orderBy("pair").collect())  # at most n_hot**2 rows
    pair, pair_c = np.array([r.pair for r in got], np.int64), np.array([r.c for r in got], np.int64)
    hot_word, hot_k, ranks = pair % n_hot, pair // n_hot, np.arange(len(hot))
    n1, n2 = summed(table, 2)
    model = Model(total, vocabulary, hot_c.astype(float),
                  _discount(n1 + (pair_c == 1).sum(), n2 + (pair_c == 2).sum()), _discount(whole["n1"], whole["n2"]),
                  [Totals(hot_c.astype(float), float(total), float(vocabulary), hot_c, np.ones(len(hot), np.int64))])

    whole_after = lambda s: s == 0 or s > sweeps - KEPT_SWEEPS  # noqa: E731  # sums of all contexts are sent, else of those of pairs that are drawn

    def swept(table, s):
        """The buckets after sweep ``s``, from those before and what their contexts had in all."""
        shared = spark.sparkContext.broadcast(model)

        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            r, = left.to_pylist()
            words, pairs, contexts = r["n_words"], r["n_pairs"], np.frombuffer(r["contexts"], np.uint64)
            word, k, rank = np.frombuffer(r["word"], np.uint32), np.frombuffer(r["k"], np.uint32), np.frombuffer(r["rank"], np.int32)
            alone, customers, tables = (_ints(r[c], words) for c in ("alone", "customers", "tables"))
            there = _ints(r["alone_there"], len(hot) + len(contexts))
            drawn = np.unique(k[k >= len(hot)]) - len(hot)
            came = _answered(right.to_pylist(), 2 if s == 1 else 1)
            if s == 1:
                r["had"] = _small(came.reshape(-1))  # customers of the contexts, and their pairs learned from once
            had, one = _ints(r["had"], 2 * len(contexts)).reshape(2, -1)
            if s == 1:
                of = had
            elif whole_after(s - 1):
                of = one + came[0]
                r["kept"] = [*r["kept"], _small(of)]
            else:
                of = one.copy()
                of[drawn] += came[0]
            t, customers, tables = shared.value.inside(s - 1, of, had).sweep(s - 1, word, k, _ints(r["c"], pairs), r["bucket"], alone, customers, tables, rank)
            by, own = np.bincount(k, t, len(there)).astype(np.int64), rank >= 0
            v = np.concatenate([[customers[~own].sum(), tables[~own].sum()], (there + by)[:len(hot)], np.bincount(rank[own], customers[own], len(hot))])
            r |= {"customers": _small(customers), "tables": _small(tables)}
            by = by[len(hot):]
            if s > sweeps - KEPT_SWEEPS:
                r["kept"] = [*r["kept"], _small(t), r["customers"], r["tables"]]
            sent = _sent(r["bucket"], contexts, buckets, by) if whole_after(s) else _sent(r["bucket"], contexts[drawn], buckets, by[drawn])
            let_go()
            return _table([r, {"bucket": r["bucket"], "kind": TOTAL, "v": _packed(v, np.int64)}, *sent], schema)

        with shuffles_removed(spark):
            new = stored(table.where(F.col("kind") == COLD).groupBy("bucket").cogroup(answers(table, 2 if s == 1 else 1).groupBy("bucket"))
                         .applyInArrow(step, _STATE), "restaurants")
        dropped(table)
        found = summed(new, 2 + 2 * len(hot))
        for t, customers, _ in model.replay(hot_word, hot_k, pair_c, HOT_SEED, s, ranks):
            pass
        customers = np.bincount(hot_word, t, len(hot)).astype(np.int64) + found[2 + len(hot):]
        rng = np.random.default_rng([HOT_SEED, s, 1])
        tables = draw_tables(customers, np.full(len(hot), model.new(s - 1)), model.d_root, stirling(model.d_root), rng)
        model.totals.append(Totals((found[2:2 + len(hot)] + np.bincount(hot_k, t, len(hot))).astype(float), float(found[0] + customers.sum()),
                                   float(found[1] + tables.sum()), customers, tables))
        return new

    for s in range(1, sweeps + 1):
        table = swept(table, s)
    # frequent words in every frequent context, seen or not: at most n_hot**2 numbers
    every = np.zeros(len(hot) ** 2, np.int64)
    every[pair] = pair_c
    at = np.arange(len(hot) ** 2)
    hot_log = model.log_predictive(at % n_hot, at // n_hot, every, HOT_SEED, ranks)
    shared = spark.sparkContext.broadcast((model, hot_log, hot_c))
    sums = (("known", np.uint32), ("base", np.float64), ("score", np.float64))
    scored = f"block long, slots binary, known binary, base binary, score binary, doc_ids array<{kind}>, held array<boolean>, sizes array<long>"
    scored_schema = _schema(scored)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        m, hot_log, hot_c = shared.value
        rows, out = left.to_pylist(), [r for r in left.filter(pc.equal(left.column("kind"), META)).to_pylist()]

        def add(r, doc, n, parts):
            totals = [np.bincount(doc >> 1, v * n) for v in parts]
            slots = np.unique(doc >> 1)
            out.append({"block": r["block"], "slots": _packed(slots, np.uint32)} | {name: _packed(v[slots], t) for (name, t), v in zip(sums, totals)})

        for r in rows:
            if r["kind"] == HOT:
                at = np.frombuffer(r["at"], np.uint32).astype(np.int64)
                if len(at):
                    add(r, np.frombuffer(r["doc"], np.uint32), np.frombuffer(r["n"], np.uint32), (np.ones(len(at)), m.log_base(hot_c)[at % n_hot], hot_log[at]))
        cold = [r for r in rows if r["kind"] == COLD]
        if cold:
            state, = right.to_pylist()
            words, contexts, word, k, sizes = _together(cold, len(hot), place)
            ways, rank = len(hot) + len(contexts), place(words)
            pairs, which = np.unique(word.astype(np.int64) * ways + k, return_inverse=True)
            del word, k
            learned = np.concatenate([np.where(_ints(r["doc"], n) & 1, _ints(r["n"], n), 0) for r, n in zip(cold, sizes)])
            c = np.bincount(which, learned, len(pairs)).astype(np.int64)
            word, k = pairs // ways, pairs % ways
            of_word = np.bincount(word, c, len(words)).astype(np.int64)
            of_word = np.where(rank >= 0, hot_c[rank], of_word) if len(hot) else of_word
            had, one = _ints(state["had"], 2 * len(contexts)).reshape(2, -1)
            # of each kept sweep; the contexts' tables after the last have just come
            kept = [*state["kept"], _small(one + _answered([r for r in rows if r["kind"] == SENT], 1, "block", "docs", "words")[0])]
            p, many, last = np.zeros(len(pairs)), c > 1, len(m.totals) - 1
            for s in range(max(1, last - KEPT_SWEEPS + 1), last + 1):
                t, customers, tables, of = kept[:4]
                del kept[:4]
                full = np.minimum(c, 1)
                full[many] = _ints(t, state["n_pairs"])
                p += m.inside(s, _ints(of, len(contexts)), had).predictive(s, word, k, c, full, _ints(customers, len(words)), _ints(tables, len(words)), rank)
            values = ((of_word > 0)[word], m.log_base(of_word)[word], np.log10(p / min(last, KEPT_SWEEPS)))
            for r, own, n in zip(cold, np.split(which, np.cumsum(sizes)[:-1]), sizes):
                add(r, _ints(r["doc"], n), _ints(r["n"], n), (v[own] for v in values))
        del rows
        let_go()
        return _table(out, scored_schema)

    def emit(batches):
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}  # sums of a block over the buckets of this task

        def merged():
            for block, parts in held.items():
                slots, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                held[block] = [(slots, *(np.bincount(which, np.concatenate([p[i] for p in parts]), len(slots)) for i in (1, 2, 3)))]
            return sum(28 * len(parts[0][0]) for parts in held.values())

        def flush():
            out = _table([{"block": block, "slots": _packed(p[0], np.uint32)} | {name: _packed(v, t) for (name, t), v in zip(sums, p[1:])}
                          for block, (p,) in held.items()], scored_schema)
            held.clear()
            return out.to_batches()

        size = 0
        for batch in batches:
            of_block = batch.filter(pc.is_null(batch.column(1)))
            if of_block.num_rows:
                yield of_block
            for r in batch.filter(pc.is_valid(batch.column(1))).to_pylist():
                held.setdefault(r["block"], []).append((np.frombuffer(r["slots"], np.uint32), *(np.frombuffer(r[name], t) for name, t in sums)))
                size += 28 * len(held[r["block"]][-1][0])
                if size > 2 * HELD_BYTES:
                    size = merged()
                    if size > HELD_BYTES:
                        yield from flush()
                        size = 0
        if held:
            merged()
            yield from flush()

    def add_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own, = (r for r in rows if r["slots"] is None)
        sizes = np.array(own["sizes"], np.int64)
        known, base, value = np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros(len(sizes))
        for r in rows:
            if r["slots"] is not None:
                for (name, t), all_ in zip(sums, (known, base, value)):
                    all_[np.frombuffer(r["slots"], np.uint32)] += np.frombuffer(r[name], t)
        ids = table.schema.field("doc_ids").type.value_type
        return pa.Table.from_pydict({"doc_id": pa.array(own["doc_ids"], ids), "held_out": pa.array(own["held"], pa.bool_()), "n_tokens": sizes,
                                     "n_known": known.astype(np.int64), "train_tokens": np.full(len(sizes), total, np.int64),
                                     "base_score": base, "score": value, "perplexity": 10 ** np.minimum(-value / sizes, 300)})

    with shuffles_removed(spark):
        told = stored(answers(table, 1), "answers").select("bucket", F.lit(SENT).alias("kind"), F.col("owner").cast("long").alias("block"),
                                                           F.col("n").alias("docs"), F.col("v").alias("words"))
        known = stored(table.where(F.col("kind") == COLD).select("bucket", "n_pairs", "had", "kept"), "known")
    dropped(table)
    flowing = flow(rows, hot, buckets, kind).unionByName(told, allowMissingColumns=True)
    parts = flowing.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(score, scored).mapInArrow(eased(emit), scored)
    return parts.groupBy("block").applyInArrow(
        add_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
