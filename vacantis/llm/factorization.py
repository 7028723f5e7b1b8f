"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text becomes a sparse vector: its words hashed into ``BUCKETS`` places with
weight 1 + log(count), scaled to unit length, and a block of structure and
metadata places (lengths, symbols, capitals, line shape, repeats) in bins.  The
score is the logistic of

    b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

whose second part sums the products of all pairs in time linear in the number
of words.  Weights come from AdaGrad steps over a bounded sample of labelled
texts (``FIT_DOCS``, outside the held-out fold); the model has a fixed size
(``BUCKETS`` x ``RANK``), so it travels with the task.

Labels, lang, source and the id are no inputs.  Defined results: null and empty
texts are scored as texts without words; null ids fall to no fold and are not
held out; without labels of both kinds every score is the smoothed share of
label 1; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_texts, only, per_batch, prepared, utf8

BUCKETS, RANK = 1 << 15, 8
FIT_DOCS, FIT_WORDS = 5000, 4000
THRESHOLD = 0.3
#: Upper ends of the bins of each structure statistic; each statistic has its own block of places.
BINS = (
    np.array([1, 5, 20, 50, 100, 200, 400, 800, 1600, 6400]),  # words
    np.array([0, 1, 2, 4, 8, 16, 64, 256]),  # lines
    np.array([.002, .005, .01, .02, .05, .1, .2]),  # symbols per byte
    np.array([.01, .03, .06, .12, .3, .6]),  # capitals per byte
    np.array([.002, .01, .03, .1, .3]),  # digits per byte
    np.array([.005, .01, .02, .04, .08, .15]),  # marks per byte
    np.array([.1, .2, .3, .4, .5, .6, .7, .8, .9]),  # distinct words per word
    np.array([3, 4, 5, 6, 8, 12]),  # bytes per word
    np.array([0, .02, .1, .25, .5]),  # share of lines seen before
    np.array([.02, .05, .1, .2, .4]),  # share of the commonest word
    np.array([.002, .01, .05, .2]),  # table bars and exclamation marks per word
    np.array([10, 100, 500, 1000, 3000, 10000]),  # recorded length, metadata
)
BLOCK = 16
PLACES = BUCKETS + BLOCK * len(BINS)
SYMBOLS, MARKS = b"#*$%&|<>", b"!?:;\"'()[]{}~^_=+/\\@"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def encode(text: bytes, recorded: int | None, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text; ``known`` keeps hashes of words between texts."""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    counts = Counter(words)
    at = []
    for w in counts:
        k = known.get(w)
        if k is None:
            k = crc32(w.lower()) % BUCKETS
            if len(known) < 300_000:
                known[w] = k
        at.append(k)
    places = np.array(at, np.int64)
    values = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    values /= max(np.sqrt((values ** 2).sum()), 1e-9)
    lines = text.split(b"\n")
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    stats = (n, len(lines), share(SYMBOLS), share(UPPER), share(DIGITS), share(MARKS), len(counts) / max(n, 1),
             size / max(n, 1), 1 - len(set(lines)) / len(lines), max(counts.values(), default=0) / max(n, 1),
             (text.count(b"|") + text.count(b"!")) / max(n, 1), -1 if recorded is None else recorded)
    extra = [BUCKETS + BLOCK * i + int(np.searchsorted(b, s)) for i, (b, s) in enumerate(zip(BINS, stats))]
    return (np.concatenate([places, np.array(extra, np.int64)]),
            np.concatenate([values, np.full(len(extra), 0.5)]).astype(np.float32))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of label 1 for each sparse row."""
        if not rows:
            return np.zeros(0)
        places, values = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows])
        start = np.concatenate([[0], np.cumsum([len(p) for p, _ in rows])[:-1]])
        vx = self.factors[places] * values[:, None]
        pairs = np.add.reduceat(vx, start, axis=0) ** 2 - np.add.reduceat(vx ** 2, start, axis=0)
        z = self.bias + np.add.reduceat(self.linear[places] * values, start) + 0.5 * pairs.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], passes: int = 12, batch: int = 64,
                rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> Machine:
    """AdaGrad on the log loss."""
    rng = np.random.default_rng(seed)
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(PLACES, np.float32),
                rng.normal(0, 0.02, (PLACES, RANK)).astype(np.float32))
    if len(set(labels)) < 2:
        m.factors[:] = 0
        return m
    y = np.array(labels, np.float32)
    seen_w, seen_v, seen_b = np.full(PLACES, 1e-3, np.float32), np.full((PLACES, RANK), 1e-3, np.float32), 1e-3
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), batch):
            pick = order[begin:begin + batch]
            part = [rows[i] for i in pick]
            places, values = np.concatenate([p for p, _ in part]), np.concatenate([v for _, v in part])
            sizes = np.array([len(p) for p, _ in part])
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            v = m.factors[places]
            vx = v * values[:, None]
            sums = np.add.reduceat(vx, start, axis=0)
            z = m.bias + np.add.reduceat(m.linear[places] * values, start) + 0.5 * (
                sums ** 2 - np.add.reduceat(vx ** 2, start, axis=0)).sum(axis=1)
            miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
            per = np.repeat(miss, sizes) * values / len(pick)
            uniq, back = np.unique(places, return_inverse=True)
            gw = np.bincount(back, per, len(uniq)).astype(np.float32) + decay * m.linear[uniq]
            each = per[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            gv = np.stack([np.bincount(back, each[:, f], len(uniq)) for f in range(RANK)], axis=1).astype(
                np.float32) + decay * m.factors[uniq]
            seen_w[uniq] += gw ** 2
            seen_v[uniq] += gv ** 2
            m.linear[uniq] -= rate * gw / np.sqrt(seen_w[uniq])
            m.factors[uniq] -= 0.5 * rate * gv / np.sqrt(seen_v[uniq])
            gb = float(miss.mean())
            seen_b += gb ** 2
            m.bias -= rate * gb / seen_b ** 0.5
    return m


def _recorded(column: pa.Array) -> list[int | None]:
    return column.to_pylist()


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS, most_words: int = FIT_WORDS,
          id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> Machine:
    """Fit on at most ``most`` labelled texts of at most ``most_words`` distinct words; their vectors reach the driver."""
    prepared(docs.sparkSession)
    sample = labelled_texts(docs, labels, "quality", most, id_col, text_col, (length_col,))

    def columns(batch):
        known: dict[bytes, int] = {}
        rows = [encode(t, n, known) for t, n in zip(utf8(batch.column(2)), _recorded(batch.column(3)))]
        fits = [len(p) <= most_words + len(BINS) for p, _ in rows]
        return {"id": batch.column(0).cast(pa.string()), "label": batch.column(1), "fits": pa.array(fits),
                "places": pa.array([p.astype(np.int32).tobytes() if f else b"" for (p, _), f in zip(rows, fits)], pa.binary()),
                "given": pa.array([v.tobytes() if f else b"" for (_, v), f in zip(rows, fits)], pa.binary())}

    got = (sample.mapInArrow(per_batch(columns), "id string, label int, fits boolean, places binary, given binary")
           .where("fits").orderBy("id").toArrow().to_pylist())
    return fit_machine([(np.frombuffer(r["places"], np.int32).astype(np.int64), np.frombuffer(r["given"], np.float32))
                        for r in got], [r["label"] for r in got])


def score(docs: DataFrame, model: Machine, threshold: float = THRESHOLD,
          id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # PLACES x (RANK + 1) numbers, whatever the input

    def run(batches):
        m, known = shared.value, {}
        for batch in batches:
            rows = [encode(t, n, known) for t, n in zip(utf8(batch.column(1)), _recorded(batch.column(2)))]
            if rows:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(m.scores(rows), pa.float64())})

    out = only(docs, id_col, text_col, length_col).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
