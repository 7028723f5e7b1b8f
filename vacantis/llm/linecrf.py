"""Quality rules: a linear-chain CRF marks each line as content or boilerplate.

A line with a word has a feature vector (length, symbols, capitals, digits,
end mark, repeats, table bars, …).  A chain over a text's lines scores both
marks per line and each change between neighbours; Viterbi's best marking tells
which words are content, and a text whose content share is too low is rejected,
as is one that fails the plain rules (under 50 words, or more than half of its
words in repeated three-word windows).

The chain is fitted by maximum likelihood on a bounded sample of labelled texts
(``FIT_DOCS`` texts of at most ``FIT_LINES`` lines each, outside the held-out
fold); lines of texts marked good are content, lines of texts marked bad are
boilerplate.  Everything else covers all texts and whole lines.

Defined results: a null or empty text has no words and fails the plain rules;
null ids and repeated rows are judged like others; without labels of both kinds
every line is content; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import eased, labelled_texts, only, per_batch, prepared, utf8

FIT_DOCS, FIT_LINES = 1500, 64
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 50, 50, 0.5

SPACE = bytes([32, *range(9, 14)])
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
MARKS = b"!?:;\"'()[]{}~^_=+/\\@"
NOT_A_CODE_POINT = bytes(range(128, 192))
FEATURES = 18


def repeated_words(words: list[bytes]) -> np.ndarray:
    """Of each word, whether a three-word window over it is found twice or more."""
    n = len(words)
    hit = np.zeros(n, bool)
    if n < 4:
        return hit
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 21:  # three ids would not fit one number
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    for k in range(3):
        hit[k:n - 2 + k] |= again
    return hit


def _without(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def read(text: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Counts (words, code points in words, symbols, repeated lines, repeated words); line features; words per line."""
    words = text.split()
    hit = repeated_words(words)
    upto = np.concatenate([[0], np.cumsum(hit)])
    rows, sizes, seen, dup_lines, at = [], [], set(), 0, 0
    for line in text.split(b"\n") if words else ():
        here = line.split()
        if not here:
            continue
        n, size = len(here), len(line)
        dup = line in seen
        seen.add(line)
        dup_lines += dup
        letters, symbols, upper = _without(line, LETTERS), _without(line, SYMBOLS), _without(line, UPPER)
        digits, marks, last = _without(line, DIGITS), _without(line, MARKS), here[-1][-1:]
        shouts, bars = line.count(b"!"), line.count(b"|")
        rows.append((
            1.0, min(n, 60) / 60, n <= 3, min(1.0, 10 * symbols / size), symbols > 0.3 * n,
            upper / (letters or 1), upper > 0.5 * (letters or 1), digits / size, min(1.0, 5 * marks / size),
            last in b".!?", min(1.0, shouts / n), min(1.0, bars / n), dup, len(set(here)) / n,
            min(size / n, 30) / 30, (upto[at + n] - upto[at]) / n, b"http" in line or b"@" in line,
            letters < 0.6 * size))
        sizes.append(n)
        at += n
    counts = [len(words), len(text.translate(None, NOT_A_CODE_POINT + SPACE)) if words else 0,
              _without(text, SYMBOLS), dup_lines, int(hit.sum())]
    return counts, np.array(rows, np.float32).reshape(-1, FEATURES), np.array(sizes, np.int64)


@dataclass
class Chain:
    """Weights: line score for content over boilerplate; change[a, b] from mark a to mark b; 1 is content."""

    line: np.ndarray
    change: np.ndarray

    def mark(self, features: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over all texts of a batch at once; the best marking of each."""
        sizes = np.array([len(f) for f in features], np.int64)
        order = [i for i in np.argsort(-sizes, kind="stable") if sizes[i]]
        if not order:
            return [np.ones(0, np.int8) for _ in sizes]
        score = np.concatenate(features) @ self.line
        marks, starts = np.ones(len(score), np.int8), np.concatenate([[0], np.cumsum(sizes)])
        begin = starts[order]
        left = sizes[order]
        best = np.stack([np.zeros(len(order)), score[begin]], axis=1)
        came = []
        for t in range(1, left[0]):
            live = int((left > t).sum())
            ways = best[:live, :, None] + self.change
            came.append(ways.argmax(axis=1).astype(np.int8))
            step = ways.max(axis=1)
            step[:, 1] += score[begin[:live] + t]
            best[:live] = step
        at = best.argmax(axis=1)
        for t in range(left[0] - 1, -1, -1):
            live = int((left > t).sum())
            marks[begin[:live] + t] = at[:live]
            if t:
                at[:live] = came[t - 1][np.arange(live), at[:live]]
        return np.split(marks, starts[1:-1])


ALL_CONTENT = Chain(np.eye(FEATURES)[0], np.zeros((2, 2)))


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def fit_chain(features: list[np.ndarray], labels: list[int], rounds: int = 120, decay: float = 1e-3) -> Chain:
    """Maximum likelihood by gradient steps; every line of a text carries the text's label."""
    pairs = [(f, y) for f, y in zip(features, labels) if len(f)]
    if len({y for _, y in pairs}) < 2:
        return ALL_CONTENT
    pairs.sort(key=lambda p: -len(p[0]))
    x = np.concatenate([f for f, _ in pairs]).astype(np.float64)
    sizes = np.array([len(f) for f, _ in pairs])
    y = np.array([v for _, v in pairs])
    d, longest = len(pairs), int(sizes[0])
    live = (sizes[None, :] > np.arange(longest)[:, None]).sum(axis=1)
    spot = np.full((longest, d), len(x))
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for t in range(longest):
        spot[t, :live[t]] = start[:live[t]] + t
    target = np.repeat(y, sizes)
    weights, moved = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    spread = np.zeros(FEATURES + 4)
    steps = np.array([[(sizes - 1)[y == 0].sum(), 0], [0, (sizes - 1)[y == 1].sum()]], float)
    for r in range(1, rounds + 1):
        line, change = weights[:FEATURES], weights[FEATURES:].reshape(2, 2)
        score = np.append(x @ line, 0.0)
        unary = np.zeros((longest, d, 2))
        unary[:, :, 1] = score[spot]
        ahead, back = np.zeros((longest, d, 2)), np.zeros((longest, d, 2))
        ahead[0] = unary[0]
        for t in range(1, longest):
            k = live[t]
            ahead[t, :k] = _lse(ahead[t - 1, :k, :, None] + change, 1) + unary[t, :k]
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            back[t, :k] = _lse(change + (unary[t + 1, :k] + back[t + 1, :k])[:, None, :], 2)
        z = _lse(ahead[0] + back[0], 1)
        expected = np.exp(ahead[:, :, 1] + back[:, :, 1] - z)
        p = np.zeros(len(x) + 1)
        p[spot] = expected
        both = np.zeros((2, 2))
        for t in range(1, longest):
            k = live[t]
            both += np.exp(ahead[t - 1, :k, :, None] + change + (unary[t, :k] + back[t, :k])[:, None, :]
                           - z[:k, None, None]).sum(axis=0)
        grad = np.concatenate([x.T @ (target - p[:-1]), (steps - both).ravel()]) / len(x) - decay * weights
        moved = 0.9 * moved + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad * grad
        weights = weights + 0.1 * (moved / (1 - 0.9 ** r)) / (np.sqrt(spread / (1 - 0.99 ** r)) + 1e-8)
    return Chain(weights[:FEATURES], weights[FEATURES:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS, most_lines: int = FIT_LINES,
          id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain; at most ``most`` texts' line features reach the driver."""
    prepared(docs.sparkSession)
    sample = labelled_texts(docs, labels, "quality", most, id_col, text_col)

    def columns(batch):
        rows = [read(t)[1] for t in utf8(batch.column(2))]
        rows = [f if len(f) <= most_lines else f[:0] for f in rows]
        return {"id": batch.column(0).cast(pa.string()), "label": batch.column(1),
                "x": pa.array([f.tobytes() for f in rows], pa.binary())}

    got = sample.select("labelled_id", "label", "body").mapInArrow(
        per_batch(columns), "id string, label int, x binary").orderBy("id").collect()
    return fit_chain([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got], [r.label for r in got])


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judge(texts: list[bytes], chain: Chain, least: float) -> dict[str, np.ndarray]:
    seen = [read(t) for t in texts]
    counts = np.array([c for c, _, _ in seen], np.int64).reshape(-1, 5)
    content = np.array([int(s[m == 1].sum()) for (_, _, s), m in zip(seen, chain.mark([f for _, f, _ in seen]))], np.int64)
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
    share = content / np.maximum(counts[:, 0], 1)
    return {**{c: counts[:, i] for i, c in enumerate(COUNTS)}, "content_words": content,
            "base_failed": failed, "kept": ~failed & (share >= least)}


def judge(docs: DataFrame, chain: Chain, least: float = MIN_CONTENT,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, the counts, content_words, base_failed and kept."""
    def columns(batch):
        return {"doc_id": batch.column(0), **{k: pa.array(v) for k, v in _judge(utf8(batch.column(1)), chain, least).items()}}

    kind = docs.schema[id_col].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in [*COUNTS, "content_words"])
    return only(docs, id_col, text_col).mapInArrow(
        per_batch(columns), f"doc_id {kind}, {longs}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, chain: Chain, least: float = MIN_CONTENT, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, all columns, without a shuffle."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_judge(utf8(batch.column(place)), chain, least)["kept"]))

    return docs.mapInArrow(eased(run), docs.schema)
