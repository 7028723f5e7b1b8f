"""Packing: documents concatenated and cut into windows of equal length.

Pass one turns each document into token ids (an end id after each), writes them
with the running offset inside their partition, and keeps the partition's total.
A prefix sum over those totals, one row per partition, gives every partition
its global offset.  Pass two cuts the stream that this order defines into fixed
windows: each document yields one piece per window that it touches, the boundary
records.  Only the last window can be short, so padding is under one window for
all documents together.  No text or id is shuffled and nothing is gathered.

The offsets stand in the written table beside their ids, so a task that is run
again reads what its first run wrote.

Ids come from a published vocabulary whose file is a parameter.  Its pattern
always cuts before white space and where letters, digits and signs meet, so a
text is cut there and the ids of each part are kept per worker for its next use;
with another pattern a text is cut at spaces between visible characters only.

Defined results: null and empty texts are the end id alone; null ids and
repeated rows are packed like others; an empty table has no sequence.
"""

from __future__ import annotations

import os
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import eased, let_go, only, prepared, stored

LENGTH, END_ID = 1024, 0
VOCABULARY = "byte_bpe_50k.json"
#: Pieces of text whose ids a worker keeps; with more, those not used since the last such turn are let go.
KEPT = 350_000
#: Bytes of text that are cut and looked up together.
BLOCK = 1 << 23
#: What a byte of UTF-8 is, as far as cuts are concerned; letters of two bytes count by both.
_OTHER, _LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _BREAK, _HIGH, _LEAD = range(9)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[33:127] = [_LETTER if c.isalpha() else _DIGIT if c.isdigit() else _QUOTE if c == "'" else _SIGN for c in map(chr, range(33, 127))]
    kinds[0x80:], kinds[ord(" ")] = _HIGH, _SPACE
    kinds[[ord(c) for c in "\t\n\r"]] = _BREAK
    kinds[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = _LEAD  # U+00C0 to U+027F and U+0400 to U+047F are letters, but for two signs
    return kinds


def _joints(pairs: dict[int, tuple[int, ...]]) -> np.ndarray:
    table = np.zeros((16, 16), bool)
    for left, rights in pairs.items():
        table[left, list(rights)] = True
    return table.ravel()


_KINDS = _kinds()
_WORD = {_LETTER: (_DIGIT, _SIGN, _QUOTE), _DIGIT: (_LETTER, _SIGN, _QUOTE), _SIGN: (_LETTER, _DIGIT), _QUOTE: (), _HIGH: ()}
#: Neighbours between which the byte-level pattern always cuts: before white space, and where letters, digits and signs meet
#: (not behind an apostrophe, which may begin a contraction).
_FINE = _joints({left: (*rights, _SPACE, _BREAK) for left, rights in _WORD.items()})
_COARSE = _joints({left: (_SPACE,) for left in _WORD})


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; those that may be white space beyond ASCII are other ones."""
    kinds = _KINDS[data]
    lead = np.flatnonzero(kinds == _LEAD)
    kinds[lead] = _LETTER
    kinds[lead + 1] = _LETTER
    signs = lead[(data[lead] == 0xC3) & np.isin(data[lead + 1], (0x97, 0xB7))]
    kinds[signs] = kinds[signs + 1] = _HIGH
    for first, more in ((0xC2, 1), (0xE1, 2), (0xE2, 2), (0xE3, 2)):
        at = np.flatnonzero(data == first)
        for step in range(more + 1):
            kinds[at + step] = _OTHER
    return kinds


def cuts(data: np.ndarray, fine: bool) -> np.ndarray:
    """Whether a part may begin at each byte of texts put together: the ids on both sides do not depend on each other.

    ``fine`` is for the byte-level pattern; else cuts are at single spaces between visible characters.
    """
    kinds = kinds_of(data)
    cut = np.zeros(len(data), bool)
    cut[1:] = (_FINE if fine else _COARSE)[(kinds[:-1] << 4) | kinds[1:]]
    visible = (kinds != _OTHER) & (kinds != _SPACE) & (kinds != _BREAK)
    if fine:
        at = np.flatnonzero(kinds == _BREAK)
        at = at[(at > 0) & (at < len(data) - 1)]
        cut[at[visible[at - 1] & visible[at + 1]] + 1] = True  # behind a line end that stands alone
    else:
        cut[:-1] &= visible[1:]
    return cut


class Encoder:
    """Ids of texts by a vocabulary file; each distinct part of a batch is looked up or encoded once."""

    def __init__(self, path: str, most: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.most, self.kept, self.aged = Tokenizer.from_file(path), most, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.special = [t.content for t in added]
        self.lead = os.path.commonprefix(self.special)
        #: Special strings that reach into the white space beside them, so that their texts stay whole.
        self.wide = {t.content for t in added if t.lstrip or t.rstrip or any(c.isspace() for c in t.content)}
        before = self.tokenizer.pre_tokenizer
        self.fine = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space and self.tokenizer.normalizer is None
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # a character of a byte-level token is one byte

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of each part."""
        if len(self.kept) > self.most:
            self.kept, self.aged = {}, self.kept
        kept, aged = self.kept, self.aged
        ids = list(map(kept.get, distinct))
        missing = [i for i, found in enumerate(ids) if found is None]
        new = []
        for i in missing:
            u = distinct[i]
            found = aged.get(u)
            if found is None:
                new.append(u)
            else:
                ids[i] = kept[u] = found
        if new:
            self._learn(new)
            for i in missing:
                ids[i] = kept[distinct[i]]
        return ids

    def _special(self, text: str) -> bool:
        if self.lead not in text:  # common beginning of all special strings
            return False
        return any(t in text for t in self.special)

    def _learn(self, new: list[bytes]) -> None:
        """Parts that start with a space before a visible character and end visibly are encoded as one text and cut by bytes."""
        joint, apart = [], []
        for u in new:
            t = u.decode()
            fits = t[0] == " " and len(t) > 1 and not t[1].isspace() and not t[-1].isspace() and not self._special(t)
            (joint if fits else apart).append(u)
        for begin in range(0, len(joint), 4000):
            some = joint[begin:begin + 4000]
            ids, = self._encode([b"".join(some).decode()])
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            at = np.searchsorted(ends, wanted) + 1
            if not len(ids) or at[-1] != len(ids) or (ends[at - 1] != wanted).any():
                apart += some  # a vocabulary that joins across spaces
                continue
            low, whole = 0, ids.tobytes()
            for u, high in zip(some, (4 * at).tolist()):
                self.kept[u] = whole[low:high]
                low = high
        for begin in range(0, len(apart), 4000):
            some = apart[begin:begin + 4000]
            self.kept.update(zip(some, (i.tobytes() for i in self._encode([u.decode() for u in some]))))

    def _begins(self, texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where parts begin; texts with a special string are cut at spaces only."""
        if not len(data):
            return np.zeros(0, np.int64)
        cut = cuts(data, self.fine)
        for special in self.special:
            for row in np.flatnonzero(pc.match_substring(texts, special).to_numpy(zero_copy_only=False)):
                low, high = bounds[row:row + 2]
                cut[low:high] = False if special in self.wide else cut[low:high] & cuts(data[low:high], False)
        starts = bounds[:-1]
        cut[starts[starts < bounds[1:]]] = True
        return np.flatnonzero(cut)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts without nulls, and how many each text has."""
        texts = texts.cast(pa.string())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data or b"", np.uint8)[bounds[0]:bounds[-1]]
        bounds -= bounds[0]
        begins = self._begins(texts, data, bounds)
        parts = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        ids = self._find(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                         pa.array(np.frombuffer(b"".join(ids), np.int32)))
        flat = lists.take(coded.indices).flatten().to_numpy().view("<u4")
        upto = np.concatenate([[0], np.cumsum(size[coded.indices.to_numpy()])])
        return flat, np.diff(upto[np.searchsorted(begins, bounds)])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = KEPT) -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives a task unless it is let go."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]


def _blocks(texts: pa.Array, size: int = BLOCK):
    """Runs of rows of about ``size`` bytes: (first row, texts without nulls)."""
    texts = pc.fill_null(texts, "")
    upto, begin = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while begin < len(texts):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + size, "right")))
        yield begin, pa.concat_arrays([texts.slice(begin, end - begin)])
        begin = end


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID, kept: int = KEPT, forget: bool = False, block: int = BLOCK,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one, written down: (part, doc_id, local, n, ids); local counts the ids before it in its partition.

    ``kept`` bounds the pieces a worker knows the ids of and ``block`` the text
    it cuts at a time; with ``forget`` it starts anew with each task, for
    sessions that have other work to do.
    """
    path = path or vocabulary_path()

    def run(batches):
        yield from encoded(batches)
        if forget:
            _ENCODERS.clear()
            let_go()

    def encoded(batches):
        encode, part, at = encoder(path, kept), TaskContext.get().partitionId(), 0
        if forget:
            let_go()  # of what reading the vocabulary took
        for batch in batches:
            for begin, some in _blocks(batch.column(1), block):
                flat, counts = encode(some)
                flat = np.insert(flat, np.cumsum(counts), end_id)
                n = counts + 1
                bounds = np.concatenate([[0], np.cumsum(n)])
                local = at + bounds[:-1]
                at += int(bounds[-1])
                ids = pa.Array.from_buffers(pa.binary(), len(n), [
                    None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(n), part, np.int32)), "doc_id": batch.column(0).slice(begin, len(n)),
                    "local": pa.array(local), "n": pa.array(n), "ids": ids})
            if forget:
                pa.default_memory_pool().release_unused()

    prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return stored(only(docs, id_col, text_col).mapInArrow(
        run, f"part int, doc_id {kind}, local long, n long, ids binary"), "tokens")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Tokens with ``base``, the ids before their partition; the joined side has one row per partition."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(base), "part")


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID,
           with_ids: bool = True, kept: int = KEPT, forget: bool = False, block: int = BLOCK,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, its ids."""
    placed = with_offsets(tokenized(docs, path, end_id, kept, forget, block, id_col, text_col))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            begin = batch.column(3).to_numpy() + batch.column(4).to_numpy()
            first = begin // length
            count = (begin + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = first[row] + nth
            low = np.maximum(begin[row], sequence * length)
            size = np.minimum(begin[row] + n[row], (sequence + 1) * length) - low
            start = low - begin[row]
            ids = [memoryview(b) for b in batch.column(2).to_pylist()]
            cut = [ids[r][4 * s:4 * (s + z)] for r, s, z in zip(row.tolist(), start.tolist(), size.tolist())]
            out = {"doc_id": batch.column(0).take(pa.array(row)), "start": pa.array(start), "length": pa.array(size),
                   "ids_crc32": pa.array([crc32(c) for c in cut], pa.int64()), "doc_tokens": pa.array(n[row]),
                   "sequence_id": pa.array(sequence), "offset": pa.array(low - sequence * length)}
            if with_ids:
                flat = np.frombuffer(b"".join(cut), "<u4").astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    longs = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.select("doc_id", "n", "ids", "local", "base").mapInArrow(
        eased(run) if forget else run, f"doc_id {kind}, {longs}" + ", ids array<int>" * with_ids)


def sequences(cut: DataFrame, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, n_ids, ids): whole windows from pieces with ids, padded unless their size is a power of two.

    A group holds at most ``length`` ids.
    """
    whole = (cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
             .select("sequence_id", F.flatten("p.ids").alias("ids")).withColumn("n_ids", F.size("ids")))
    room = F.when(F.bit_count("n_ids") == 1, 0).otherwise(length - F.col("n_ids"))
    return whole.select("sequence_id", "n_ids", F.concat("ids", F.array_repeat(F.lit(pad_id), room.cast("int"))).alias("ids"))
