import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from vacantis.llm.packing import Encoder, pieces, sequences, vocabulary_path

ODD = ["", None, " ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "\n", "x  y", "  z", "<|endoftext|> a <|endoftext|>b", "a\x00b c",
       "é ü  ", "a\x85 b", "tab\tx y", "it's I'll 123 a1 b2", "trail   ", "漢字 かな", "a  b", "no\xa0break \xa0x"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_pieces_equal_the_concatenation(spark, docs_of, tokenizer):
    r = random.Random(4)
    texts = ODD + [" ".join(r.choice(["alpha", "beta,", "γ.", "x\ny", "12"]) for _ in range(r.randrange(900))) for _ in range(60)]
    texts += texts[-2:] + ["word " * 30_000]
    docs = docs_of(list(enumerate(texts))).repartition(5)
    got = pieces(docs).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    spots = set()
    for p in got:
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert p.ids == part and p.length == len(part) > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == crc32(np.array(part, "<u4").tobytes()) and p.offset + p.length <= 1024
        new = {(p.sequence_id, p.offset + k) for k in range(p.length)}
        assert not new & spots
        spots |= new
    total = sum(map(len, ids.values()))
    assert spots == {divmod(k, 1024) for k in range(total)}
    for i, whole in ids.items():
        assert [x for p in sorted((p for p in got if p.doc_id == i), key=lambda p: p.start) for x in p.ids] == whole
    rows = sequences(pieces(docs)).orderBy("sequence_id").collect()
    assert [x.sequence_id for x in rows] == list(range(-(-total // 1024)))
    assert all(len(x.ids) == 1024 for x in rows[:-1]) and sum(x.n_ids for x in rows) == total


def test_power_of_two_is_not_padded(spark, docs_of):
    rows = sequences(pieces(docs_of([(1, ""), (2, None), (None, ""), (2, "")]))).collect()
    assert [(x.n_ids, x.ids) for x in rows] == [(4, [0] * 4)]
    assert len(sequences(pieces(docs_of([(1, ""), (2, None), (3, "")]))).collect()[0].ids) == 1024


def test_empty_table(spark, docs_of):
    assert pieces(docs_of([])).collect() == []


def test_ids_are_those_of_whole_texts(tokenizer):
    r = random.Random(7)
    some = ["a", "s", "'", "'s", "'ll", "x9", "9", "é", "œ", "×", "÷", "ж", "漢", "«", " ", "\xa0", "\u2003", "\u3000", "\x85", "\x1c", "\x00", "  ", "\n", "\n\n",
            "\t", "\r\n", ".", ",", "(", "\u0301", "½", "<|endoftext|>", "<|endof", "😀", " the", "_"]
    encode = Encoder(vocabulary_path(), 500)
    for _ in range(40):
        texts = ["".join(r.choice(some) for _ in range(r.randrange(14))) for _ in range(100)]
        flat, counts = encode(pa.array(["x", *texts]).slice(1))
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_a_word_is_looked_up_once_whatever_stands_beside_it():
    encode = Encoder(vocabulary_path())
    encode(pa.array(["alpha, alpha. alpha;\nalpha (alpha) été.\nalpha"]))
    assert len(encode.kept) == len({"alpha", " alpha", ",", ".", ";", "\n", " (", ")", " été"})
