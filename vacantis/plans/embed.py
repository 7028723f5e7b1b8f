"""Chunking and embedding of job texts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.core import col, once
from ..operators.filters import jobs_to_embed
from ..rules import misc
from .normalize import embedding_text

# White space in Unicode's sense, and the four separators 0x1C to 0x1F.
_SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def chunks(text: Column | str, size: int = misc.CHUNK_SIZE, overlap: int = misc.CHUNK_OVERLAP,
           look_back: int = misc.CHUNK_LOOK_BACK) -> Column:
    """Overlapping pieces of at most ``size`` characters, as an array.

    A piece ends at the last space of the ``look_back`` characters before its
    limit, else at the limit; the next one begins ``overlap`` characters before
    that end.  Pieces lose white space at their ends and empty ones are
    dropped; a text that fits is its own only piece; null gives no piece.

    The text is cut into blocks of ``size`` characters once, and every piece
    lies in two of them, so the cost follows the length of the text.
    """
    if size <= overlap + look_back:
        raise ValueError("a piece must be longer than overlap and look-back together")

    def part(blocks: Column, start: Column, n: Column) -> Column:
        k = F.floor(start / size).cast("int")
        two = F.concat(F.get(blocks, k), F.coalesce(F.get(blocks, k + 1), F.lit("")))
        return F.substring(two, (start - k * size + 1).cast("int"), n)

    def spans(blocks: Column, length: Column) -> Column:
        def span(start: Column) -> Column:
            limit = start + size
            back = F.instr(F.reverse(part(blocks, limit - look_back, F.lit(look_back))), " ")
            stop = F.when((limit < length) & (back > 0), limit - back).otherwise(limit)
            return once(stop, lambda e: F.struct(start.alias("start"), e.alias("stop"), (e - overlap >= length).alias("last")))

        def step(done: Column, _: Column) -> Column:
            return once(F.element_at(done, -1), lambda e: F.when(e["last"], done).otherwise(
                F.concat(done, F.array(span(e["stop"] - overlap)))))

        most = F.ceil(length / (size - overlap - look_back)).cast("int")
        return F.aggregate(F.sequence(F.lit(1), most), F.array(span(F.lit(0))), step)

    def cut(whole: Column) -> Column:
        length = F.length(whole)
        blocks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        pieces = once(blocks, lambda b: F.transform(spans(b, length), lambda x: part(b, x["start"], x["stop"] - x["start"])))
        bare = F.transform(pieces, lambda p: F.regexp_replace(p, f"^{_SPACE}|{_SPACE}$", ""))
        return F.when(length <= size, F.array(whole)).otherwise(F.filter(bare, lambda p: p != ""))

    return once(col(text), lambda t: F.when(t.isNull(), F.array().cast("array<string>")).otherwise(cut(t)))


def chunk_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per chunk."""
    return docs.select(key, F.posexplode(chunks(text)).alias("chunk_no", "chunk"))


def hashing_embedder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Deterministic stand-in for an embedding service: signed hashed word counts, unit length."""
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode("utf-8"))
                out[row, h % dim] += 1.0 if h & 0x80000000 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)
    return embed


def embed_chunks(pieces: Column | str, dim: int, make: Callable[[int], Callable] = hashing_embedder) -> Column:
    """Mean vector over an array of chunks, null for none.

    ``make(dim)`` builds the embedding function once per Python worker, so a
    model is loaded once and fed whole Arrow batches.  Chunks never leave the
    row, so pooling needs no shuffle.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make(dim)
        for lists in batches:
            sizes = [0 if ps is None else len(ps) for ps in lists]
            flat = [p for ps in lists if ps is not None for p in ps]
            vectors = embed(flat) if flat else np.zeros((0, dim), dtype=np.float32)
            out, at = [], 0
            for n in sizes:
                out.append(vectors[at:at + n].mean(axis=0) if n else None)
                at += n
            yield pd.Series(out)
    return run(pieces)


def embedded(docs: DataFrame, key: str, text: str, dim: int, make: Callable[[int], Callable] = hashing_embedder) -> DataFrame:
    """(key, embedding, chunks) per text.  The pieces are a column that two others read, so they are made once
    and stay apart from the Python expression, which cannot hold them inside."""
    return (docs.select(key, chunks(text).alias("pieces"))
            .select(key, embed_chunks("pieces", dim, make).alias("embedding"), F.size("pieces").alias("chunks")))


def embed_jobs(jobs: DataFrame, dim: int = 384, make: Callable[[int], Callable] = hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """Vectors of all jobs that need one, and the run's counts.

    Returns ``(id, embedding, chunks)`` rows to upsert and a one-row summary.
    """
    work = embedding_text(jobs_to_embed(jobs)).select("id", "embedding_text")
    out = embedded(work, "id", "embedding_text", dim, make)
    counts = work.agg(F.count("*").alias("processed"),
                      F.count_if(F.length("embedding_text") > misc.CHUNK_SIZE).alias("chunked"))
    return out, counts
