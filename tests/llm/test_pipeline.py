"""The pipeline beside its stages done one by one in plain Python, and the ground rules of the registry."""

import re
from zlib import crc32

import numpy as np
import pytest

import corpus_pipeline
from vacantis.llm import linecrf, secretforest
from vacantis.llm.packing import vocabulary_path

from .test_decontam import brute
from .test_linecrf import good_text, junk_text
from .test_nearcopies import alike, cut
from .test_simhash import groups

SECRET = "AKIA" + "Q7" * 8


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts = [good_text(k) for k in range(60)] + [junk_text(k) for k in range(60)]
    texts += [texts[0], texts[1] + " extra", None, "", texts[2] + f" {SECRET} and token = \"{'0a1b2c3d' * 5}\" too"]
    item = " ".join(f"bench{k}" for k in range(25))
    texts += [texts[3] + " " + item + " " + good_text(99)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, item


def test_pipeline_equals_plain_stages(spark, folder):
    from tokenizers import Tokenizer

    path, texts, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    chain = linecrf.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    kept = [i for i, t in enumerate(texts) if linecrf._judge([(t or "").encode()], chain, 0.5)["kept"][0]]
    assert set(range(60)) <= set(kept) and not set(kept) & set(range(60, 120))
    root = groups([cut(texts[i]) for i in kept], alike)
    kept = [i for n, i in enumerate(kept) if root[n] == n]
    kept = [i for i in kept if brute(texts[i], item) is None]
    t = Tokenizer.from_file(vocabulary_path())
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == set(kept)
    spots = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert [s * 1024 + o for s, o, _ in spots] == list(np.cumsum([0] + [n for *_, n in spots])[:-1])
    for i in kept:
        clean = re.sub(f"{SECRET}|(?<=\")[0-9a-f]{{40}}(?=\")", "[SECRET]", texts[i])
        ids = [x for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
        assert ids == [*t.encode(clean, add_special_tokens=False).ids, 0]


def test_stages_keep_columns_and_odd_rows(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumnRenamed("lang", "fp")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, empty, path).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, path).collect() == []


def test_registry_has_one_query_per_operator(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert secretforest.FEATURES and crc32
