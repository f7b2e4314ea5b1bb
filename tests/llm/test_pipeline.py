"""The pipeline against its stages worked out by hand."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lagweave.llm import decontamination, language, mixing, tokens
from lagweave.llm.common import documents
from tests.llm.test_resemblance import jaccard

DATA = "/root/testdata/sf0.001"


def test_pipeline_is_its_stages(spark):
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = documents(spark, DATA)
    rows = {r["doc_id"]: r for r in docs.collect()}
    found = language.predict(docs, language.learn(docs.filter(~language.held_out())), "doc_id").collect()
    kept = sorted(r["doc_id"] for r in found if not r["rejected"])
    # Near-duplicates of a stage on word shingles: five words, a similarity of 0.8 or more.
    group = {i: i for i in kept}
    for i in kept:
        for j in kept:
            if j < i and group[i] != group[j] and jaccard(rows[i]["text"], rows[j]["text"]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = {k: low if x == high else x for k, x in group.items()}
    kept = [i for i in kept if group[i] == i]
    hit = {r["doc_id"] for r in decontamination.find_hits(docs, documents(spark, DATA, "benchmark")).filter("n_hit > 0").collect()}
    kept = [i for i in kept if i not in hit]
    assert sorted(out) == kept
    left = spark.createDataFrame([rows[i] for i in kept], docs.schema)
    order = [r["doc_id"] for r in mixing.mix_sources(left).orderBy("position").collect()]
    tool, start = Tokenizer.from_file(tokens.default_path()), 0
    for i in order:
        ids = tool.encode(rows[i]["text"] or "", add_special_tokens=False).ids + [0]
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, stage):
    docs = documents(spark, DATA)
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, DATA).columns == docs.columns
