"""The pipeline, stage by stage, against plain versions of its decisions."""

from __future__ import annotations

import public_tokenizers
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from flowlib.llm import mixing, quality, tokens
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((docs, out))
        if k < 4:
            assert out.columns == columns, name
        docs = out
    rows = [[tuple(r[:2]) for r in out.collect()] for _, out in seen[:4]]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(source, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(rows[0]) == sorted((r.doc_id, r.text) for r in source.collect() if r.doc_id in {s.doc_id for s in quality.score(source, model).where("score >= 0.7").collect()})
    keep = set(plain.classes(rows[0]).values())
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r[0] in keep)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(rows[2]) == sorted(r for r in rows[1] if not plain.contamination(r[1], items)[4])
    counts = {r.doc_id: r.repetitions for r in mixing.mix_counts(seen[2][1]).collect()}
    assert sorted(rows[3]) == sorted(r for r in rows[2] for _ in range(counts[r[0]]))
    final = seen[4][1].collect()
    lengths = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).counts
    import pyarrow as pa

    assert sum(r.n_ids for r in final) == int((lengths(pa.array([t for _, t in rows[3]])) + 1).sum())
    assert sorted(r.slot for r in final) == list(range(len(final)))


@pytest.mark.parametrize("name", [n for n in contract.queries() if n.startswith("op") and n[2].isdigit()] + ["pipeline"])
def test_registered(spark, name):
    out = contract.queries()[name](spark, SF)
    assert len(set(out.columns)) == len(out.columns)
    of_documents = name.split("_")[0] not in ("op10", "op11", "op12", "op13")
    assert not of_documents or "doc_id" in out.columns
    rows = out.count()
    assert rows == 200 or not of_documents or name in ("op8_token_shards", "pipeline")
    assert rows
