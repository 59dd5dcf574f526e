"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from quillmill.llm import secrets
from tests.llm.test_operators import ROWS, SCHEMA, plain_groups, plain_measures, plain_print, plain_secrets


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r.asDict() for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == names
        count = lambda rows, *c: Counter(tuple(r[x] for x in c) for r in rows)
        if name == "quality_rules":
            assert count(after, "doc_id", "text") == count([r for r in before if not plain_measures(r["text"])[-1]], "doc_id", "text")
        elif name == "near_duplicates":
            groups = plain_groups([plain_print(r["text"]) for r in before])
            assert len(after) == len(set(groups))
            least = {}
            for r, g in zip(before, groups, strict=True):
                least.setdefault(g, []).append(r["doc_id"])
            ids = sorted(min((i for i in own if i is not None), default=-1) for own in least.values())
            assert ids == sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in after)
        elif name == "secret_scans":
            assert len(after) == len(before) and all(plain_secrets(r["text"])[:3] == (0, 0, 0) for r in after)
            same = {r["doc_id"]: r["text"] for r in after}
            assert all(same[r["doc_id"]] == r["text"] for r in before if not secrets.find(r["text"] or ""))
        elif name == "mixing_sources":
            texts = {(r["doc_id"], r["text"]) for r in before}
            assert all((r["doc_id"], r["text"]) in texts for r in after)
            assert max(count(after, "doc_id").values()) <= 3
        else:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.count() == len(after)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
