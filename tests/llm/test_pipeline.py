"""The pipeline, stage by stage, against brute force."""

import re
from pathlib import Path

import corpus_pipeline
import duckdb
import test_models as brute
from fixtures import documents, with_clashes

from orbweave.llm import quality_rules
from orbweave.llm.common import materialise, shared_dir


def test_each_stage_acts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, sf), "test")
        seen.append((name, docs, out))
        docs = out
    for _, before, after in seen[:-1]:
        assert after.columns == before.columns and after.join(before, "doc_id", "left_anti").count() == 0
    _, before, after = seen[0]
    kept = {r.doc_id for r in quality_rules.quality_rules(before, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    _, before, after = seen[1]
    rows = [(r.doc_id, brute.brute_print(r.text)) for r in before.collect()]
    root = brute.brute_roots({p for _, p in rows})
    assert sorted(r.doc_id for r in after.collect()) == sorted(min(i for i, p in rows if root[p] == g) for g in set(root.values()))
    _, before, after = seen[2]
    items = [x for (x,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    assert not [r for r in after.collect() if any(x in r.text for x in items)]
    _, before, after = seen[3]
    assert after.count() == before.count()
    assert not [r for r in after.collect() if re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text)]
    _, before, after = seen[4]
    assert brute.check_packing(after.collect(), brute.token_ids([(r.doc_id, r.text) for r in before.collect()])) < 1024


def test_run_equals_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_run_leaves_only_its_result(spark, sf):
    """Tables of the stages go once they are read."""
    folder = Path(shared_dir(spark).removeprefix("file://")) / "orbweave"
    before = {p.name for p in folder.glob("*")}
    out = corpus_pipeline.run(spark, sf)
    assert [p.name for p in folder.glob("*") if p.name not in before and not p.name.startswith("stage-4-")] == []
    assert out.count() > 0


def test_stages_on_odd_tables(spark, sf):
    for df in (documents(spark), with_clashes(documents(spark)), documents(spark).limit(0)):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf), "test")
            assert docs.columns == df.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()
