"""The pipeline's stages against what their operators say of the same rows."""

from pathlib import Path

import corpus_pipeline as p
from tallybook.llm import quality, simhash, toxicity
from tallybook.llm.common import shared_dir


def test_stages_keep_columns_and_decide(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "secrets", "packing"]
    steps = dict(p.STAGES)
    kept = steps["quality"](spark, docs, sf)
    want = {r.doc_id for r in quality.scored(docs, quality.learnt(docs, labels)).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    clean = steps["toxicity"](spark, kept, sf)
    want = {r.doc_id for r in toxicity.scored(kept, toxicity.learnt(kept, labels)).where("predicted = 0").collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want
    single = steps["near_dedup"](spark, clean, sf)
    want = {r.component_id for r in simhash.near_duplicates(clean).collect()}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == want
    safe = steps["secrets"](spark, single, sf)
    assert safe.columns == docs.columns and safe.count() == single.count() and safe.where("text rlike 'token = .[0-9a-f]{40}'").count() == 0
    packed = steps["packing"](spark, safe, sf)
    assert packed.select("doc_id").distinct().count() == safe.count()


def test_stages_leave_no_tables_behind(spark, sf):
    """Of the stages before the last only the result of the fourth is still there."""
    here = Path(shared_dir(spark).removeprefix("file:"))
    before = {x.name for x in here.iterdir()} if here.exists() else set()
    packing, p.STAGES[-1] = p.STAGES[-1], ("packing", lambda spark, docs, sf_dir: docs)
    try:
        rows = p.run(spark, sf)
        assert [x.name.rsplit("-", 1)[0] for x in here.iterdir() if x.name not in before] == ["secrets"]
        assert rows.count() > 0
    finally:
        p.STAGES[-1] = packing


def test_run_gives_the_last_stage(spark, sf):
    assert set(p.run(spark, sf).columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
