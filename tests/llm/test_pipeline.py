"""The pipeline's stages, each against a plain version on the rows before it."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from lakeops.llm import mixing, toxicity
from lakeops.session import new_work_dir
from tests.llm.test_operators import SPACES, order, plain_near

SF_DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_work_dir(spark, "test-stage")
        stage(spark, docs, SF_DIR).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        steps[name] = (before, docs)
    for name in ("toxicity", "exact dedup", "near dedup", "mixing"):
        assert steps[name][1].columns == columns

    before, after = steps["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scores = toxicity.scored_documents(before, model)
    clean = scores.filter(F.col("score") < toxicity.REJECT).select("doc_id")
    assert order(clean.collect()) == order(after.select("doc_id").collect())

    before, after = steps["exact dedup"]
    best = {}
    for r in before.collect():
        key = re.sub(f"[{SPACES}]", "", r.text or "")
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(r.text or ""), r.doc_id))
    assert sorted(d for _, d in best.values()) == sorted(r.doc_id for r in after.collect())

    before, after = steps["near dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    kept = {d for d, _, c in plain_near(rows, 5, 80) if d == c}
    assert kept == {r.doc_id for r in after.collect()} and after.count() == len(kept)

    before, after = steps["mixing"]
    copies = mixing.mixed_copies(before).select("doc_id", "copies").filter("copies > 0")
    assert order(map(tuple, copies.collect())) == order(
        map(tuple, after.groupBy("doc_id").count().collect())
    )

    before, after = steps["sentencepiece"]
    assert after.filter("not decodes").isEmpty()
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, SF_DIR).count() == after.count()
