from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from orthomill.llm.tables import stored
from tests.llm.test_mixing_packing import PATH
from tests.llm.test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_in_order_on_all_that_was_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        seen[name] = docs
        if name != "pack":
            assert docs.columns == seen[""].columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = seen["grade"].select("doc_id").join(labels, "doc_id")
    assert kept.filter("quality = 1").count() >= 0.97 * labels.filter("quality = 1").count() and kept.filter("quality = 0").count() <= 0.3 * labels.filter("quality = 0").count()
    graded = [(r.doc_id, r.text) for r in seen["grade"].collect()]
    assert brute_kept(graded) == sorted((False, r.doc_id) for r in seen["near_duplicates"].collect())
    before, after = ({r.doc_id: r.text for r in seen[n].collect()} for n in ("near_duplicates", "pseudonymise"))
    assert before.keys() == after.keys() and 0 < sum(before[d] != after[d] for d in before) < len(before) / 2
    copies = Counter(r.doc_id for r in seen["mix"].collect())
    assert set(copies) <= set(after) and max(copies.values()) <= 2
    ids = seen["pack"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.n for r in ids} == {r.doc_id: r.t * copies[r.doc_id] for r in ids} and len(ids) == len(copies)
    assert corpus_pipeline.run(spark, SF).count() == seen["pack"].count()
    assert PATH


def test_empty_documents_go_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
    assert docs.count() == 0
