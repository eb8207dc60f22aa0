import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMOKE
from sheaf.plans import bindings as B
from sheaf.plans import jobs as J
from sheaf.session import scratch_path
from sheaf.sources import readers as R


def test_knowledge_base_collection_and_probe(spark):
    recs = B.instruction_records(spark, SF_SMOKE)
    path = scratch_path(spark, "kb")
    coll = J.knowledge_base(recs, B.RECORD_ORDER, groups=B.CORPUS_CATEGORIES)
    total = J.store_knowledge_base(coll, path)
    back = R.open_collection(spark, path)
    assert back.count() == coll.count() == total > 0
    assert set(back.columns) >= {"doc_index", "page_content", "category", "embedding"}
    hits = J.probe(spark, back)
    assert hits.groupBy("qid").count().select(F.max("count")).first()[0] == 3
    assert hits.select("qid").distinct().count() == 5


def test_preference_set_reuses_file(spark):
    df = spark.createDataFrame([("Compare A and B", "x"), ("soil of A", "soil answer"), ("plain", "p")],
                               "instruction string, output string")
    path = scratch_path(spark, "prefs")
    first = J.preference_set(spark, df, path).collect()
    assert len(first) == 2
    again = J.preference_set(spark, df.limit(0), path).collect()     # file exists -> reused, not rebuilt
    assert sorted(map(tuple, again)) == sorted(map(tuple, first))


def test_union_optional_and_json_dataset(spark):
    base = scratch_path(spark, "src")
    os.makedirs(base, exist_ok=True)
    p1, p2 = os.path.join(base, "a.jsonl"), os.path.join(base, "b.jsonl")
    with open(p1, "w") as f:
        f.write(json.dumps({"instruction": "q1", "output": "a1"}) + "\n")
    primary = R.read_json_dataset(spark, p1)
    assert R.union_optional(spark, primary, p2).count() == 1           # missing second source
    with open(p2, "w") as f:
        f.write(json.dumps({"instruction": "q2", "output": "a2"}) + "\n")
    both = R.union_optional(spark, primary, p2).orderBy("_source").collect()
    assert [(r.instruction, r._source) for r in both] == [("q1", 0), ("q2", 1)]


def test_instruction_and_augment_jobs(spark):
    ent = B.entities(spark, SF_SMOKE).where(F.col("p_partkey") < 12)
    recs = J.instruction_set(ent, B.ENTITY_ORDER)
    per_name, avg = J.instruction_stats(recs)
    assert avg.first().total == recs.count()
    aug = J.augment_records(recs, ["part", "entity_pos", "item"])
    numbered = recs.withColumn("rec_pos", F.col("entity_pos") * 1000 + F.col("item") + F.col("part") * 10**6)
    assert J.augment_records(numbered).count() == aug.count()
    counts = aug.groupBy("origin").count().collect()
    assert {r.origin for r in counts} == {"original", "rephrased", "qa", "negative"}


def test_observed_row_total(spark):
    df, obs = J.counted(spark.range(1234), "n")
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 1234
