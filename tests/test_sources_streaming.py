import json
import os

import pytest
from pyspark.sql import functions as F

from sheaf.operators import postprocess as P
from sheaf.operators import requests as RQ
from sheaf.session import scratch_path
from sheaf.sources import readers as R
from sheaf.streaming import routes as ST


def _write_text(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_tolerant_jsonl(spark):
    path = scratch_path(spark, "tolerant") + "/data.jsonl"
    _write_text(path, [json.dumps({"instruction": "q1", "output": "a1", "meta": {"millet_name": "x"}}),
                       "{not json", "", "[1, 2]", json.dumps({"instruction": "q2", "input": "", "output": 5})])
    rows = R.read_jsonl_tolerant(spark, path).collect()
    assert [(r.instruction, r.output) for r in rows] == [("q1", "a1"), ("q2", "5")]
    with pytest.raises(FileNotFoundError):
        R.read_jsonl_tolerant(spark, path + ".missing")


def test_strict_jsonl(spark):
    path = scratch_path(spark, "strict") + "/data.jsonl"
    _write_text(path, [json.dumps({"instruction": "q"}), "", json.dumps({"instruction": "r"})])
    assert R.read_jsonl_strict(spark, path).count() == 2
    with pytest.raises(Exception):
        R.read_jsonl_strict(spark, path, skip_blank=False).collect()
    bad = scratch_path(spark, "strict-bad") + "/data.jsonl"
    _write_text(bad, [json.dumps({"instruction": "q"}), "{oops"])
    with pytest.raises(Exception):
        R.read_jsonl_strict(spark, bad).collect()
    with pytest.raises(Exception):
        R.read_jsonl_strict(spark, bad).count()
    with pytest.raises(Exception):
        R.read_jsonl_strict(spark, path, skip_blank=False).count()
    tab = scratch_path(spark, "strict-tab") + "/data.jsonl"
    _write_text(tab, [json.dumps({"instruction": "q"}), "\t", "\u00a0 ", json.dumps({"instruction": "r"})])
    assert [r.instruction for r in R.read_jsonl_strict(spark, tab).collect()] == ["q", "r"]


def test_jsonl_line_order(spark):
    path = scratch_path(spark, "ordered") + "/data.jsonl"
    _write_text(path, [json.dumps({"instruction": f"q{i}"}) for i in range(500)])
    rows = R.read_jsonl_strict(spark, path, line_order=True).orderBy("_file", "_start", "_seq").collect()
    assert [r.instruction for r in rows] == [f"q{i}" for i in range(500)]


def test_lines_of_files_are_numbered_in_order(spark):
    """Files of many splits, one of them missing; broken and blank lines take no number."""
    base = scratch_path(spark, "numbered")
    want = []
    for name, n in (("a", 4000), ("b", 1500)):
        lines = []
        for i in range(n):
            lines += [json.dumps({"instruction": f"{name}{i}", "output": "x" * (i % 50)})] + ["{broken", ""] * (i % 7 == 0)
            want.append(f"{name}{i}")
        _write_text(f"{base}/{name}/part-0.jsonl", lines)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = R.numbered_lines(spark, [f"{base}/a", f"{base}/none", f"{base}/b"])
        assert got.rdd.getNumPartitions() > 10
        assert [(r.line, r.instruction) for r in got.orderBy("line").collect()] == list(enumerate(want))
        assert [r["_source"] for r in got.orderBy("line").collect()] == [0] * 4000 + [2] * 1500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_csv_with_line_breaks_by_many_tasks(spark):
    """Records over lines and splits, in two files of different line ends, as the one-task reader gives them."""
    import csv
    import random
    from sheaf.sources import quoted

    rng, base = random.Random(6), scratch_path(spark, "quoted")
    os.makedirs(base)
    want = []
    for name, end in (("a", "\n"), ("b", "\r\n")):
        rows = [[str(i), "".join(rng.choice(['x', '"', ',', '\n', 'é', '\n\n', ' ']) for _ in range(rng.randint(1, 60))), rng.choice(["p", "", "q,r"])] for i in range(700)]
        rows[50][1] = "long\n" * 3000      # over several splits
        with open(f"{base}/{name}.csv", "w", encoding="utf-8", newline="") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["id", "text\nname", "other"])
            w.writerows(rows)
            f.write(end)                    # a blank line at the end
        want += [(name, *r) for r in rows]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        records = quoted.read_records(spark, base)
        assert records.where("record > 0").count() == 1402 and records.select("file", "record").distinct().count() == records.count()
        got = quoted.read_csv(spark, base)
        assert got.columns == ["id", "text\nname", "other"]
        assert spark.read.text(base).rdd.getNumPartitions() > 10
        rows = sorted((r[0], r[1] or "", r[2] or "") for r in got.collect())
        assert rows == sorted((r[1], r[2], r[3]) for r in want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    with open(f"{base}/c.csv", "w") as f:
        f.write('id,x\n1,"open\n2,y\n')
    with pytest.raises(Exception, match="does not close"):
        quoted.read_records(spark, base).count()


def test_entity_csv_by_header_name(spark):
    path = scratch_path(spark, "csv-few") + "/e.csv"
    _write_text(path, ["extra,Millet Name,Millet ID,Recipes", "x,Ragi,7,NA"])
    r = R.read_entity_csv(spark, path).first()
    assert (r.millet_id, r.millet_name, r.recipes, r.origin_region) == ("7", "Ragi", None, None)


def test_entity_csv_na_tokens(spark):
    from sheaf.rules import defaults as D
    path = scratch_path(spark, "csv") + "/e.csv"
    headers = [h for h, _ in D.ENTITY_COLUMNS]
    row = ["1", "Ragi, finger", "u", "N/A", ""] + ["NA"] * (len(headers) - 5)
    _write_text(path, [",".join(f'"{h}"' for h in headers), ",".join(f'"{v}"' for v in row)])
    r = R.read_entity_csv(spark, path).first()
    assert r.millet_name == "Ragi, finger" and r.nutritional_profile is None and r.health_benefits is None


def test_eval_set_and_collection(spark):
    path = scratch_path(spark, "eval") + "/e.json"
    _write_text(path, [json.dumps([{"q": "a?", "a": "b"}, {"q": "c?", "a": "d"}], indent=1)])
    assert R.read_eval_set(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        R.open_collection(spark, path + ".none")


def test_jsonl_sink_roundtrip_keeps_unicode(spark):
    df = spark.createDataFrame([("₹ é", None)], "instruction string, output string")
    path = scratch_path(spark, "sink")
    R.write_jsonl(df, path)
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in os.listdir(path)
                   if f.endswith(".json"))
    assert "₹ é" in text and '"output":null' in text


def test_stream_equals_batch(spark):
    reqs = spark.createDataFrame(
        [(1, "Which millet is best?", "millet", None, "Recipe"), (2, "compare a and b", "base", "fast", None),
         (3, "   ", None, "thinking", None), (4, "how to grow", "Base", "thinking", "Cultivation")],
        RQ.REQUEST_SCHEMA)
    src, out, ck = (scratch_path(spark, n) for n in ("s-src", "s-out", "s-ck"))
    reqs.write.parquet(src)
    ST.start_to_parquet(ST.routed_stream(ST.request_stream(spark, src)), out, ck).awaitTermination()
    cols = ["request_id", "is_complex", "complexity_type", "max_tokens", "use_adapter", "is_recipe"]
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select(*cols).collect())
    batch = sorted(tuple(r) for r in RQ.route_requests(reqs).select(*cols).collect())
    assert streamed == batch and len(batch) == 3


def test_message_rows_error(spark):
    df = spark.createDataFrame([(1, "ok", ["a"], 95, None, True, "done"), (2, "x", [], 95, None, False, "error")],
                               "request_id long, response string, citations array<string>, confidence int, "
                               "thinking string, is_complex boolean, status string")
    rows = {r.id: r for r in P.message_rows(df).collect()}
    assert rows["2"].confidence == 0 and rows["2"].content.startswith("⚠️")
    assert rows["1"].content == "ok" and rows["1"].isComplex is True


def test_stream_prompt_builder_foreach_batch(spark):
    from conftest import SF_SMOKE
    from sheaf.plans import bindings as B
    from sheaf.plans.queries import knowledge_docs
    from sheaf.operators import prompts as PR
    recs = B.instruction_records(spark, SF_SMOKE)
    reqs = B.conversation_requests(recs)
    src, out, ck = (scratch_path(spark, n) for n in ("p-src", "p-out", "p-ck"))
    reqs.write.parquet(src)
    docs = knowledge_docs(spark, SF_SMOKE)
    q = ST.start_prompt_builder(ST.routed_stream(ST.request_stream(spark, src)), docs, out, ck)
    q.awaitTermination()
    streamed = spark.read.parquet(out).select("request_id", "prompt").orderBy("request_id").collect()
    batch = PR.assemble_prompts(RQ.route_requests(reqs), docs).select("request_id", "prompt")\
        .orderBy("request_id").collect()
    assert streamed == batch and len(batch) > 0


def test_replays_are_answered_once_and_late_requests_not(spark):
    from pyspark.sql import functions as F

    base = 1_700_000_000
    batches = [[("a", base), ("b", base + 10), ("a", base + 20)], [("b", base + 30), ("c", base + 9000)],
               [("c", base + 9100)], [("late", base + 100), ("d", base + 8000)]]
    src, out, ck = (scratch_path(spark, n) for n in ("r-src", "r-out", "r-ck"))
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(i, "which is best?", None, None, None, t) for i, t in rows], "request_id string, message string, model_type string, mode string, context string, t long")
        df.withColumn("asked_at", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(src)
    stream = ST.routed_stream(ST.once(ST.timed_request_stream(spark, src, files_per_batch=1)))
    ST.start_to_parquet(stream, out, ck).awaitTermination()
    got = sorted(r.request_id for r in spark.read.parquet(out).collect())
    assert got == ["a", "b", "c", "d"]      # "late" comes when the watermark has passed its time
