import os

import pandas as pd
from pyspark.sql import functions as F

from sheaf.operators.positions import with_position
from sheaf.plans import bindings as B
from sheaf.session import scratch_path


def test_positions_independent_of_input_partitioning(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"), F.col("id").alias("v"))
    a = {r.v: r.pos for r in with_position(df, ["k", "v"], "pos", num_partitions=4).collect()}
    b = {r.v: r.pos for r in with_position(df.repartition(13), ["k", "v"], "pos", num_partitions=7).collect()}
    assert a == b and sorted(a.values()) == list(range(5000))


def test_records_exact_with_a_hot_conversation(spark):
    # one conversation holds a third of all turns
    rows = []
    for conv in range(60):
        turns = 60 if conv == 0 else 2
        for t in range(turns):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((conv, t, role, f"c{conv} t{t} {role}"))
        if conv % 5 == 0:
            rows.append((conv, -1, "system", f"sys {conv}"))
    pdf = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    d = scratch_path(spark, "skewdata")
    os.makedirs(d, exist_ok=True)
    spark.createDataFrame(pdf).repartition(5).write.parquet(f"{d}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.instruction, r.input, r.output)
           for r in B.instruction_records(spark, d).collect()}
    want = {}
    for r in pdf[pdf.role == "user"].itertuples():
        nxt = pdf[(pdf.conv_id == r.conv_id) & (pdf.turn == r.turn + 1) & (pdf.role == "assistant")]
        sysr = pdf[(pdf.conv_id == r.conv_id) & (pdf.role == "system")]
        want[(r.conv_id, r.turn)] = (r.text, sysr.text.iloc[0] if len(sysr) else "",
                                     nxt.text.iloc[0] if len(nxt) else "")
    assert got == want


def test_positions_store_nothing_and_take_nulls_ties_and_composite_keys(spark):
    rng = pd.Series(range(3000)).sample(frac=1, random_state=1)
    rows = [(None if v % 10 == 0 else f"k{v % 37}", v % 11 if v % 13 else None, int(v)) for v in rng]
    df = spark.createDataFrame(rows, "a string, b long, v long")
    want = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or 0), r[2]))
    for ranges in (1, 3, 40):
        placed = with_position(df, ["a", "b", "v"], "pos", num_partitions=ranges, start=("begin", F.col("v") % 4))
        got = sorted((r.pos, r.v, r.begin) for r in placed.collect())
        assert [g[0] for g in got] == list(range(3000)) and [g[1] for g in got] == [w[2] for w in want]
        total = 0
        for _, v, begin in got:
            assert begin == total
            total += v % 4
    ties = with_position(df.withColumn("one", F.lit(1)), ["one"], "pos", num_partitions=5)
    assert sorted(r.pos for r in ties.collect()) == list(range(3000))
    assert with_position(df.limit(0), ["a"], "pos").collect() == []


def test_numbering_writes_no_texts(spark, tmp_path):
    from sheaf.plans.queries import knowledge_docs
    from sheaf.session import shared_dir
    from conftest import SF_SMOKE

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(shared_dir(spark)) for f in names}

    before = files()
    assert knowledge_docs(spark, SF_SMOKE).count() > 0
    assert files() == before
