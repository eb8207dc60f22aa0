"""The keyword index against the ``when`` chain and against brute force."""

import random

from pyspark.sql import functions as F

from sheaf.functions.text import first_label
from sheaf.operators import keywords


def test_index_equals_the_when_chain(spark):
    rng = random.Random(3)
    letters = "abcé😀 -"
    texts = [None, "", "a", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400))]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(150)]
    rules = [(k, w, f"L{k % 13}") for k, w in enumerate(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("label", F.lit("clash")).drop("label")
    table = spark.createDataFrame(rules, "priority long, keyword string, label string")
    for size in (2, 4):
        got = {r.id: r.label for r in keywords.first_labels(df, "text", table, default="none", gram_size=size).collect()}
        chain = first_label(F.coalesce("text", F.lit("")), [(label, [w]) for _, w, label in rules], "none")
        want = {r.id: r.label for r in df.select("id", chain.alias("label")).collect()}
        assert got == want


def test_ties_empty_keywords_hot_texts_and_nulls(spark):
    rules = spark.createDataFrame([(2, "b", "two"), (1, "c", "one"), (1, "b", "first"), (9, "", "any"), (None, "a", "never"), (0, None, "never"), (3, "zz", None)],
                                  "priority int, keyword string, label string")
    df = spark.createDataFrame([(1, "abc"), (2, "c"), (3, "x"), (4, ""), (5, None)] + [(10 + k, "abc abc") for k in range(500)], "id long, text string")
    got = {r.id: r.label for r in keywords.first_labels(df, "text", rules, out_col="label", default="d").collect()}
    assert [got[k] for k in range(1, 6)] == ["first", "one", "any", "any", "d"] and {got[10 + k] for k in range(500)} == {"first"}
    assert keywords.first_labels(df.limit(0), "text", rules).count() == 0
    assert {r.label for r in keywords.first_labels(df, "text", rules.limit(0), default="d").collect()} == {"d"}
    null_label = keywords.first_labels(spark.createDataFrame([("zz",)], "text string"), "text", rules, default="d").collect()
    assert null_label[0].label is None


def test_long_texts_are_cut_in_linear_time(spark):
    import time

    text = "".join(chr(97 + k * k % 26) for k in range(400_000))
    df = spark.createDataFrame([(1, text + "needle")], "id long, text string")
    rules = spark.createDataFrame([(1, "needle", "found")], "priority long, keyword string, label string")
    began = time.time()
    assert keywords.first_labels(df, "text", rules).first().label == "found"
    assert time.time() - began < 30


def test_a_hundred_thousand_keywords(spark):
    rules = spark.range(100_000).select(F.col("id").alias("priority"), F.concat(F.lit("key"), F.col("id"), F.lit("!")).alias("keyword"), F.col("id").cast("string").alias("label"))
    df = spark.range(2000).select("id", F.concat(F.lit("has key"), F.col("id") * 37, F.lit("! and key"), F.col("id") * 11, F.lit("! inside")).alias("text"))
    got = {r.id: r.label for r in keywords.first_labels(df, "text", rules).collect()}
    assert got == {k: str(min(k * 37, k * 11) if k * 37 < 100_000 else k * 11) for k in range(2000)}


def test_one_row_a_keyword_is_written(spark, monkeypatch):
    rows, real = {}, keywords.stored

    def counting(df, name):
        out = real(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(keywords, "stored", counting)
    rules = spark.range(3000).select(F.col("id").alias("priority"), F.concat(F.lit("a phrase of words "), F.col("id")).alias("keyword"), F.lit("x").alias("label"))
    df = spark.createDataFrame([("has a phrase of words 17 in it",), ("a phrase of words",), (None,)], "text string")
    got = [r.label for r in keywords.first_labels(df, "text", rules.unionByName(rules), default="none").collect()]
    assert sorted(got) == ["none", "none", "x"]
    assert rows["keyword-rules"] == 6000 and rows["keyword-index"] <= 30 and sum(rows.values()) < 6100


def test_later_rules_are_written_only_for_texts_without_a_label(spark, monkeypatch):
    """the whole table of rules was written, and every pair of a text and a rule with a gram in it."""
    rows, real = [], keywords.stored

    def counting(df, name):
        out = real(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(keywords, "stored", counting)
    monkeypatch.setattr(keywords, "SAMPLED", 1, raising=False)
    monkeypatch.setattr(keywords, "FIRST", 20, raising=False)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé😀 ") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    rules = [(k // 2, w, f"L{k % 17}") for k, w in enumerate(words)]
    texts = [None, "", "zzzz", *("".join(rng.choice("abcdé😀 ") for _ in range(rng.randint(0, 60))) for _ in range(200)), words[2900], words[1234]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.label for r in keywords.first_labels(df, "text", spark.createDataFrame(rules, "priority long, keyword string, label string"), default="none").collect()}
    order = sorted(((p, w, label) for p, w, label in rules))
    assert got == {k: next((label for _, w, label in order if t is not None and w in t), "none") for k, t in enumerate(texts)}
    assert sum(n for name, n in rows if name == "keyword-rules") < 1500
