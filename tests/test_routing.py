from pyspark.sql import functions as F

from conftest import column_values
from sheaf.functions import route as R
from sheaf.operators import augment as A
from sheaf.operators import docs as DOCS
from sheaf.operators import requests as RQ
from sheaf.operators import training as TR


def test_keyword_inside_longer_word_and_first_group_wins(spark):
    got = column_values(spark, ["Protect the environment", "Grow better soil", "Recipe and price list",
                                "Which dish"], lambda c: DOCS.category(c))
    assert got == ["nutrition", "cultivation", "market", "recipe"]     # "env-iron-ment" is nutrition


def test_complexity_first_trigger_in_table_order(spark):
    got = column_values(spark, ["Diabetes: compare ragi vs bajra", "Which grain?", "What is the best grain",
                                "tell me", "Is it safe for a baby"], lambda c: R.complexity_type(c))
    assert got == ["comparison", "decision_making", "decision_making", None, "health_reasoning"]


def test_mode_override_and_budget(spark):
    reqs = spark.createDataFrame([(1, "compare a", "x", "fast", None), (2, "hello", "base", "thinking", None),
                                  (3, "compare a", None, None, None), (4, "hello", "BASE", "other", None),
                                  (5, " \t ", None, None, None)], RQ.REQUEST_SCHEMA)
    rows = {int(r.request_id): r for r in RQ.route_requests(reqs).collect()}
    assert set(rows) == {1, 2, 3, 4}                                   # blank message dropped (FLT7)
    assert (rows[1].is_complex, rows[1].complexity_type, rows[1].max_tokens) == (False, None, 350)
    assert (rows[2].is_complex, rows[2].complexity_type, rows[2].max_tokens) == (True, "user_selected_thinking", 600)
    assert (rows[3].is_complex, rows[3].max_tokens, rows[3].use_adapter) == (True, 400, True)
    assert (rows[4].is_complex, rows[4].max_tokens, rows[4].use_adapter) == (False, 350, False)


def test_confidence_bands(spark):
    df = spark.createDataFrame([(0,), (50,), (51,), (80,), (81,), (95,)], "s int")
    assert [r.b for r in df.select(R.confidence_band(F.col("s")).alias("b")).collect()] == \
        ["low", "low", "medium", "medium", "high", "high"]


def test_preference_cascade(spark):
    df = spark.createDataFrame([("Chena uses", "a"), ("Soil pH", "b"), ("Protein in X", "has 12.5 and 10.4"),
                                ("Protein in Y", "no numbers"), ("Compare soil", "c"), ("phosphorus need", "d")],
                               "instruction string, output string")
    rows = {r.prompt: r.rejected for r in TR.preference_pairs(df).collect()}
    assert rows["Chena uses"].startswith("Chena is a type of fresh Indian cheese")
    assert rows["Protein in X"] == "has 8.0 and 6.0"
    assert "Protein in Y" not in rows                                   # no number -> no pair
    assert rows["Compare soil"].startswith("The optimal soil pH")       # soil branch before compare
    assert rows["phosphorus need"].startswith("The optimal soil pH")    # 'ph' is a substring test


def test_missing_meta_and_name_lookup(spark):
    df = spark.createDataFrame([(0, "What is ragi good for?", None), (1, "tell me", {"source": "x"}),
                                (2, "any", {"millet_name": "Kodo"})],
                               "i long, instruction string, meta map<string,string>")
    out = df.select("i", A.tag_meta(F.col("meta"), "augmentation", "rephrased").alias("m"),
                    A.subject_name(F.col("instruction"), F.coalesce("meta", F.create_map().cast(
                        "map<string,string>"))).alias("n")).orderBy("i").collect()
    assert out[0].m == {"augmentation": "rephrased"} and out[0].n == "Ragi"
    assert out[1].m == {"source": "x", "augmentation": "rephrased"} and out[1].n == ""
    assert out[2].n == "Kodo"


def test_crlf_lines_in_facts(spark):
    got = column_values(spark, ["Protein: 12.5 g\r\nFibre: 3.2 g\r\n"], lambda c: A.extract_facts(c))[0]
    assert [(f.key, f.value) for f in got] == [("Protein", "12.5 g"), ("Fibre", "3.2 g")]
