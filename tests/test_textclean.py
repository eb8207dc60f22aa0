from pyspark.sql import functions as F

from conftest import column_values
from sheaf.functions import textclean as T
from sheaf.operators import postprocess as P
from sheaf.operators import textstages as S
from sheaf.rules import defaults as D


def test_cutoff_markers(spark):
    got = column_values(spark, ["Answer here.\nUser: more", "A QUESTION: b KNOWLEDGE: c", "clean"],
                        lambda c: T.cut_at_markers(c))
    assert got == ["Answer here.", "A", "clean"]


def test_short_text_fallback(spark):
    got = column_values(spark, ["x" * 19, "x" * 20], lambda c: T.clean_leakage(c))
    assert got == [D.SHORT_TEXT_FALLBACK, "x" * 20]


def _split_row(spark, text, question="compare a and b", complex_=True):
    df = spark.createDataFrame([(1, question, text, complex_)], "request_id long, question string, r string, "
                                                                 "is_complex boolean")
    return P.post_process(df, response="r").select("answer", "thinking").first()


def test_marker_position_50_vs_51(spark):
    tail = " " + "y" * 90
    at50 = "x" * 50 + "In conclusion" + tail          # marker index 50: not > 50 -> no split
    at51 = "x" * 51 + "In conclusion" + tail          # index 51 -> split
    assert _split_row(spark, at50).thinking is None
    r = _split_row(spark, at51)
    assert r.thinking == "x" * 51 and r.answer.startswith("In conclusion")


def test_answer_80_vs_81_chars(spark):
    head = "x" * 60 + " "
    short = head + "Winner:" + "z" * 73                 # answer 80 chars -> no split
    long_ = head + "Winner:" + "z" * 74                 # 81 chars -> split
    assert _split_row(spark, short).thinking is None
    assert _split_row(spark, long_).thinking == "x" * 60


def test_recipe_questions_never_split(spark):
    text = "x" * 60 + " In conclusion " + "y" * 100
    assert _split_row(spark, text, question="compare recipe for a and b").thinking is None


def test_transition_prefix_and_capitalisation(spark):
    text = "x" * 60 + " Therefore, based on the above: the winner is clear " + "w" * 80
    r = _split_row(spark, text)
    assert r.answer.startswith("Therefore,")


def test_subject_validation(spark):
    got = column_values(spark, ["Try kuttu roti today", "Try jowar roti"],
                        lambda r, q: T.validate_subject(r, q), ["jowar recipe?", "jowar recipe?"])
    assert got[0].startswith("I apologize") and "**Jowar**" in got[0]
    assert got[1] == "Try jowar roti"


def test_citations(spark):
    vals = ["Main text\n---\n- A\n* B\n-   \n- C\n- D", "no marker ", "x---\nplain line"]
    got = column_values(spark, vals, lambda c: T.parse_citations(c))
    assert (got[0].main, got[0].citations) == ("Main text", ["A", "B", "C"])
    assert (got[1].main, got[1].citations) == ("no marker", [D.CITATION_DEFAULT])
    assert (got[2].main, got[2].citations) == ("x", [D.CITATION_DEFAULT])


def test_stages_equal_plain_folds(spark):
    vals = ["Please provide your response now. Thanks are due to scientists of X. keep. Since these were.",
            "So, if it is. Recipe 2: x  Ingredients: y", "plain text without triggers", "pest control. eat well."]
    df = spark.createDataFrame([(i, v, "how to cook") for i, v in enumerate(vals)], "i long, v string, q string")
    a = S.clean_response_stage(df, "v", "o").orderBy("i").select("o").collect()
    b = df.orderBy("i").select(T.clean_response(F.col("v")).alias("o")).collect()
    assert a == b
    a = S.clean_leakage_stage(df, "v", "o").orderBy("i").select("o").collect()
    b = df.orderBy("i").select(T.clean_leakage(F.col("v")).alias("o")).collect()
    assert a == b
    a = S.filter_off_topic_stage(df, "v", "o", "q").orderBy("i").select("o").collect()
    b = df.orderBy("i").select(T.filter_off_topic(F.col("v"), F.col("q")).alias("o")).collect()
    assert a == b


def test_prechecks_fold_special_letters_like_the_passes(spark):
    """Dotted capital I, dotless i and long s in every literal: staged forms equal the plain folds."""
    base = ["Feel free to ask more!", "Would you like any variations?", "Thanks are due to scientists of the centre."]
    base += [x for x in D.OFF_TOPIC_NUTRITION_PATTERNS[:3]] + ["Text before. The seed treatment with thiram matters. Farmers use crop rotation."]
    variants = []
    for t in base:
        for a, b in (("i", "\u0131"), ("i", "\u0130"), ("s", "\u017f"), ("I", "\u0130"), ("S", "\u017f")):
            variants.append(t.replace(a, b))
    rows = [(i, "Some text first. " + t + " And more text follows here.", "Give me a recipe to cook") for i, t in enumerate(variants)]
    df = spark.createDataFrame(rows, "i long, v string, q string")
    for stage, plain in ((S.clean_response_stage, T.clean_response), (S.clean_leakage_stage, T.clean_leakage)):
        a = stage(df, "v", "o").orderBy("i").select("o").collect()
        b = df.orderBy("i").select(plain(F.col("v")).alias("o")).collect()
        assert a == b
    a = S.filter_off_topic_stage(df, "v", "o", "q").orderBy("i").select("o").collect()
    b = df.orderBy("i").select(T.filter_off_topic(F.col("v"), F.col("q")).alias("o")).collect()
    assert a == b


def test_a_changed_row_skips_passes_that_cannot_match(spark):
    import time

    from pyspark.sql import functions as F

    from sheaf.operators.textstages import fold_expr

    rules = [("zebra", "ox"), (r"[^.]*needle[^.]*\.\s*", ""), ("ox", "needle"), (r"[^.]*needle\b[^.]*\.\s*", "cut")]
    long = "zebra" + "a " * 150_000
    df = spark.createDataFrame([(1, "a zebra. b needle. c"), (2, long), (3, None)], "id long, t string")
    began = time.time()
    few = {r.id: r.t for r in df.select("id", fold_expr(F.col("t"), rules[:2]).alias("t")).collect()}
    assert few == {1: "a ox.c", 2: "ox" + long[5:], 3: None}
    assert time.time() - began < 30
    short = df.where("id = 1").select(fold_expr(F.col("t"), rules).alias("t")).first().t
    assert short == "cutc"      # the literal that a later pass needs was made by an earlier one
