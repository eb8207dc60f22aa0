import re

from pyspark.sql import functions as F

from conftest import column_values
from sheaf.functions import text as T
from sheaf.operators import augment as A
from sheaf.operators import generate as G
from sheaf.operators.permute import Permutation
from sheaf.rules.dialect import java_pattern


def _entities(spark, n):
    return spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("name "), F.col("id")).alias("millet_name"),
                                 F.lit("A: one | B: two").alias("recipes"), F.lit("Protein: 12.5 g").alias("nutritional_profile"))


def test_neighbours_are_not_collected_for_a_broadcast(spark):
    """the compressed file looked small enough to be sent to the driver whole."""
    rows = G.positioned_instruction_set(_entities(spark, 50), ["p_partkey"])
    rows.count()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_entities_are_dealt_by_their_number(spark, monkeypatch):
    """texts of all entities were made in one task where the entities' bytes were few."""
    monkeypatch.setattr(G, "ENTITIES_A_TASK", 3)
    rows = G.positioned_instruction_set(_entities(spark, 300), ["p_partkey"])
    one = rows.where("part = 0").select(F.spark_partition_id().alias("p"))
    assert one.distinct().count() > 50
    places = sorted(r.rec_pos for r in rows.select("rec_pos").collect())
    assert places == list(range(len(places)))


def test_place_in_steps_is_the_folds(spark):
    for n in (1, 7, 9973, A.ROW_NUMBERS):
        p = Permutation(n, 5)
        df = spark.range(300).select((F.col("id") * 37_000_001 % n).alias("id"), F.lit("x").alias("other"))
        got = p.with_place(df, F.col("id"), "at")
        assert got.columns == ["id", "other", "at"]
        assert all(r["at"] == p.number(r.id) for r in got.collect())
    plan = A.seeded_shuffle(spark.range(5).select(F.lit("qa").alias("origin"), F.col("id").alias("rec_pos"), F.lit(0).alias("sub")))
    assert "lambdafunction" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_strip_by_characters_is_the_pattern(spark):
    ends = [chr(c) for c in [*range(1, 0x30), *range(0x80, 0xA2), 0x1680, 0x180E, *range(0x1FFF, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    vals = [e + "a" + e + " b " + e for e in ends] + ["", " ", "　\n", None, "x"]
    assert column_values(spark, vals, T.ustrip) == column_values(spark, vals, lambda c: F.regexp_replace(c, java_pattern(r"^\s+|\s+\z"), ""))
    chars = " -•*#]^\\"
    cls = "[" + re.escape(chars) + "]+"
    vals += ["-]a-]^", "•*#", "\\x\\", "- • k • -"]
    assert column_values(spark, vals, lambda c: T.strip_chars(c, chars)) == column_values(spark, vals, lambda c: F.regexp_replace(c, java_pattern(f"^{cls}|{cls}\\z"), ""))
