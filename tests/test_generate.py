from pyspark.sql import functions as F

from conftest import SF_SMOKE
from sheaf.operators import generate as G
from sheaf.plans import bindings as B
from sheaf.rules import defaults as D


def test_recipe_parse_edges(spark):
    rows = [(0, "A: one | B: two | A: three"), (1, "no separator | : empty name | C:x:y"), (2, None),
            (3, "Not available"), (4, "  | ")]
    df = spark.createDataFrame(rows, "k long, recipes string")
    out = {r.k: [(x.recipe_name, x.recipe_steps) for x in r.p]
           for r in df.select("k", G.parse_recipes(F.col("recipes")).alias("p")).collect()}
    assert out[0] == [("A", "three"), ("B", "two")]          # first position, last value
    assert out[1] == [("", "empty name"), ("C", "x:y")]       # split at the first colon only
    assert out[2] == [] and out[3] == [] and out[4] == []


def test_rows_per_entity_invariant(spark):
    ent = B.entities(spark, SF_SMOKE)
    safe = G.positioned_entities(ent, B.ENTITY_ORDER)
    rows = G.generate_entity_instructions(safe)
    counts = {r.entity_pos: r.n for r in rows.groupBy("entity_pos").agg(F.count(F.lit(1)).alias("n")).collect()}
    parsed = safe.select("entity_pos", F.size(G.parse_recipes(F.col("recipes"))).alias("n"),
                         (F.col("nutritional_profile") != D.NOT_AVAILABLE).alias("has_nutr")).collect()
    for r in parsed:
        expected = 34 + (6 if r.has_nutr else 0) + (2 * r.n + 3 if r.n > 0 else 0)
        assert counts[r.entity_pos] == expected


def test_neighbor_pairs_count(spark):
    for n in (0, 1, 2, 3, 7):
        ent = spark.range(n).select(F.col("id").alias("p_partkey"),
                                    F.concat(F.lit("name "), F.col("id").cast("string")).alias("millet_name"))
        safe = G.positioned_entities(ent, ["p_partkey"])
        assert G.generate_comparisons(safe).count() == 3 * max(0, 2 * n - 3)


def test_gluten_fragment_and_defaults(spark):
    ent = spark.createDataFrame([(1, "Yes"), (2, "no"), (3, None)], "p_partkey long, gluten_free string")
    safe = G.positioned_entities(ent, ["p_partkey"])
    rows = G.generate_entity_instructions(safe).where(F.col("instruction").startswith("Is ")).orderBy("entity_pos")
    outs = [r.output for r in rows.collect()]
    assert "naturally gluten-free, making it suitable" in outs[0]
    assert "naturally not gluten-free, making it unsuitable" in outs[1]
    assert outs[2].startswith("Gluten-Free Status: Not available")


def test_recipe_parse_long_row_is_fast(spark):
    import time
    text = " | ".join(f"r{i % 1000}: step {i}" for i in range(3000))
    df = spark.createDataFrame([(text,)], "recipes string")
    t = time.time()
    got = df.select(G.parse_recipes(F.col("recipes")).alias("p")).first().p
    assert time.time() - t < 30
    assert len(got) == 1000 and got[0].recipe_name == "r0" and got[0].recipe_steps == "step 2000"
