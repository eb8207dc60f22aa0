"""Instruction generation from wide entity rows (GEN1-11, JOIN1, GEN10, AGG2-3).

One entity row becomes an array of ``(category, instruction, input,
output)`` structs built from templates, exploded once with its position;
this keeps the reference's output order (entity, category, template) as
``(entity_pos, item)`` columns.  Everything per entity is narrow; the only
shuffles are the position assignment (range partition) and the
neighbour-pair equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import col_or_lit, let, render, safe_get, ustrip
from sheaf.operators.positions import with_position
from sheaf.session import stored
from sheaf.rules import defaults as D

ROW_TYPE = "array<struct<category:string,instruction:string,input:string,output:string>>"
RECIPE_TYPE = "array<struct<recipe_name:string,recipe_steps:string>>"


def safe_entities(ent: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """PRJ1 over all entity columns; absent columns read as missing."""
    present = set(ent.columns)
    cols = [F.col(k) for k in keep]
    for _, name in D.ENTITY_COLUMNS:
        src = F.col(name) if name in present else F.lit(None).cast("string")
        cols.append(safe_get(src).alias(name))
    return ent.select(*cols)


def parse_recipes(c) -> Column:
    """GEN8: ``name: steps | name: steps`` -> ordered array of (name, steps).

    Pieces are stripped, pieces without ``:`` dropped, split at the first
    ``:``; a repeated name keeps its first position and its last value
    (dict-assignment semantics).  Per-row array work, no shuffle.
    """
    c = col_or_lit(c)
    parts = F.transform(F.split(c, r"\|", -1), lambda p: ustrip(p))
    with_colon = F.filter(parts, lambda p: F.instr(p, ":") > 0)
    pairs = F.transform(with_colon, lambda p, i: F.struct(
        i.alias("i"),
        ustrip(F.substring_index(p, ":", 1)).alias("recipe_name"),
        ustrip(p.substr(F.instr(p, ":") + 1, F.lit(1 << 30))).alias("recipe_steps")))
    # first position and last value per name in O(n log n): sort by (name, position),
    # keep each name group's first and last element, pair them, restore position order
    by_name = F.array_sort(F.transform(pairs, lambda x: F.struct(
        x["recipe_name"].alias("n"), x["i"].alias("i"), x["recipe_steps"].alias("s"))))

    def dedupe(b):
        size = F.size(b)
        firsts = F.filter(b, lambda x, j: (j == 0) | (F.element_at(b, F.greatest(j, F.lit(1)))["n"] != x["n"]))
        lasts = F.filter(b, lambda x, j: (j == size - 1) | (F.element_at(b, F.least(j + 2, size))["n"] != x["n"]))
        merged = F.array_sort(F.zip_with(firsts, lasts, lambda a, z: F.struct(
            a["i"].alias("i"), a["n"].alias("recipe_name"), z["s"].alias("recipe_steps"))))
        return F.transform(merged, lambda x: F.struct(x["recipe_name"].alias("recipe_name"),
                                                      x["recipe_steps"].alias("recipe_steps")))

    parsed = let(by_name, dedupe)
    empty = F.array().cast(RECIPE_TYPE)
    return F.when(c.isNull() | (c == "") | (c == D.NOT_AVAILABLE), empty).otherwise(parsed)


def _row(category: str, tmpl: tuple[str, str, str], fields: dict) -> Column:
    instr, inp, out = tmpl
    return F.struct(F.lit(category).alias("category"), render(instr, fields).alias("instruction"),
                    render(inp, fields).alias("input"), render(out, fields).alias("output"))


def _fields() -> dict:
    gf = F.col("gluten_free") == D.GLUTEN_YES
    return {
        "gf_word": F.when(gf, F.lit(D.GLUTEN_WORDS[0])).otherwise(F.lit(D.GLUTEN_WORDS[1])),
        "gf_suit": F.when(gf, F.lit(D.GLUTEN_SUIT[0])).otherwise(F.lit(D.GLUTEN_SUIT[1])),
    }


def recipe_rows(recipes: Column, fields: dict) -> Column:
    """GEN9: two rows per parsed recipe, then three aggregate rows (AGG5) when any parsed."""
    parsed = parse_recipes(recipes)

    def item_fields(r):
        return {**fields, "recipe_name": r["recipe_name"], "recipe_steps": r["recipe_steps"]}

    per_item = F.flatten(F.transform(parsed, lambda r: F.array(
        *[_row("recipe", t, item_fields(r)) for t in D.RECIPE_PER_ITEM])))
    all_recipes = F.array_join(F.transform(parsed, lambda r: render(D.RECIPE_ITEM_JOIN[0], item_fields(r))),
                               D.RECIPE_ITEM_JOIN[1])
    agg_fields = {**fields, "all_recipes": all_recipes}
    aggregate = F.when(F.size(parsed) > 0, F.array(*[_row("recipe", t, agg_fields) for t in D.RECIPE_AGGREGATE]))\
        .otherwise(F.array().cast(ROW_TYPE))
    return F.concat(per_item, aggregate)


def entity_rows(templates=D.CATEGORY_TEMPLATES, gated=D.GATED_CATEGORY) -> Column:
    """GEN11: all rows of one (safe) entity, in category then template order."""
    fields = _fields()
    arrays = []
    for category, tmpls in templates:
        if category == "recipe":
            arrays.append(recipe_rows(F.col("recipes"), fields))
            continue
        arr = F.array(*[_row(category, t, fields) for t in tmpls])
        if gated and category == gated[0]:
            arr = F.when(F.col(gated[1]) != D.NOT_AVAILABLE, arr).otherwise(F.array().cast(ROW_TYPE))
        arrays.append(arr)
    return F.concat(*arrays)


def entity_row_count(recipes: Column, gate: Column, templates=D.CATEGORY_TEMPLATES, gated=D.GATED_CATEGORY) -> Column:
    """How many rows ``entity_rows`` gives, without rendering any."""
    parsed = F.size(parse_recipes(recipes))
    n = parsed * len(D.RECIPE_PER_ITEM) + F.when(parsed > 0, len(D.RECIPE_AGGREGATE)).otherwise(0)
    for category, tmpls in templates:
        if category == "recipe":
            continue
        if gated and category == gated[0]:
            n = n + F.when(gate != D.NOT_AVAILABLE, len(tmpls)).otherwise(0)
        else:
            n = n + len(tmpls)
    return n


def entity_meta() -> Column:
    """PRJ4: meta attached to every generated row."""
    return F.create_map(F.lit("millet_id"), F.col("millet_id"), F.lit("millet_name"), F.col("millet_name"),
                        F.lit("source"), F.col("source_url"))


#: Entities that one task turns into texts (each gives about 50 records, and those some 300 rows when augmented).
ENTITIES_A_TASK = 2000


def _dealt(df: DataFrame, key: str, entities: int) -> DataFrame:
    """``df`` dealt by ``key`` to as many tasks as ``entities`` call for: the bytes of an entity do not tell the work on it."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-entities // ENTITIES_A_TASK)), key)


def positioned_entities(ent: DataFrame, order_by: Sequence) -> DataFrame:
    """Safe entity values plus ``entity_pos`` (WIN1) over ``order_by``."""
    placed = stored(with_position(stored(ent, "entities"), order_by, "entity_pos"), "placed-entities")
    return safe_entities(_dealt(placed, "entity_pos", placed.count()), keep=["entity_pos"])


def generate_entity_instructions(safe: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """GEN1-9, GEN11 with PRJ4: ``entity_pos, item, category, instruction, input, output, meta`` (and ``keep``)."""
    return safe.select("entity_pos", *keep, entity_meta().alias("meta"),
                       F.posexplode(entity_rows()).alias("item", "r")).select(
        "entity_pos", *keep, "item", "r.category", "r.instruction", "r.input", "r.output", "meta")


def generate_comparisons(safe: DataFrame, offsets: Sequence[int] = D.NEIGHBOR_OFFSETS) -> DataFrame:
    """JOIN1 + GEN10 + PRJ5: each entity with its next ``offsets`` entities by position.

    A bounded self-join expressed as an equi-join on ``entity_pos + off``;
    N entities give ``sum(max(0, N - off))`` pairs, 3 rows each. Both sides are dealt by position and merged: a plan by the
    size of the stored file would send all entities to the driver, as their compressed names look small.
    """
    keep = {"millet_name": "name", "nutritional_profile": "nutr", "drought_tolerance": "drought",
            "market_price_retail_inr_per_kg": "price", "millet_id": "id", "source_url": "source"}
    left = safe.select(F.col("entity_pos"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("off"),
                       *[F.col(c).alias(a + "1") for c, a in keep.items()])
    left = left.withColumn("right_pos", F.col("entity_pos") + F.col("off"))
    right = safe.select(F.col("entity_pos").alias("right_pos"), *[F.col(c).alias(a + "2") for c, a in keep.items()])
    n = safe.select("entity_pos").count()
    pairs = _dealt(left, "right_pos", n).join(_dealt(right, "right_pos", n).hint("merge"), "right_pos")
    fields = {}
    meta_id, meta_name, meta_source = (render(t, fields) for t in D.COMPARISON_META)
    rows = F.array(*[F.struct(F.lit("comparison").alias("category"), render(i, fields).alias("instruction"),
                              render(n, fields).alias("input"), render(o, fields).alias("output"))
                     for i, n, o in D.COMPARISON_TEMPLATES])
    meta = F.create_map(F.lit("millet_id"), meta_id, F.lit("millet_name"), meta_name, F.lit("source"), meta_source)
    n_t = len(D.COMPARISON_TEMPLATES)
    return (pairs.select("entity_pos", "off", meta.alias("meta"), F.posexplode(rows).alias("t", "r"))
            .select("entity_pos", ((F.col("off") - 1) * n_t + F.col("t")).alias("item"), "r.category",
                    "r.instruction", "r.input", "r.output", "meta"))


def build_instruction_set(ent: DataFrame, order_by: Sequence) -> DataFrame:
    """JOB1: entity rows, then comparison rows (``part`` 0 / 1 keeps the order)."""
    safe = positioned_entities(ent, order_by)
    a = generate_entity_instructions(safe).withColumn("part", F.lit(0))
    b = generate_comparisons(safe).withColumn("part", F.lit(1))
    return a.unionByName(b)


def positioned_instruction_set(ent: DataFrame, order_by: Sequence) -> DataFrame:
    """JOB1 rows with ``rec_pos``, their place in the order of part, entity, item (the file order).

    Positions are arithmetic: an entity's row count is known before its text, so only entities are numbered, and
    a row's place is where its entity starts plus its item. Texts are neither sorted nor shuffled for it.
    """
    count = entity_row_count(safe_get(F.col("recipes")), safe_get(F.col(D.GATED_CATEGORY[1])))
    placed = stored(with_position(stored(ent, "entities"), order_by, "entity_pos", start=("_start", count)), "placed-entities")
    n, first_part = placed.agg(F.count(F.lit(1)), F.max(F.col("_start") + count)).first()
    safe = safe_entities(_dealt(placed, "entity_pos", n), keep=["entity_pos", "_start"])
    each, most, e = len(D.COMPARISON_TEMPLATES), len(D.NEIGHBOR_OFFSETS), F.col("entity_pos")
    # pairs that entities near the end lack for want of neighbours, summed over all entities before
    lack = most - n + 1
    late = F.greatest(e + min(lack, 0), F.lit(0))
    missing = (late * (late - 1) / 2 + late * max(lack, 0)).cast("long")
    rows = generate_entity_instructions(safe, keep=["_start"]).withColumn("rec_pos", F.col("_start") + F.col("item")).drop("_start")
    pairs = generate_comparisons(safe).withColumn("rec_pos", (first_part or 0) + (e * most - missing) * each + F.col("item"))
    return rows.withColumn("part", F.lit(0)).unionByName(pairs.withColumn("part", F.lit(1)))


def flatten_meta(df: DataFrame, keys=("millet_id", "millet_name", "source")) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "meta"],
                     *[F.element_at(F.col("meta"), F.lit(k)).alias(f"meta_{k}") for k in keys])


def per_entity_counts(instr: DataFrame) -> DataFrame:
    """AGG2: instructions per ``meta.millet_name`` (comparisons count under ``A vs B``)."""
    name = F.element_at(F.col("meta"), F.lit("millet_name"))
    return (instr.where(F.map_contains_key(F.col("meta"), "millet_name"))
            .groupBy(name.alias("millet_name")).agg(F.count(F.lit(1)).alias("n_instructions"))
            .orderBy("millet_name"))


def average_per_entity(instr: DataFrame) -> DataFrame:
    """AGG3: total rows / distinct names (1 decimal), one pass."""
    name = F.element_at(F.col("meta"), F.lit("millet_name"))
    return instr.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(name).alias("distinct_names")).select(
        "total", "distinct_names",
        F.round(F.col("total") / F.col("distinct_names"), 1).alias("avg_per_name"))
