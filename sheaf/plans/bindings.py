"""Bindings of the operators to the given test tables.

The reference's own inputs (an entity CSV and instruction JSONL files) are
not part of the test data, so each input shape is derived by Spark from
the tables, growing with them:

* ``instruction_records``: one record per user turn of ``conversations``;
  output = the assistant turn at ``turn + 1`` (empty when there is none),
  input = the conversation's system turn, meta = ``{millet_name: conv_id,
  source: 'conversations'}``.
* ``entities``: one wide row per ``part`` with the 38 entity columns;
  values come from ``part`` and aggregates of ``lineitem`` (+ supplier
  nation).  Unbound columns are NULL, which exercises the null model.
* ``requests`` / ``generations``: questions and answer texts for routing
  and response clean-up, with rule triggers injected by id so that every
  rule fires at scale and an exact oracle exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.rules import defaults as D

# Corpus rule set for CLS1 over the invented multilingual prose (the default
# vocabulary never occurs in it).  Chosen from substring frequencies.
CORPUS_CATEGORIES = [
    ("nutrition", ["ß", "ü"]),
    ("cultivation", ["ñ", "los"]),
    ("pest_management", ["é", "les"]),
    ("market", ["wh", "ing"]),
    ("recipe", ["tion"]),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# instruction records from conversations
# ---------------------------------------------------------------------------
def instruction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, instruction, input, output, meta`` - one row per user turn.

    Two equi-joins; no window over a conversation, so a conversation holding
    a third of all turns is still spread by (conv_id, turn) hashing, and the
    system-turn side is pre-aggregated to one row per conversation.
    """
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    users = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    answers = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    system = (conv.where(F.col("role") == "system").groupBy("conv_id")
              .agg(F.min_by("text", "turn").alias("input")))
    return (users.join(answers, ["conv_id", "turn"], "left")
            .join(system, "conv_id", "left")
            .select("conv_id", "turn", "instruction",
                    F.coalesce(F.col("input"), F.lit("")).alias("input"),
                    F.coalesce(F.col("output"), F.lit("")).alias("output"),
                    F.create_map(F.lit("millet_name"), F.col("conv_id").cast("string"),
                                 F.lit("source"), F.lit("conversations")).alias("meta")))


RECORD_ORDER = ["conv_id", "turn"]


# ---------------------------------------------------------------------------
# entities from part + lineitem
# ---------------------------------------------------------------------------
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part with the 38 entity columns (strings) plus ``p_partkey``.

    ``lineitem`` is scanned once: it is joined to supplier nations and
    aggregated to (part, flag, nation); both per-part roll-ups read that small
    intermediate (the exchange is reused).  Partial aggregation runs before
    every shuffle, so a hot part key costs one combined row per task.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                                               "p_retailprice")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation is a fixed 25-row dimension: a proven size bound for broadcast.
    supp_nation = supp.join(F.broadcast(nation), supp.s_nationkey == nation.n_nationkey).select(
        "s_suppkey", "n_name")
    fine = (li.join(supp_nation, li.l_suppkey == supp_nation.s_suppkey, "left")
            .groupBy("l_partkey", "l_returnflag", "n_name")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")))
    per_flag = fine.groupBy("l_partkey", "l_returnflag").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    per_part = per_flag.groupBy("l_partkey").agg(
        F.sum("q").alias("qty"),
        F.array_sort(F.collect_list(F.struct("l_returnflag", "n"))).alias("flags"))
    per_nation = fine.groupBy("l_partkey", "n_name").agg(F.sum("n").alias("n"))
    origin = per_nation.groupBy("l_partkey").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("n_name"))).getField("n_name").alias("origin"))

    e = (part.join(per_part, part.p_partkey == per_part.l_partkey, "left").drop("l_partkey")
         .join(origin, part.p_partkey == origin.l_partkey, "left").drop("l_partkey"))
    k = F.col("p_partkey")
    flags = F.coalesce(F.col("flags"), F.array().cast("array<struct<l_returnflag:string,n:bigint>>"))
    pieces = F.transform(flags, lambda s: F.concat(s["l_returnflag"], F.lit(": "), s["n"].cast("string"),
                                                   F.lit(" lines")))
    recipes = F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.concat_ws(
        " | ",
        F.array_join(pieces, " | "),
        F.when(k % 11 == 0, F.concat(F.element_at(flags, 1)["l_returnflag"], F.lit(": repeated entry"))),
        F.when(k % 13 == 0, F.lit("loose note without separator"))))
    protein = F.when(k % 2 == 0, F.lit("12.5")).otherwise(F.lit("11.6"))
    values = {
        "millet_id": k.cast("string"),
        "millet_name": F.concat(F.col("p_name"), F.lit(" "), k.cast("string")),
        "source_url": F.concat(F.lit("part/"), k.cast("string")),
        "nutritional_profile": F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(
            F.lit("Protein: "), protein, F.lit(" g per 100 g\nFibre: "), F.col("p_size").cast("string"),
            F.lit(" g\nType: "), F.col("p_type"))),
        "health_benefits": F.when(k % 5 == 0, F.lit("   ")).otherwise(
            F.concat(F.lit("Supports "), F.lower(F.col("p_type")), F.lit(" diets"))),
        "drought_tolerance": F.when(F.col("p_size") > 30, F.lit("High"))
        .when(F.col("p_size") > 15, F.lit("Medium")).otherwise(F.lit("Low")),
        "common_pests": F.array_join(F.transform(flags, lambda s: s["l_returnflag"]), ", "),
        "market_price_retail_inr_per_kg": F.col("p_retailprice").cast("decimal(12,2)").cast("string"),
        "market_demand": F.when(F.col("qty") >= 900, F.lit("High")).when(F.col("qty") >= 600, F.lit("Medium"))
        .otherwise(F.lit("Low")),
        "recipes": recipes,
        "millet_scientific_name": F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")),
        "millet_description": F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")),
        "origin_region": F.col("origin"),
        "gluten_free": F.when(k % 3 == 0, F.lit("Yes")).when(k % 3 == 1, F.lit("No"))
        .otherwise(F.lit(None).cast("string")),
    }
    cols = [k] + [(values[c] if c in values else F.lit(None).cast("string")).alias(c)
                  for _, c in D.ENTITY_COLUMNS]
    return e.select(*cols)


ENTITY_ORDER = ["p_partkey"]


# ---------------------------------------------------------------------------
# requests
# ---------------------------------------------------------------------------
MODES = [D.MODE_FAST, D.MODE_THINKING, None]
MODEL_TYPES = ["millet", "base", "Base", None]


def pick(values, mod: int, number: Column) -> Column:
    """The value at ``number`` modulo ``mod``, null beyond the list."""
    out = F.lit(None).cast("string")
    for i, v in reversed(list(enumerate(values))):
        out = F.when(number % mod == i, v if isinstance(v, Column) else F.lit(v).cast("string")).otherwise(out)
    return out


def conversation_request_id() -> Column:
    """``c<conversation>-<turn>``: no two turns share one, however long a conversation is."""
    return F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn"))


def _requests(rows: DataFrame) -> DataFrame:
    """Mode, model type and topic by ``number``."""
    topic_ids = [t[0] for t in D.TOPICS]
    n = F.col("number")
    return rows.select("request_id", "message", pick(MODEL_TYPES, 4, n).alias("model_type"), pick(MODES, 3, n).alias("mode"),
                       pick(topic_ids, len(topic_ids), n).alias("context"))


def requests_from(generated: DataFrame, records: DataFrame) -> DataFrame:
    """Chat requests: generated instructions (``g<record position>``) and conversation user turns."""
    gen = generated.select(F.concat(F.lit("g"), F.col("rec_pos")).alias("request_id"), F.col("rec_pos").alias("number"),
                           F.col("instruction").alias("message"))
    return _requests(gen.unionByName(_numbered(records)))


def _numbered(records: DataFrame) -> DataFrame:
    return records.select(conversation_request_id().alias("request_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("number"),
                          F.col("instruction").alias("message"))


def conversation_requests(records: DataFrame) -> DataFrame:
    """Requests from conversation user turns only."""
    return _requests(_numbered(records))


# ---------------------------------------------------------------------------
# generated answers (hand-off from the external text generator)
# ---------------------------------------------------------------------------
# Test fixture values (not from the original project): questions and rule
# triggers injected around document text by doc_id, so every clean-up rule
# fires somewhere while the whole table is processed.
GEN_QUESTIONS = [
    "Give me a jowar recipe to cook today",
    "How much protein and iron is in ragi?",
    "Compare bajra and jowar for diabetes",
    "Which millet should I eat for breakfast?",
    "Tell me about foxtail cultivation",
    "What is the market price trend?",
    "Explain pearl millet nutrition and yield",
]
GEN_INJECTIONS = [
    (D.named("{assistant}: "), " **Key point** is *this* one.\nUser: leaked follow-up"),
    ("Hi! I'm happy to help! ", " • first item • second item\n- dash item\nLet's compare: both sides"),
    ("", " Please provide your response now.\n```python\nprint(1)\n``` (Note: internal note) Feel free to ask more!"),
    ("", " Thanks are due to scientists of the centre. Foreword by the director. (ISBN: 978-1) www.balajiscan.com"),
    ("", " Protein is 12 _g and _7.5 mg per serving. barnyard millet is also known as proso millet. **_protein per **"),
    ("", " So, if you want more. Therefore, it helps. Steps 1. Mix well 2. Cook + salt + water Recipe 2: Jowar Roti: "
         "Ingredients: flour Instructions: knead"),
    (None, "Ok."),
    ("", "\n---\n- Source A\n* Source B\n-   \n- Source C\n- Source D"),
    ("Reasoning first. ", " In conclusion, the answer covers every point raised above in enough detail to be useful here."),
    ("Winner: ", " Based on the comparison: kuttu roti is a good choice. drought tolerance is high in dry zones."),
    ("", " **Bajra:** Drought tolerance is high here. The seed treatment with thiram matters. Farmers use crop rotation."),
    ("", "\n\n\n\n  - \n*\nHigh Now we go  with   spaces"),
]


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, question, mode, raw_response`` from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rid = F.col("doc_id")
    raws = []
    for pre, suf in GEN_INJECTIONS:
        raws.append(F.lit(suf) if pre is None else F.concat(F.lit(pre), F.col("text"), F.lit(suf)))
    return docs.select(rid.alias("request_id"), pick(GEN_QUESTIONS, len(GEN_QUESTIONS), rid).alias("question"),
                       pick(MODES, 3, rid).alias("mode"), pick(raws, len(raws), rid).alias("raw_response"))


# ---------------------------------------------------------------------------
# evaluation items and answers
# ---------------------------------------------------------------------------
def gold_items(records: DataFrame) -> DataFrame:
    """``id, q, a``: conversation records that have an answer."""
    return records.where(F.col("output") != "").select(conversation_request_id().alias("id"), F.col("instruction").alias("q"), F.col("output").alias("a"))


def asked_items(records: DataFrame) -> DataFrame:
    """``id, question, answer`` of a second system: the questions reworded, cut or replaced, the answers cut or turned, by ``conv_id + turn``.

    Fixture values: as asked; half in capitals with other signs; without the first word; with a word before and one after;
    another question altogether.
    """
    k, q, a = F.col("conv_id") + F.col("turn"), F.col("instruction"), F.col("output")
    question = (F.when(k % 5 == 0, q).when(k % 5 == 1, F.concat(F.lit(" ("), F.translate(q, "abcdefghijklm", "ABCDEFGHIJKLM"), F.lit(") ?!")))
                .when(k % 5 == 2, F.regexp_replace(q, "^[^ ]+ ", "")).when(k % 5 == 3, F.concat(F.lit("Please: "), F.regexp_replace(q, "^[^ ]+ ", ""), F.lit(" thanks")))
                .otherwise(F.concat(F.lit("off topic "), conversation_request_id())))
    words = F.split(a, " ")
    half = F.floor(F.size(words) / 2).cast("int")
    turned = F.array_join(F.concat(F.slice(words, half + 1, F.size(words) - half), F.slice(words, F.lit(1), half)), " ")
    answer = F.when(k % 3 == 0, a).when(k % 3 == 1, F.regexp_replace(a, "^[^.]*[.]", "")).otherwise(turned)
    return records.where(k % 7 != 0).select(conversation_request_id().alias("id"), question.alias("question"), answer.alias("answer"))


def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``priority, keyword, label``: every pair of neighbouring words of the documents, lower-cased, ranked by its hash."""
    words = F.split(F.lower("text"), " ")
    last = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), last), F.slice(words, F.lit(2), last), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.explode(pairs).alias("keyword")).where(F.length("keyword") > 4).distinct()
    priority = F.conv(F.substring(F.md5("keyword"), 1, 12), 16, 10).cast("long")
    return rows.select(priority.alias("priority"), "keyword", F.concat(F.lit("L"), priority % 97).alias("label"))
