"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark expressions: the same fixed values
(templates, keyword lists, rule patterns) are rendered into SQL here with
DuckDB's own functions (``replace``, ``instr``, RE2 ``regexp_replace``).
Tables are the pre-registered views named like the parquet files.
"""

from __future__ import annotations

import re

from sheaf.plans import bindings as B
from sheaf.rules import defaults as D

ORACLE: dict[str, str] = {}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def like_any(expr: str, needles) -> str:
    return "(" + " OR ".join(f"instr({expr}, {q(n)}) > 0" for n in needles) + ")"


def case_groups(expr: str, groups, default) -> str:
    parts = [f"WHEN {like_any(expr, needles)} THEN {q(label)}" for label, needles in groups]
    return "CASE " + " ".join(parts) + f" ELSE {q(default) if default is not None else 'NULL'} END"


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


RECORDS_CTE = f"""
records AS (
  SELECT u.conv_id, u.turn, u.text AS instruction,
         coalesce(s.input, '') AS input, coalesce(a.text, '') AS output,
         CAST(u.conv_id AS VARCHAR) AS meta_millet_name
  FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS input FROM conversations WHERE role = 'system'
             GROUP BY conv_id) s ON s.conv_id = u.conv_id
  WHERE u.role = 'user'
),
indexed AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc_index,
         {py_strip('instruction')} AS instruction, {py_strip('input')} AS input,
         {py_strip('output')} AS output, meta_millet_name
  FROM records
),
docs AS (
  SELECT doc_index,
         CASE WHEN input <> '' THEN 'Question: ' || instruction || chr(10) || 'Context: ' || input
                                    || chr(10) || chr(10) || 'Answer: ' || output
              ELSE 'Question: ' || instruction || chr(10) || chr(10) || 'Answer: ' || output END AS page_content,
         meta_millet_name AS millet_name, '' AS millet_id, 'conversations' AS source,
         instruction,
         {case_groups('lower(instruction)', B.CORPUS_CATEGORIES, D.DOC_CATEGORY_DEFAULT)} AS category
  FROM indexed WHERE output <> ''
)"""

ORACLE["entry_category_counts"] = f"""
WITH {RECORDS_CTE}
SELECT category, count(*) AS n_docs FROM docs GROUP BY category ORDER BY category
"""

ORACLE["docs_indexed"] = f"""
WITH {RECORDS_CTE}
SELECT doc_index, page_content, millet_name, millet_id, source, instruction, category FROM docs
"""


# ---------------------------------------------------------------------------
# entities and instruction generation
# ---------------------------------------------------------------------------
def render_sql(template: str, mapping: dict[str, str]) -> str:
    """Nested ``replace`` over the template literal; mapping: placeholder -> SQL expr."""
    expr = q(template)
    for name in dict.fromkeys(re.findall(r"\{([A-Za-z_][A-Za-z0-9_]*)\}", template)):
        expr = f"replace({expr}, {q('{' + name + '}')}, {mapping.get(name, name)})"
    return expr


ENTITY_NAMES = [c for _, c in D.ENTITY_COLUMNS]

ENTITY_CTE = """
sn AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
li AS (SELECT l.l_partkey, l.l_returnflag, l.l_quantity, sn.n_name
       FROM lineitem l LEFT JOIN sn ON l.l_suppkey = sn.s_suppkey),
fc AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM li GROUP BY ALL),
fs AS (SELECT l_partkey,
              string_agg(l_returnflag || ': ' || CAST(n AS VARCHAR) || ' lines', ' | ' ORDER BY l_returnflag) AS pieces,
              string_agg(l_returnflag, ', ' ORDER BY l_returnflag) AS pests,
              min(l_returnflag) AS first_flag
       FROM fc GROUP BY ALL),
qa AS (SELECT l_partkey, sum(l_quantity) AS qty FROM li GROUP BY ALL),
nc AS (SELECT l_partkey, n_name, count(*) AS n FROM li GROUP BY ALL),
orig AS (SELECT l_partkey, n_name AS origin FROM (
           SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, n_name NULLS FIRST) AS rn FROM nc)
         WHERE rn = 1),
ent_raw AS (
  SELECT p.p_partkey,
    CAST(p.p_partkey AS VARCHAR) AS millet_id,
    p.p_name || ' ' || CAST(p.p_partkey AS VARCHAR) AS millet_name,
    'part/' || CAST(p.p_partkey AS VARCHAR) AS source_url,
    CASE WHEN p.p_partkey % 7 = 0 THEN NULL
         ELSE 'Protein: ' || (CASE WHEN p.p_partkey % 2 = 0 THEN '12.5' ELSE '11.6' END) || ' g per 100 g' || chr(10)
              || 'Fibre: ' || CAST(p.p_size AS VARCHAR) || ' g' || chr(10) || 'Type: ' || p.p_type END
      AS nutritional_profile,
    CASE WHEN p.p_partkey % 5 = 0 THEN '   ' ELSE 'Supports ' || lower(p.p_type) || ' diets' END AS health_benefits,
    CASE WHEN p.p_size > 30 THEN 'High' WHEN p.p_size > 15 THEN 'Medium' ELSE 'Low' END AS drought_tolerance,
    coalesce(fs.pests, '') AS common_pests,
    CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS market_price_retail_inr_per_kg,
    CASE WHEN qa.qty >= 900 THEN 'High' WHEN qa.qty >= 600 THEN 'Medium' ELSE 'Low' END AS market_demand,
    CASE WHEN p.p_partkey % 17 = 0 THEN NULL
         ELSE concat_ws(' | ', coalesce(fs.pieces, ''),
                        CASE WHEN p.p_partkey % 11 = 0 THEN fs.first_flag || ': repeated entry' END,
                        CASE WHEN p.p_partkey % 13 = 0 THEN 'loose note without separator' END) END AS recipes,
    p.p_brand || ' ' || p.p_type AS millet_scientific_name,
    p.p_type || ' ' || p.p_name AS millet_description,
    orig.origin AS origin_region,
    CASE p.p_partkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS gluten_free
  FROM part p LEFT JOIN fs ON fs.l_partkey = p.p_partkey LEFT JOIN qa ON qa.l_partkey = p.p_partkey
       LEFT JOIN orig ON orig.l_partkey = p.p_partkey
),
ent AS (
  SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS entity_pos, """ + ",\n         ".join(
    (f"CASE WHEN {py_strip(c)} IS NULL OR {py_strip(c)} = '' THEN {q(D.NOT_AVAILABLE)} ELSE {py_strip(c)} END AS {c}"
     if c in {"millet_id", "millet_name", "source_url", "nutritional_profile", "health_benefits",
              "drought_tolerance", "common_pests", "market_price_retail_inr_per_kg", "market_demand", "recipes",
              "millet_scientific_name", "millet_description", "origin_region", "gluten_free"}
     else f"{q(D.NOT_AVAILABLE)} AS {c}") for c in ENTITY_NAMES) + """
  FROM ent_raw
)"""

# a missing concat_ws argument: DuckDB's concat_ws skips NULLs like Spark's; an
# empty first piece (part without lines) would leave a leading separator in both.

RECIPE_CTE = """
rp AS (
  SELECT entity_pos, unnest(string_split(recipes, '|')) AS piece,
         unnest(range(1, len(string_split(recipes, '|')) + 1)) AS pi
  FROM ent WHERE recipes <> 'Not available'
),
rs AS (
  SELECT entity_pos, pi, """ + py_strip("piece") + """ AS piece FROM rp
),
rk AS (
  SELECT entity_pos, """ + py_strip("split_part(piece, ':', 1)") + """ AS recipe_name,
         """ + py_strip("substr(piece, instr(piece, ':') + 1)") + """ AS recipe_steps, pi
  FROM rs WHERE instr(piece, ':') > 0
),
rd AS (
  SELECT entity_pos, recipe_name, min(pi) AS first_pi, arg_max(recipe_steps, pi) AS recipe_steps
  FROM rk GROUP BY entity_pos, recipe_name
),
recipes_parsed AS (
  SELECT entity_pos, row_number() OVER (PARTITION BY entity_pos ORDER BY first_pi) - 1 AS recipe_pos,
         count(*) OVER (PARTITION BY entity_pos) AS n_recipes, recipe_name, recipe_steps, first_pi
  FROM rd
),
recipe_counts AS (
  SELECT e.entity_pos, coalesce(max(r.n_recipes), 0) AS n_recipes,
         string_agg('**' || r.recipe_name || '**' || chr(10) || r.recipe_steps, chr(10) || chr(10)
                    ORDER BY r.first_pi) AS all_recipes
  FROM ent e LEFT JOIN recipes_parsed r ON r.entity_pos = e.entity_pos GROUP BY e.entity_pos
)"""


def _gen_selects() -> list[str]:
    nutr_n = f"(CASE WHEN e.nutritional_profile <> {q(D.NOT_AVAILABLE)} THEN 6 ELSE 0 END)"
    meta = "e.millet_id AS meta_millet_id, e.millet_name AS meta_millet_name, e.source_url AS meta_source"
    mapping = {c: f"e.{c}" for c in ENTITY_NAMES}
    mapping["gf_word"] = f"(CASE WHEN e.gluten_free = 'Yes' THEN {q(D.GLUTEN_WORDS[0])} ELSE {q(D.GLUTEN_WORDS[1])} END)"
    mapping["gf_suit"] = f"(CASE WHEN e.gluten_free = 'Yes' THEN {q(D.GLUTEN_SUIT[0])} ELSE {q(D.GLUTEN_SUIT[1])} END)"
    selects = []
    offset = "0"
    for category, tmpls in D.CATEGORY_TEMPLATES:
        if category == "recipe":
            rm = dict(mapping, recipe_name="r.recipe_name", recipe_steps="r.recipe_steps")
            for j, (i, n, o) in enumerate(D.RECIPE_PER_ITEM):
                selects.append(
                    f"SELECT e.entity_pos, {offset} + 2 * r.recipe_pos + {j} AS item, 'recipe' AS category, "
                    f"{render_sql(i, rm)} AS instruction, {render_sql(n, rm)} AS input, "
                    f"{render_sql(o, rm)} AS output, {meta} FROM ent e JOIN recipes_parsed r ON r.entity_pos = e.entity_pos")
            am = dict(mapping, all_recipes="c.all_recipes")
            for j, (i, n, o) in enumerate(D.RECIPE_AGGREGATE):
                selects.append(
                    f"SELECT e.entity_pos, {offset} + 2 * c.n_recipes + {j} AS item, 'recipe' AS category, "
                    f"{render_sql(i, am)} AS instruction, {render_sql(n, am)} AS input, "
                    f"{render_sql(o, am)} AS output, {meta} FROM ent e JOIN recipe_counts c ON c.entity_pos = e.entity_pos "
                    f"WHERE c.n_recipes > 0")
            offset = f"({offset} + 2 * c.n_recipes + CASE WHEN c.n_recipes > 0 THEN 3 ELSE 0 END)"
            continue
        gate = f" AND e.nutritional_profile <> {q(D.NOT_AVAILABLE)}" if category == D.GATED_CATEGORY[0] else ""
        for t, (i, n, o) in enumerate(tmpls):
            selects.append(
                f"SELECT e.entity_pos, {offset} + {t} AS item, {q(category)} AS category, "
                f"{render_sql(i, mapping)} AS instruction, {render_sql(n, mapping)} AS input, "
                f"{render_sql(o, mapping)} AS output, {meta} "
                f"FROM ent e JOIN recipe_counts c ON c.entity_pos = e.entity_pos WHERE TRUE{gate}")
        size = len(tmpls)
        offset = f"({offset} + {nutr_n})" if category == D.GATED_CATEGORY[0] else f"({offset} + {size})"
    return selects


GEN_CTE = "gen AS (\n" + "\nUNION ALL\n".join(_gen_selects()) + "\n)"

CMP_CTE = """
cmp AS (
  SELECT a.entity_pos, (o.off - 1) * 3 + t.t AS item, 'comparison' AS category,
    CASE t.t
      WHEN 0 THEN """ + render_sql(D.COMPARISON_TEMPLATES[0][0], {"name1": "a.millet_name", "name2": "b.millet_name"}) + """
      WHEN 1 THEN """ + render_sql(D.COMPARISON_TEMPLATES[1][0], {"name1": "a.millet_name", "name2": "b.millet_name"}) + """
      ELSE """ + render_sql(D.COMPARISON_TEMPLATES[2][0], {"name1": "a.millet_name", "name2": "b.millet_name"}) + """ END
      AS instruction,
    '' AS input,
    CASE t.t
      WHEN 0 THEN """ + render_sql(D.COMPARISON_TEMPLATES[0][2], {"name1": "a.millet_name", "name2": "b.millet_name",
                                                                  "nutr1": "a.nutritional_profile",
                                                                  "nutr2": "b.nutritional_profile"}) + """
      WHEN 1 THEN """ + render_sql(D.COMPARISON_TEMPLATES[1][2], {"name1": "a.millet_name", "name2": "b.millet_name",
                                                                  "drought1": "a.drought_tolerance",
                                                                  "drought2": "b.drought_tolerance"}) + """
      ELSE """ + render_sql(D.COMPARISON_TEMPLATES[2][2], {"name1": "a.millet_name", "name2": "b.millet_name",
                                                           "price1": "a.market_price_retail_inr_per_kg",
                                                           "price2": "b.market_price_retail_inr_per_kg"}) + """ END
      AS output,
    a.millet_id || ',' || b.millet_id AS meta_millet_id,
    a.millet_name || ' vs ' || b.millet_name AS meta_millet_name,
    a.source_url || '; ' || b.source_url AS meta_source
  FROM ent a CROSS JOIN (VALUES (1), (2)) o(off) JOIN ent b ON b.entity_pos = a.entity_pos + o.off
       CROSS JOIN (VALUES (0), (1), (2)) t(t)
)"""

GEN_COLS = "entity_pos, item, category, instruction, input, output, meta_millet_id, meta_millet_name, meta_source"

ORACLE["gen_instructions"] = f"WITH {ENTITY_CTE},\n{RECIPE_CTE},\n{GEN_CTE}\nSELECT {GEN_COLS} FROM gen"
ORACLE["gen_recipes"] = (f"WITH {ENTITY_CTE},\n{RECIPE_CTE}\n"
                         "SELECT entity_pos, recipe_pos, recipe_name, recipe_steps FROM recipes_parsed")
ORACLE["neighbor_comparisons"] = f"WITH {ENTITY_CTE},\n{CMP_CTE}\nSELECT {GEN_COLS} FROM cmp"
INSTR_SET = f"WITH {ENTITY_CTE},\n{RECIPE_CTE},\n{GEN_CTE},\n{CMP_CTE},\nallrows AS (SELECT * FROM gen UNION ALL SELECT * FROM cmp)\n"
ORACLE["instr_per_entity"] = INSTR_SET + (
    "SELECT meta_millet_name AS millet_name, count(*) AS n_instructions FROM allrows GROUP BY 1 ORDER BY 1")
ORACLE["instr_avg"] = INSTR_SET + (
    "SELECT count(*) AS total, count(DISTINCT meta_millet_name) AS distinct_names, "
    "round(count(*) / count(DISTINCT meta_millet_name), 1) AS avg_per_name FROM allrows")


# ---------------------------------------------------------------------------
# augmentation and training sets
# ---------------------------------------------------------------------------
def meta_sql(pairs) -> str:
    """Sorted ``k=v;...`` text from (key, sql value) pairs."""
    return " || ';' || ".join(f"{q(k + '=')} || {v}" for k, v in sorted(pairs))


BASE_META = [("millet_id", "meta_millet_id"), ("millet_name", "meta_millet_name"), ("source", "meta_source")]

RECS_CTE = INSTR_SET.replace("WITH ", "", 1).rstrip() + """,
recs AS (
  SELECT row_number() OVER (ORDER BY part, entity_pos, item) - 1 AS rec_pos, instruction, input, output,
         meta_millet_id, meta_millet_name, meta_source
  FROM (SELECT 0 AS part, * FROM gen UNION ALL SELECT 1 AS part, * FROM cmp)
)"""


def _rephrase_list(fix=False) -> str:
    lists = []
    for gi, (triggers, prefixes, variants) in enumerate(D.REPHRASE_GROUPS):
        base = "instruction"
        for p in prefixes:
            base = f"replace({base}, {q(p)}, '')"
        items = ", ".join(render_sql(v, {"base": base}) for v in variants)
        lists.append(f"(CASE WHEN {like_any('lower(instruction)', triggers)} THEN [{items}] ELSE []::VARCHAR[] END)")
    expr = lists[0]
    for l in lists[1:]:
        expr = f"list_concat({expr}, {l})"
    return f"list_slice({expr}, 1, {D.REPHRASE_KEEP})"


REPH_CTE = f"""
rv AS (SELECT rec_pos, input, output, meta_millet_id, meta_millet_name, meta_source,
              {_rephrase_list()} AS vars FROM recs),
reph AS (
  SELECT 'rephrased' AS origin, rec_pos, CAST(s - 1 AS BIGINT) AS sub, vars[s] AS instruction, input, output,
         {meta_sql(BASE_META + [('augmentation', q('rephrased'))])} AS meta
  FROM rv, range(1, len(vars) + 1) t(s)
)"""

KEY_STRIP = "[" + re.escape(D.FACT_KEY_STRIP) + "]+"
FACTS_CTE = f"""
fl AS (SELECT rec_pos, string_split(output, chr(10)) AS lines FROM recs),
fl2 AS (SELECT rec_pos, i, {py_strip('lines[i]')} AS line FROM fl, range(1, len(lines) + 1) t(i)),
fv AS (SELECT rec_pos, i,
              {py_strip(f"regexp_replace(split_part(line, ':', 1), '^{KEY_STRIP}|{KEY_STRIP}$', '', 'g')")} AS fact_key,
              {py_strip("substr(line, instr(line, ':') + 1)")} AS fact_value
       FROM fl2 WHERE line <> '' AND instr(line, ':') > 0),
facts AS (
  SELECT rec_pos, row_number() OVER (PARTITION BY rec_pos ORDER BY i) - 1 AS fact_pos, fact_key, fact_value
  FROM fv WHERE fact_key <> '' AND fact_value <> '' AND length(fact_value) > 3
  QUALIFY fact_pos < {D.FACT_KEEP}
)"""

QA_CTE = f"""
qa_src AS (
  SELECT f.rec_pos, f.fact_pos, f.fact_key, f.fact_value, r.meta_millet_id, r.meta_millet_name, r.meta_source
  FROM facts f JOIN recs r ON r.rec_pos = f.rec_pos
),
qa_rows AS (
  SELECT 'qa' AS origin, rec_pos, CAST(fact_pos * 2 + k AS BIGINT) AS sub,
    CASE WHEN meta_millet_name <> '' THEN
           CASE k WHEN 0 THEN 'What is the ' || lower(fact_key) || ' for ' || meta_millet_name || '?'
                  ELSE 'Tell me the ' || lower(fact_key) || ' of ' || meta_millet_name END
         ELSE CASE k WHEN 0 THEN 'What is the ' || lower(fact_key) || '?'
                  ELSE 'What about the ' || lower(fact_key) || '?' END END AS instruction,
    '' AS input, fact_value AS output,
    {meta_sql(BASE_META)} AS meta
  FROM qa_src, (VALUES (0), (1)) t(k)
)"""

NEG_VALUES = ", ".join(f"({i}, {q(a)}, {q(b)})" for i, (a, b) in enumerate(D.NEGATIVE_EXAMPLES))
AUG_CTE = f"""
neg AS (SELECT 'negative' AS origin, CAST(-1 AS BIGINT) AS rec_pos, CAST(i AS BIGINT) AS sub, instruction,
               '' AS input, output,
               {meta_sql([(k, q(v)) for k, v in D.NEGATIVE_META.items()])} AS meta
        FROM (VALUES {NEG_VALUES}) t(i, instruction, output)),
orig_rows AS (SELECT 'original' AS origin, rec_pos, CAST(0 AS BIGINT) AS sub, instruction, input, output,
                {meta_sql(BASE_META)} AS meta FROM recs),
aug AS (SELECT * FROM orig_rows UNION ALL SELECT * FROM reph UNION ALL SELECT * FROM qa_rows UNION ALL SELECT * FROM neg)"""

AUG_ALL = f"WITH {RECS_CTE},\n{REPH_CTE},\n{FACTS_CTE},\n{QA_CTE},\n{AUG_CTE}\n"
AUG_COLS = "origin, rec_pos, sub, instruction, input, output, meta"

ORACLE["rephrase"] = f"WITH {RECS_CTE},\n{REPH_CTE}\nSELECT {AUG_COLS} FROM reph"
ORACLE["facts"] = f"WITH {RECS_CTE},\n{FACTS_CTE}\nSELECT rec_pos, fact_pos, fact_key, fact_value FROM facts"
ORACLE["qa_pairs"] = f"WITH {RECS_CTE},\n{FACTS_CTE},\n{QA_CTE}\nSELECT {AUG_COLS} FROM qa_rows"
ORACLE["augment_counts"] = AUG_ALL + """
SELECT count(*) FILTER (WHERE origin = 'original') AS original,
       count(*) FILTER (WHERE origin = 'rephrased') AS rephrased,
       count(*) FILTER (WHERE origin = 'qa') AS qa,
       count(*) FILTER (WHERE origin = 'negative') AS negative,
       count(*) AS total,
       round((count(*) / count(*) FILTER (WHERE origin = 'original') - 1) * 100, 1) AS growth_pct
FROM aug"""
ORACLE["seeded_shuffle"] = AUG_ALL + f"SELECT {AUG_COLS} FROM aug"


def _rejected_sql(instr: str, chosen: str) -> str:
    parts = []
    for needles, text in D.PREFERENCE_RULES:
        if text is None:
            swapped = chosen
            for a, b in D.NUMBER_CORRUPTIONS:
                swapped = f"replace({swapped}, {q(a)}, {q(b)})"
            value = f"CASE WHEN {like_any(chosen, [a for a, _ in D.NUMBER_CORRUPTIONS])} THEN {swapped} END"
        else:
            value = q(text)
        parts.append(f"WHEN {like_any(f'lower({instr})', needles)} THEN {value}")
    return "CASE " + " ".join(parts) + " END"


ORACLE["pref_pairs"] = AUG_ALL + f"""
SELECT prompt, chosen, rejected, origin, rec_pos, sub FROM (
  SELECT instruction AS prompt, output AS chosen, {_rejected_sql('instruction', 'output')} AS rejected,
         origin, rec_pos, sub FROM aug)
WHERE rejected IS NOT NULL AND rejected <> '' AND rejected <> chosen"""

SFT_SQL = f"""
WITH {RECORDS_CTE.split('indexed AS')[0].rstrip().rstrip(',')},
sft AS (SELECT conv_id, turn, {render_sql(D.SFT_TEMPLATE, {'system': q(D.SFT_SYSTEM_PROMPT)})} AS text FROM records)
"""
ORACLE["sft_text"] = SFT_SQL + "SELECT conv_id, turn, text FROM sft"
ORACLE["length_profile"] = SFT_SQL + f"""
, toks AS (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_tokens FROM sft)
SELECT l AS "limit", count(*) AS n_texts, count(*) FILTER (WHERE n_tokens > l) AS n_over,
       max(n_tokens) AS max_tokens, round(avg(n_tokens), 6) AS avg_tokens,
       round(quantile_cont(n_tokens, 0.5), 6) AS p50_tokens, round(quantile_cont(n_tokens, 0.9), 6) AS p90_tokens,
       round(quantile_cont(n_tokens, 0.99), 6) AS p99_tokens,
       round(count(*) FILTER (WHERE n_tokens > l) / count(*), 6) AS share_over
FROM toks, (VALUES {', '.join(f'({x})' for x in D.LENGTH_LIMITS)}) t(l) GROUP BY l"""


# ---------------------------------------------------------------------------
# routing
# ---------------------------------------------------------------------------
def _pick_sql(values, mod, idexpr="request_id"):
    return "CASE " + " ".join(f"WHEN {idexpr} % {mod} = {i} THEN {q(v) if v is not None else 'NULL'}"
                              for i, v in enumerate(values)) + " END"


REQ_CTE = RECS_CTE + """,
""" + RECORDS_CTE.split("indexed AS")[0].strip().rstrip(",") + """,
req0 AS (SELECT 'g' || rec_pos AS request_id, rec_pos AS number, instruction AS message FROM recs
         UNION ALL SELECT 'c' || conv_id || '-' || turn, conv_id * 1000 + turn, instruction FROM records),
req AS (SELECT request_id, message, """ + _pick_sql(B.MODEL_TYPES, 4, "number") + """ AS model_type,
               """ + _pick_sql(B.MODES, 3, "number") + """ AS mode,
               """ + _pick_sql([t[0] for t in D.TOPICS], len(D.TOPICS), "number") + """ AS context FROM req0),
"""


def _complexity_sql(expr="lower(message)"):
    parts = [f"WHEN instr({expr}, {q(p)}) > 0 THEN {q(t)}" for p, t in D.COMPLEXITY_TRIGGERS]
    parts.append("WHEN " + " OR ".join(f"starts_with({expr}, {q(s)})" for s in D.COMPLEX_STARTERS)
                 + f" THEN {q(D.COMPLEX_STARTER_TYPE)}")
    return "CASE " + " ".join(parts) + " END"


ROUTED_CTE = REQ_CTE + f"""
r1 AS (SELECT *, {_complexity_sql()} AS auto_type FROM req WHERE {py_strip('coalesce(message, \'\')')} <> ''),
routed AS (
  SELECT request_id, message, mode, context,
         CASE WHEN mode = 'thinking' THEN TRUE WHEN mode = 'fast' THEN FALSE ELSE auto_type IS NOT NULL END AS is_complex,
         CASE WHEN mode = 'thinking' THEN {q(D.THINKING_TYPE)} WHEN mode = 'fast' THEN NULL ELSE auto_type END
           AS complexity_type,
         CASE WHEN mode = 'thinking' THEN 1000 WHEN mode = 'fast' THEN 350 ELSE 400 END AS cap,
         lower(coalesce(model_type, 'millet')) <> 'base' AS use_adapter,
         {like_any('lower(message)', D.RECIPE_QUESTION_KEYWORDS)} AS is_recipe
  FROM r1
),
routed2 AS (SELECT *, CASE WHEN is_complex THEN least(cap, 600) ELSE least(cap, 350) END AS max_tokens FROM routed)
"""

ORACLE["question_routing"] = "WITH " + ROUTED_CTE + (
    "SELECT request_id, is_complex, complexity_type, max_tokens, use_adapter, is_recipe FROM routed2")
ORACLE["token_budget"] = "WITH " + ROUTED_CTE + (
    "SELECT coalesce(mode, 'auto') AS mode, coalesce(complexity_type, 'simple') AS complexity_type, max_tokens, "
    "count(*) AS n_requests FROM routed2 GROUP BY ALL")
TOPIC_VALUES = ", ".join("(" + ", ".join(q(x) for x in t) + ")" for t in D.TOPICS)
ORACLE["topic_dim"] = "WITH " + REQ_CTE + f"""
topics AS (SELECT * FROM (VALUES {TOPIC_VALUES}) t(topic_id, title, description, helper_text, theme))
SELECT r.request_id, r.context, t.title, t.description, coalesce(t.theme, {q(D.DEFAULT_THEME)}) AS theme,
       {render_sql(D.WELCOME_TEMPLATE, {'context': "coalesce(r.context, '')", 'context_lower': "lower(coalesce(r.context, ''))"})} AS welcome
FROM req r LEFT JOIN topics t ON r.context = t.topic_id"""
ORACLE["confidence_band"] = """
SELECT event_id, value AS score,
       CASE WHEN value > 80 THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END AS band FROM events"""
ORACLE["nutrient_share"] = """
SELECT event_type, count(*) AS n_events, round(avg(value / 150.0), 6) AS avg_share,
       count(*) FILTER (WHERE value > 150) AS n_over_full FROM events GROUP BY event_type"""


# ---------------------------------------------------------------------------
# vectors and retrieval
# ---------------------------------------------------------------------------
def hashed_cte(name: str, source: str, id_col: str, text_col: str, dim: int = 64) -> str:
    """Sparse hashed vector ``(id, bucket, cnt, w)`` with unit-norm weights."""
    return f"""
{name}_tok AS (SELECT {id_col} AS id, unnest(list_filter(string_split_regex(lower({text_col}), '[^\\p{{L}}\\p{{N}}]+'),
                                            lambda t: t <> '')) AS tok FROM {source}),
{name}_cnt AS (SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS bucket, count(*) AS cnt
               FROM {name}_tok GROUP BY ALL),
{name} AS (SELECT id, bucket, cnt, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY id)) AS w FROM {name}_cnt)"""


def ranked_sql(qv: str, cv: str, qsrc: str, qid: str, csrc: str, cid: str, k: int) -> str:
    return f"""
pairs AS (SELECT a.id AS qid, b.id AS cid, sum(a.w * b.w) AS score FROM {qv} a JOIN {cv} b ON a.bucket = b.bucket
          GROUP BY ALL),
allpairs AS (SELECT x.{qid} AS qid, y.{cid} AS cid, coalesce(p.score, 0.0) AS score
             FROM {qsrc} x CROSS JOIN {csrc} y LEFT JOIN pairs p ON p.qid = x.{qid} AND p.cid = y.{cid}),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) AS rank
                          FROM allpairs) WHERE rank <= {k})"""


ORACLE["topk_exact"] = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
s AS (SELECT a.vec_id AS qid, b.vec_id AS cid, list_dot_product(a.v, b.v) AS score FROM n a CROSS JOIN n b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) AS rank FROM s)
SELECT qid, rank, cid, round(score, 6) AS score FROM r WHERE rank <= {D.TOP_K}"""

ORACLE["hashed_vectors"] = "WITH " + hashed_cte("dv", "documents", "doc_id", "text") + """
SELECT id AS doc_id, bucket, cnt, round(w, 6) AS weight FROM dv"""

ORACLE["similar_docs"] = ("WITH " + hashed_cte("qv", "benchmark", "item_id", "text") + ","
                          + hashed_cte("dv", "documents", "doc_id", "text") + ","
                          + ranked_sql("qv", "dv", "benchmark", "item_id", "documents", "doc_id", D.SIMILAR_K) + f"""
SELECT r.qid, r.rank, r.cid, round(r.score, 6) AS score, coalesce(d.source, 'N/A') AS name,
       coalesce(d.lang, 'N/A') AS category, replace(substr(d.text, 1, {D.PREVIEW_CHARS}), chr(10), ' ') AS preview
FROM ranked r JOIN documents d ON d.doc_id = r.cid""")

CONV_REQ = """
creq AS (SELECT 'c' || conv_id || '-' || turn AS request_id, instruction AS message,
                """ + _pick_sql(B.MODEL_TYPES, 4, "(conv_id * 1000 + turn)") + """ AS model_type,
                """ + _pick_sql(B.MODES, 3, "(conv_id * 1000 + turn)") + """ AS mode
         FROM records),
croute AS (SELECT request_id, message, mode, """ + _complexity_sql() + f""" AS auto_type FROM creq
           WHERE {py_strip("coalesce(message, '')")} <> ''),
crouted AS (SELECT request_id, message,
                   CASE WHEN mode = 'thinking' THEN TRUE WHEN mode = 'fast' THEN FALSE ELSE auto_type IS NOT NULL END
                     AS is_complex,
                   CASE WHEN mode = 'thinking' THEN {q(D.THINKING_TYPE)} WHEN mode = 'fast' THEN NULL ELSE auto_type END
                     AS complexity_type,
                   CASE WHEN mode = 'thinking' THEN 1000 WHEN mode = 'fast' THEN 350 ELSE 400 END AS cap
            FROM croute)"""

PROBE_VALUES = ", ".join(f"({i}, {q(x)})" for i, x in enumerate(D.PROBE_QUESTIONS))
ORACLE["kb_probe"] = ("WITH " + RECORDS_CTE + f", probe AS (SELECT * FROM (VALUES {PROBE_VALUES}) t(qid, question)),"
                      + hashed_cte("qv", "probe", "qid", "question") + ","
                      + hashed_cte("dv", "docs", "doc_index", "page_content") + ","
                      + ranked_sql("qv", "dv", "probe", "qid", "docs", "doc_index", D.TOP_K) + f"""
SELECT r.qid, r.rank, r.cid, round(r.score, 6) AS score, coalesce(d.millet_name, 'N/A') AS millet_name,
       coalesce(d.category, 'N/A') AS category, replace(substr(d.page_content, 1, {D.PREVIEW_CHARS}), chr(10), ' ') AS preview
FROM ranked r JOIN docs d ON d.doc_index = r.cid""")

PROMPT_MAP = {"context": "coalesce(c.context, '')", "question": "r.message"}
ORACLE["prompt_assembly"] = ("WITH " + RECORDS_CTE + "," + CONV_REQ + ","
                             + hashed_cte("qv", "crouted", "request_id", "message") + ","
                             + hashed_cte("dv", "docs", "doc_index", "page_content") + ","
                             + ranked_sql("qv", "dv", "crouted", "request_id", "docs", "doc_index", D.TOP_K) + f""",
ctx AS (SELECT k.qid, string_agg('About ' || coalesce(d.millet_name, 'Unknown') || ':' || chr(10) || d.page_content,
                                 chr(10) || chr(10) ORDER BY k.rank) AS context, count(*) AS n_docs
        FROM ranked k JOIN docs d ON d.doc_index = k.cid GROUP BY k.qid),
prompts AS (
  SELECT r.request_id, r.is_complex, r.complexity_type,
         CASE WHEN r.is_complex THEN least(r.cap, 600) ELSE least(r.cap, 350) END AS max_tokens,
         coalesce(c.n_docs, 0) AS n_docs,
         CASE WHEN r.is_complex THEN {render_sql(D.PROMPT_THINKING, PROMPT_MAP)}
              ELSE {render_sql(D.PROMPT_FAST, PROMPT_MAP)} END AS prompt
  FROM crouted r LEFT JOIN ctx c ON c.qid = r.request_id)
SELECT *, length(prompt) AS prompt_chars FROM prompts""")


# ---------------------------------------------------------------------------
# response clean-up: Python regex -> RE2 (DuckDB) translation
# ---------------------------------------------------------------------------
PY_SPACE = r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\p{Z}"
PY_WORD = r"\p{L}\p{N}_"


def re2_pattern(pattern: str, flags: str = "") -> str:
    """Python ``re`` syntax -> RE2 with Python's Unicode ``\\s``/``\\w`` classes."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in "sSwWd":
                cls = {"s": PY_SPACE, "w": PY_WORD, "d": r"\p{Nd}"}.get(nxt.lower())
                if in_class:
                    if nxt.isupper():
                        raise ValueError("negated class inside a class")
                    out.append(cls)
                else:
                    out.append(("[^" if nxt.isupper() else "[") + cls + "]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class and not (out and out[-1] in ("[", "[^")):
            in_class = False
        out.append(ch)
        i += 1
    prefix = "".join(f for f in flags if f in "ism")
    return (f"(?{prefix})" if prefix else "") + "".join(out)


def re2_replacement(repl: str) -> str:
    return repl.replace("\\n", "\n")


def sql_sub(expr: str, pattern: str, repl: str = "", flags: str = "") -> str:
    lookbehind = "(?<!\\n)"
    if pattern.startswith(lookbehind):
        # RE2 has no look-behind: consume the preceding character instead
        pattern = "(^|[^\\n])" + pattern[len(lookbehind):]
        repl = "\\1" + re.sub(r"\\(\d)", lambda m: "\\" + str(int(m.group(1)) + 1), repl)
    return f"regexp_replace({expr}, {q(re2_pattern(pattern, flags))}, {q(re2_replacement(repl))}, 'g')"


def sql_fold(expr: str, rules, flags: str | None = None) -> str:
    for rule in rules:
        if isinstance(rule, str):
            expr = sql_sub(expr, rule, "", flags or "")
        else:
            pattern, repl, *rest = rule
            if "(?=" in pattern:
                continue          # look-ahead pass: absorbed by the following remove-all pass
            expr = sql_sub(expr, pattern, repl, rest[0] if rest else (flags or ""))
    return expr


def py_strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g')"


GENS_CTE = "gens AS (SELECT doc_id AS request_id, " + (
    "CASE " + " ".join(f"WHEN doc_id % {len(B.GEN_QUESTIONS)} = {i} THEN {q(v)}" for i, v in enumerate(B.GEN_QUESTIONS))
    + " END AS question, ") + (
    "CASE " + " ".join(f"WHEN doc_id % 3 = {i} THEN {q(v) if v else 'NULL'}" for i, v in enumerate(B.MODES))
    + " END AS mode, ") + (
    "CASE " + " ".join(
        f"WHEN doc_id % {len(B.GEN_INJECTIONS)} = {i} THEN "
        + (q(suf) if pre is None else f"{q(pre)} || text || {q(suf)}")
        for i, (pre, suf) in enumerate(B.GEN_INJECTIONS)) + " END AS raw_response FROM documents)")


def cutoffs_sql(expr: str) -> str:
    for m in D.CUTOFF_MARKERS:
        expr = f"(CASE WHEN instr({expr}, {q(m)}) > 0 THEN {py_strip_sql(f'split_part({expr}, {q(m)}, 1)')} ELSE {expr} END)"
    return expr


def _conclusion_rules():
    alone, pattern, text = D.CONCLUSION_SPECIAL
    shape, repl = D.CONCLUSION_GENERIC
    return [(pattern, text, "") if word == alone else (shape.replace("{escaped}", re.escape(word)), repl, "")
            for word in D.CONCLUSION_STARTERS]


CLEAN_STAGES = [
    ("c1", lambda x: cutoffs_sql(py_strip_sql(x))),
    ("c2", lambda x: sql_fold(sql_fold(x, D.ASTERISK_RULES), D.PREFIX_RULES)),
    ("c3", lambda x: sql_fold(sql_fold(x, D.BULLET_RULES), D.CONTRADICTION_RULES)),
    ("c4", lambda x: sql_fold(sql_fold(x, D.TRAINING_ARTIFACTS, D.TRAINING_ARTIFACT_FLAGS), D.TRAILING_PHRASES,
                              D.TRAILING_FLAGS)),
    ("c5", lambda x: sql_fold(py_strip_sql(sql_fold(x, D.SPACING_RULES)), D.MARKDOWN_BULLET_RULES)),
    ("c6", lambda x: sql_fold(x, _conclusion_rules())),
    ("c7", lambda x: sql_fold(sql_fold(sql_fold(x, D.STEP_RULES), D.SECTION_RULES), D.FINAL_NEWLINE_RULES)),
]


def staged(source: str, col: str, stages, prefix: str, keep: str = "*") -> tuple[str, str]:
    """CTEs applying SQL stages to ``col``; returns (ctes, last cte name)."""
    ctes, prev = [], source
    for name, fn in stages:
        name = f"{prefix}{name}"
        ctes.append(f"{name} AS (SELECT * REPLACE ({fn(col)} AS {col}) FROM {prev})")
        prev = name
    return ",\n".join(ctes), prev


def leakage_sql(x: str) -> str:
    tidy = py_strip_sql(sql_fold(sql_fold(x, D.LEAKAGE_PATTERNS, D.LEAKAGE_FLAGS), D.LEAKAGE_TIDY_RULES))
    return tidy


def short_guard_sql(x: str) -> str:
    return f"(CASE WHEN length({x}) < {D.SHORT_TEXT_LIMIT} THEN {q(D.SHORT_TEXT_FALLBACK)} ELSE {x} END)"


def species_sql(x: str) -> str:
    for pattern, sentence in D.SPECIES_CORRECTIONS:
        x = f"regexp_replace({x}, {q(re2_pattern(pattern, D.SPECIES_FLAGS))}, {q(sentence)}, 'g')"
    return x


def subject_sql(r: str, qn: str) -> str:
    parts = []
    for subject, wrongs in D.SUBJECT_CONFUSIONS:
        for wrong in wrongs:
            dish = " OR ".join(f"instr(lower({r}), {q(wrong + s)}) > 0" for s in D.SUBJECT_DISH_SUFFIXES)
            parts.append(f"WHEN instr(lower({qn}), {q(subject)}) > 0 AND ({dish}) THEN "
                         f"{q(D.SUBJECT_APOLOGY.format(title=subject.title()))}")
    return "(CASE " + " ".join(parts) + f" ELSE {r} END)"


def leads_sql(r: str, qn: str) -> str:
    parts = []
    for subject, wrongs in D.SUBJECT_CONFUSIONS:
        for wrong in wrongs:
            parts.append(f"(instr(lower({qn}), {q(subject)}) > 0 AND instr(substr(lower({r}), 1, "
                         f"{D.SUBJECT_LEAD_CHARS}), {q(wrong)}) > 0)")
    return "(" + " OR ".join(parts) + ")"


def topic_sql(r: str, qn: str) -> str:
    cook = like_any(f"lower({qn})", D.COOKING_KEYWORDS)
    nutr = like_any(f"lower({qn})", D.NUTRITION_KEYWORDS)
    r = f"(CASE WHEN {cook} THEN {sql_fold(r, D.FARMING_PATTERNS, D.TOPIC_FILTER_FLAGS)} ELSE {r} END)"
    r = f"(CASE WHEN {nutr} THEN {sql_fold(r, D.OFF_TOPIC_NUTRITION_PATTERNS, D.TOPIC_FILTER_FLAGS)} ELSE {r} END)"
    return py_strip_sql(sql_fold(r, D.TOPIC_TIDY_RULES))


def citations_sql(t: str) -> str:
    tail = py_strip_sql(f"string_split({t}, '---')[-1]")
    lines = f"list_transform(string_split({tail}, chr(10)), lambda l: {py_strip_sql('l')})"
    bullets = f"list_filter({lines}, lambda l: starts_with(l, '-') OR starts_with(l, '*'))"
    stripped = py_strip_sql("ltrim(l, " + q(D.CITATION_LSTRIP) + ")")
    cleaned = f"list_filter(list_transform({bullets}, lambda l: {stripped}), lambda l: l <> '')"
    has = f"instr({t}, '---') > 0"
    main = f"(CASE WHEN {has} THEN {py_strip_sql(f'split_part({t}, {q(D.CITATION_SPLIT)}, 1)')} ELSE {py_strip_sql(t)} END)"
    cites = (f"(CASE WHEN {has} AND len({cleaned}) > 0 THEN list_slice({cleaned}, 1, {D.CITATION_KEEP}) "
             f"ELSE [{q(D.CITATION_DEFAULT)}] END)")
    return main, cites


ORACLE["clean_response"] = "WITH " + GENS_CTE + ",\n" + staged("gens", "raw_response", CLEAN_STAGES, "s")[0] + \
    "\nSELECT request_id, raw_response AS cleaned FROM sc7"
ORACLE["clean_leakage"] = f"WITH {GENS_CTE}\nSELECT request_id, {short_guard_sql(leakage_sql('raw_response'))} AS cleaned FROM gens"
ORACLE["fix_ocr_corrections"] = (f"WITH {GENS_CTE}\nSELECT request_id, "
                                 f"{sql_fold(species_sql('raw_response'), D.OCR_RULES)} AS cleaned FROM gens")
ORACLE["subject_validation"] = (f"WITH {GENS_CTE}\nSELECT request_id, {subject_sql('raw_response', 'question')} AS validated, "
                                f"{leads_sql('raw_response', 'question')} AS leads_with_wrong FROM gens")
ORACLE["topic_filter"] = (f"WITH {GENS_CTE}\nSELECT request_id, {like_any('lower(question)', D.COOKING_KEYWORDS)} AS is_cooking, "
                          f"{like_any('lower(question)', D.NUTRITION_KEYWORDS)} AS is_nutrition, "
                          f"{topic_sql('raw_response', 'question')} AS filtered FROM gens")
_main, _cites = citations_sql("raw_response")
ORACLE["citations"] = (f"WITH {GENS_CTE}\nSELECT request_id, {_main} AS main, len({_cites}) AS n_citations, "
                       f"array_to_string({_cites}, ' | ') AS citations_text FROM gens")


def _cap_sql(a: str) -> str:
    f = f"left({a}, 1)"
    return f"(CASE WHEN lower({f}) = {f} AND upper({f}) <> {f} THEN upper({f}) || substr({a}, 2) ELSE {a} END)"


EMPTY = "''"


def transitions_sql(a: str) -> str:
    parts = []
    for p in D.TRANSITION_PATTERNS:
        pat = q(re2_pattern(p, D.TRANSITION_FLAGS))
        parts.append(f"WHEN regexp_matches({a}, {pat}) THEN {_cap_sql(py_strip_sql(f'regexp_replace({a}, {pat}, {EMPTY})'))}")
    return "(CASE " + " ".join(parts) + f" ELSE {a} END)"


def split_index_sql(r: str) -> str:
    cands = [f"CASE WHEN instr(lower({r}), {q(m.lower())}) - 1 > {D.MIN_THINKING_CHARS} "
             f"THEN instr(lower({r}), {q(m.lower())}) - 1 END" for m in D.ANSWER_MARKERS]
    return "coalesce(" + ", ".join(cands) + ")"


_env_main, _env_cites = citations_sql("answer")
ORACLE["response_envelope"] = "WITH " + GENS_CTE + f""",
g1 AS (SELECT *, {_complexity_sql('lower(question)')} AS auto_type FROM gens),
g2 AS (SELECT request_id, question, raw_response,
              CASE WHEN mode = 'thinking' THEN TRUE WHEN mode = 'fast' THEN FALSE ELSE auto_type IS NOT NULL END AS is_complex,
              CASE WHEN mode = 'thinking' THEN {q(D.THINKING_TYPE)} WHEN mode = 'fast' THEN NULL ELSE auto_type END AS ctype
       FROM g1),
g3 AS (SELECT *, CASE WHEN is_complex THEN ctype END AS complexity_type FROM g2),
""" + staged("g3", "raw_response", CLEAN_STAGES, "e")[0] + f""",
p1 AS (SELECT *, {short_guard_sql(leakage_sql('raw_response'))} AS r FROM ec7),
p2 AS (SELECT * REPLACE ({sql_fold(species_sql('r'), D.OCR_RULES)} AS r) FROM p1),
p3 AS (SELECT * REPLACE ({subject_sql('r', 'question')} AS r), {leads_sql('r', 'question')} AS leads_with_wrong FROM p2),
p4 AS (SELECT * REPLACE ({topic_sql('r', 'question')} AS r) FROM p3),
p5 AS (SELECT *, is_complex AND NOT {like_any('lower(question)', D.RECIPE_QUESTION_KEYWORDS)} AS split FROM p4),
p6 AS (SELECT *, CASE WHEN split THEN {split_index_sql('r')} END AS idx FROM p5),
p7 AS (SELECT *, {py_strip_sql('substr(r, idx + 1)')} AS tail FROM p6),
p8 AS (SELECT *, idx IS NOT NULL AND length(tail) > {D.MIN_ANSWER_CHARS} AS ok FROM p7),
p9 AS (SELECT *, CASE WHEN ok THEN {py_strip_sql('substr(r, 1, idx)')} END AS think,
              CASE WHEN ok THEN tail ELSE r END AS ans0 FROM p8),
p10 AS (SELECT *, CASE WHEN split THEN {transitions_sql('ans0')} ELSE ans0 END AS ans FROM p9),
p11 AS (SELECT *, {py_strip_sql(sql_fold(sql_fold('ans', D.ANSWER_TIDY_RULES), D.ANSWER_FINAL_RULES))} AS answer,
               CASE WHEN think IS NOT NULL AND think <> '' THEN {sql_fold('think', D.THINKING_TIDY_RULES)} ELSE think END
                 AS thinking FROM p10)
SELECT request_id, {_env_main} AS response, array_to_string({_env_cites}, ' | ') AS citations_text,
       {D.CONFIDENCE_CONSTANT} AS confidence,
       {q('high' if D.CONFIDENCE_CONSTANT > 80 else 'medium' if D.CONFIDENCE_CONSTANT > 50 else 'low')} AS confidence_band,
       thinking, is_complex, complexity_type, leads_with_wrong
FROM p11"""


# ---------------------------------------------------------------------------
# sources / sinks, streaming, evaluation
# ---------------------------------------------------------------------------
ORACLE["jsonl_roundtrip"] = "WITH " + RECORDS_CTE.split("indexed AS")[0].strip().rstrip(",") + """
SELECT instruction, input, output, meta_millet_name, 'conversations' AS meta_source FROM records"""

ORACLE["jsonl_strict"] = "WITH " + RECORDS_CTE.split("indexed AS")[0].strip().rstrip(",") + """
SELECT instruction, input, output, meta_millet_name FROM records"""

ORACLE["jsonl_two_sources"] = "WITH " + RECORDS_CTE.split("indexed AS")[0].strip().rstrip(",") + """,
both_parts AS (
  SELECT 0 AS part, 'c' || conv_id || '-' || turn AS id, instruction, output FROM records
  UNION ALL SELECT 1, CAST(item_id AS VARCHAR), text, '' FROM benchmark)
SELECT row_number() OVER (ORDER BY part, id) - 1 AS idx, part, id, instruction, output FROM both_parts"""

ORACLE["csv_entities"] = f"""WITH {ENTITY_CTE}
SELECT NULLIF(recipes, '') AS recipes, millet_name, drought_tolerance, millet_id, origin_region, gluten_free FROM ent_raw"""

ORACLE["stream_routing"] = "WITH " + RECORDS_CTE.split("indexed AS")[0].strip().rstrip(",") + "," + CONV_REQ + f""",
cr AS (SELECT request_id, is_complex, complexity_type,
              CASE WHEN is_complex THEN least(cap, 600) ELSE least(cap, 350) END AS max_tokens,
              lower(coalesce(model_type, 'millet')) <> 'base' AS use_adapter,
              {like_any('lower(message)', D.RECIPE_QUESTION_KEYWORDS)} AS is_recipe
       FROM crouted JOIN (SELECT request_id AS rid, model_type FROM creq) m ON m.rid = crouted.request_id)
SELECT * FROM cr"""

ORACLE["stream_clean"] = ORACLE["response_envelope"]

ORACLE["eval_join"] = f"""
WITH a AS (SELECT 'c' || conv_id || '-' || turn AS id, text AS gold FROM conversations WHERE role = 'assistant'),
""" + staged("a", "gold", CLEAN_STAGES, "ev")[0].replace("SELECT * REPLACE (", "SELECT * REPLACE (", 1) + f""",
pr AS (SELECT a.id, a.gold, ev.gold AS prediction FROM a JOIN evc7 ev ON ev.id = a.id),
pt AS (SELECT id, unnest(list_filter(string_split_regex(lower(prediction), '[{PY_SPACE}]+'), lambda t: t <> '')) AS tok FROM pr),
gt AS (SELECT id, unnest(list_filter(string_split_regex(lower(gold), '[{PY_SPACE}]+'), lambda t: t <> '')) AS tok FROM pr),
pc AS (SELECT id, tok, count(*) AS n FROM pt GROUP BY ALL),
gc AS (SELECT id, tok, count(*) AS n FROM gt GROUP BY ALL),
ov AS (SELECT pc.id, sum(least(pc.n, gc.n)) AS overlap FROM pc JOIN gc ON pc.id = gc.id AND pc.tok = gc.tok GROUP BY pc.id),
sz AS (SELECT id, {py_strip_sql('prediction')} = {py_strip_sql('gold')} AS exact_match,
              len(list_filter(string_split_regex(prediction, '[{PY_SPACE}]+'), lambda t: t <> '')) AS n_pred,
              len(list_filter(string_split_regex(gold, '[{PY_SPACE}]+'), lambda t: t <> '')) AS n_gold FROM pr)
SELECT sz.id, exact_match, n_pred, n_gold, coalesce(ov.overlap, 0) AS overlap,
       round(CASE WHEN n_pred + n_gold = 0 THEN 1.0 ELSE 2.0 * coalesce(ov.overlap, 0) / (n_pred + n_gold) END, 6) AS f1
FROM sz LEFT JOIN ov ON ov.id = sz.id"""

# the words of a text as the tokenizer of the library cuts them
def _word_list(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


ORACLE["qa_eval"] = "WITH RECURSIVE " + RECORDS_CTE.split("indexed AS")[0].strip().rstrip(",") + f""",
gold AS (SELECT 'c' || conv_id || '-' || turn AS id, instruction AS q, output AS a FROM records WHERE output <> ''),
base AS (SELECT 'c' || conv_id || '-' || turn AS id, conv_id + turn AS k, instruction AS q, output AS a,
                string_split(output, ' ') AS w, len(string_split(output, ' ')) // 2 AS half FROM records),
asked AS (
  SELECT id, CASE k % 5 WHEN 0 THEN q WHEN 1 THEN ' (' || translate(q, 'abcdefghijklm', 'ABCDEFGHIJKLM') || ') ?!' WHEN 2 THEN regexp_replace(q, '^[^ ]+ ', '')
                        WHEN 3 THEN 'Please: ' || regexp_replace(q, '^[^ ]+ ', '') || ' thanks' ELSE 'off topic ' || id END AS q,
         CASE k % 3 WHEN 0 THEN a WHEN 1 THEN regexp_replace(a, '^[^.]*[.]', '') ELSE array_to_string(list_concat(w[half + 1:], w[:half]), ' ') END AS a
  FROM base WHERE k % 7 <> 0),
gw AS (SELECT *, {_word_list('q')} AS ws FROM gold),
aw AS (SELECT *, {_word_list('q')} AS ws FROM asked),
ac AS (SELECT DISTINCT ws FROM aw WHERE len(ws) > 0),
gc AS (SELECT ws, min(id) AS id FROM gw WHERE len(ws) > 0 GROUP BY ws),
-- pairs that share enough words, repeats counted, to lie within the allowed edits
an AS (SELECT ws, w, count(*) AS n FROM (SELECT ws, unnest(ws) AS w FROM ac) GROUP BY ALL),
gn AS (SELECT ws, w, count(*) AS n FROM (SELECT ws, unnest(ws) AS w FROM gc) GROUP BY ALL),
share AS (SELECT an.ws AS x, gn.ws AS y, sum(least(an.n, gn.n)) AS common FROM an JOIN gn USING (w) GROUP BY ALL),
close AS (SELECT x, y, greatest(len(x), len(y)) // 5 AS most, list_distinct(list_concat(x, y)) AS names FROM share
          WHERE common >= greatest(len(x), len(y)) - greatest(len(x), len(y)) // 5),
-- each word one byte, so the edit distance of the strings is that of the words (no pair has over 94 different words)
dist AS (SELECT x, y, most, levenshtein(array_to_string(list_transform(x, lambda w: chr(CAST(32 + list_position(names, w) AS INTEGER))), ''),
                                        array_to_string(list_transform(y, lambda w: chr(CAST(32 + list_position(names, w) AS INTEGER))), '')) AS d FROM close),
linked AS (SELECT x, id, d FROM dist JOIN gc ON gc.ws = y WHERE d <= most QUALIFY row_number() OVER (PARTITION BY x ORDER BY d, id) = 1),
met AS (SELECT aw.id AS asked_id, l.id AS gold_id, l.d AS distance, aw.a AS p, g.a AS g FROM aw LEFT JOIN linked l ON l.x = aw.ws LEFT JOIN gold g ON g.id = l.id),
pw AS (SELECT asked_id, {_word_list('p')} AS pl, {_word_list('g')} AS gl FROM met WHERE gold_id IS NOT NULL),
-- longest common subsequence, a word of the answer at a time
cells AS (
  SELECT asked_id, 0 AS i, j, 0 AS l FROM pw, unnest(range(0, len(gl) + 1)) t(j)
  UNION ALL
  SELECT asked_id, i, j, max(best) OVER (PARTITION BY asked_id ORDER BY j) AS l FROM (
    SELECT c.asked_id, c.i + 1 AS i, c.j, greatest(c.l, CASE WHEN c.j > 0 AND pl[c.i + 1] = gl[c.j] THEN 1 + before.l ELSE 0 END) AS best
    FROM cells c JOIN pw ON pw.asked_id = c.asked_id LEFT JOIN cells before ON before.asked_id = c.asked_id AND before.j = c.j - 1
    WHERE c.i < len(pl))),
lcs AS (SELECT pw.asked_id, len(pl) AS n_pred, len(gl) AS n_gold, c.l AS lcs FROM pw JOIN cells c ON c.asked_id = pw.asked_id AND c.i = len(pl) AND c.j = len(gl)),
least_id AS (SELECT ws, min(id) AS id FROM gw WHERE len(ws) > 0 GROUP BY ws)
SELECT met.asked_id, gold_id, CASE WHEN gold_id IS NULL THEN 'unknown' ELSE 'matched' END AS status, CAST(distance AS INTEGER) AS distance,
       {py_strip_sql('p')} = {py_strip_sql('g')} AS exact_match, CAST(n_pred AS INTEGER) AS n_pred, CAST(n_gold AS INTEGER) AS n_gold, CAST(lcs AS INTEGER) AS lcs,
       CASE WHEN n_pred + n_gold = 0 THEN 1.0 ELSE round(2.0 * lcs / (n_pred + n_gold), 6) END AS rouge_l
FROM met LEFT JOIN lcs ON lcs.asked_id = met.asked_id
UNION ALL
SELECT NULL, gw.id, CASE WHEN len(gw.ws) = 0 OR l.id IS NOT NULL THEN 'unanswered' ELSE 'repeated' END, NULL, NULL, NULL, NULL, NULL, NULL
FROM gw LEFT JOIN least_id l ON l.id = gw.id WHERE gw.id NOT IN (SELECT gold_id FROM met WHERE gold_id IS NOT NULL)"""

ORACLE["keyword_labels"] = """
WITH w AS (SELECT string_split(lower(text), ' ') AS ws FROM documents WHERE text IS NOT NULL),
k AS (SELECT DISTINCT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS keyword FROM w),
rules AS (SELECT keyword, CAST('0x' || substr(md5(keyword), 1, 12) AS BIGINT) AS priority FROM k WHERE length(keyword) > 4),
t AS (SELECT DISTINCT lower(text) AS text FROM conversations WHERE text IS NOT NULL),
best AS (SELECT text, arg_min('L' || priority % 97, struct_pack(priority, keyword)) AS label FROM t JOIN rules ON contains(text, keyword) GROUP BY text)
SELECT conv_id, turn, coalesce(label, 'none') AS label FROM conversations c LEFT JOIN best ON best.text = lower(c.text)"""

ORACLE["kb_totals"] = f"""
WITH {RECORDS_CTE}
SELECT CAST(3 * count(*) AS BIGINT) AS indexed, count(*) AS held, 3 AS versions FROM docs"""

ORACLE["kb_from_jsonl"] = "WITH " + RECORDS_CTE.split("indexed AS")[0].strip().rstrip(",") + f""",
lines AS (
  SELECT 0 AS part, conv_id AS a, turn AS b, instruction, input, output, meta_millet_name AS millet_name, '' AS millet_id, 'conversations' AS source FROM records
  UNION ALL
  SELECT 1, item_id, 0, text, '', CASE WHEN item_id % 4 = 0 THEN '' ELSE substr(text, 1, 40) END, 'Unknown', CAST(item_id AS VARCHAR), {q(dict(D.DOC_META_DEFAULTS)['source'])} FROM benchmark),
indexed AS (
  SELECT row_number() OVER (ORDER BY part, a, b) - 1 AS doc_index, {py_strip('instruction')} AS instruction, {py_strip('input')} AS input,
         {py_strip('output')} AS output, millet_name, millet_id, source FROM lines)
SELECT doc_index, 'Question: ' || instruction || chr(10) || CASE WHEN input <> '' THEN 'Context: ' || input || chr(10) ELSE '' END || chr(10) || 'Answer: ' || output AS page_content,
       millet_id, millet_name, source, {case_groups('lower(instruction)', B.CORPUS_CATEGORIES, D.DOC_CATEGORY_DEFAULT)} AS category
FROM indexed WHERE output <> ''"""

ORACLE["collection_upsert"] = """
WITH d AS (SELECT doc_id, lang, substr(text, 1, 80) AS head, doc_id % 7 = 0 AS again FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, CASE WHEN again OR doc_id % 6 <> 0 THEN lang END AS lang,
       CASE WHEN again OR doc_id % 6 = 0 THEN head WHEN doc_id % 3 = 0 THEN 'new: ' || head WHEN doc_id % 5 = 0 THEN 'NOT TAKEN' ELSE head END AS head
FROM d WHERE doc_id % 7 <> 0 OR doc_id % 70 = 0"""

ORACLE["csv_line_breaks"] = f"""WITH {ENTITY_CTE}
SELECT millet_name, 'first "line", of ' || millet_id || chr(10) || 'second' || chr(10) || chr(10) || '"last"' AS millet_description, millet_id,
       NULLIF(nutritional_profile, '') AS nutritional_profile FROM ent_raw"""


def _feistel_sql(n_sql: str) -> str:
    """The network of ``operators.permute`` round by round; the sides are searched in SQL too."""
    from sheaf.operators.permute import PRIME, Permutation

    keys = ", ".join(f"({k}, {k % 2 == 0}, {', '.join(map(str, key))})" for k, key in enumerate(Permutation(4, D.SHUFFLE_SEED).keys))
    best = "struct_pack(above := a * ((n + a - 1) // a) - n, later := -a)"
    return f"""
size AS ({n_sql}),
sides AS (SELECT arg_min(a, {best}) AS a, arg_min((n + a - 1) // a, {best}) AS b
          FROM size, unnest(range(greatest(1, CAST(floor(sqrt(n)) AS BIGINT) // 2 + 1, CAST(floor(sqrt(n)) AS BIGINT) - 199999), CAST(floor(sqrt(n)) AS BIGINT) + 1)) t(a)),
keys(k, on_left, p, q, r, s) AS (VALUES {keys}),
halves AS (
  SELECT x, 0 AS k, x // b AS lft, x % b AS rgt FROM (SELECT unnest(range(0, a * b)) AS x, b FROM sides)
  UNION ALL
  SELECT x, k + 1, CASE WHEN on_left THEN (lft + xor(u, u >> 13)) % a ELSE lft END, CASE WHEN on_left THEN rgt ELSE (rgt + xor(u, u >> 13)) % b END
  FROM (SELECT *, (xor(t, t >> 15) * r + s) % {PRIME} AS u
        FROM (SELECT h.x, h.k, lft, rgt, on_left, r, s, (CASE WHEN on_left THEN rgt ELSE lft END % {PRIME} * p + q) % {PRIME} AS t
              FROM halves h JOIN keys ON keys.k = h.k)), sides),
step AS (SELECT x, lft * b + rgt AS y FROM halves, sides WHERE k = (SELECT count(*) FROM keys)),
ends AS (SELECT x, y, 0 AS k FROM step UNION ALL SELECT e.x, s.y, k + 1 FROM ends e JOIN step s ON s.x = e.y, size WHERE e.y >= n)"""


ORACLE["permuted_orders"] = "WITH RECURSIVE " + _feistel_sql("SELECT greatest(1, count(*)) AS n FROM orders").strip() + """
SELECT o_orderkey, pos, y AS place, pos AS back
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) JOIN ends ON x = pos, size WHERE y < n"""

ORACLE["stream_prompts"] = ORACLE["prompt_assembly"]

ORACLE["length_sketches"] = f"""
WITH c AS (SELECT len(list_filter(string_split_regex(text, '[{PY_SPACE}]+'), lambda t: t <> '')) AS n FROM conversations WHERE text IS NOT NULL),
a AS (SELECT count(*) AS n, round(avg(n), 6) AS mean, max(n) AS most FROM c)
SELECT quantile, a.n, mean, most, TRUE AS rank_kept, TRUE AS names_kept FROM a, (VALUES (CAST(0.5 AS DOUBLE)), (0.9), (0.99)) q(quantile)"""

ORACLE["jsonl_exact_lines"] = ORACLE["json_dataset"] = ORACLE["jsonl_strict"]
ORACLE["pref_pairs_reused"] = f"SELECT prompt, chosen, rejected FROM ({ORACLE['pref_pairs']})"
ORACLE["message_rows"] = f"""
SELECT CAST(request_id AS VARCHAR) AS id, 'ai' AS type, CASE WHEN bad THEN {q(D.ERROR_MESSAGE)} ELSE response END AS content,
       CASE WHEN bad THEN '' ELSE citations_text END AS citations_text, CASE WHEN bad THEN {D.CONFIDENCE_ON_ERROR} ELSE confidence END AS confidence,
       CASE WHEN NOT bad THEN thinking END AS thinking, NOT bad AND coalesce(is_complex, FALSE) AS "isComplex"
FROM (SELECT *, request_id % 5 = 0 AS bad FROM ({ORACLE["response_envelope"]}))"""
ORACLE["qa_first_records"] = f"WITH {RECS_CTE},\n{FACTS_CTE},\n{QA_CTE}\nSELECT {AUG_COLS} FROM qa_rows WHERE rec_pos < 100"
ORACLE["own_encoder"] = """
WITH v AS (SELECT doc_id, [CAST(length(text) AS DOUBLE), length(translate(text, 'ae ', '')), 1.0] AS v FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v)
SELECT doc_id, CAST(place AS INTEGER) AS place, round(v[place + 1] / norm, 6) AS value FROM n, range(0, 3) t(place)"""
