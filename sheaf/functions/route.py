"""Question classification and routing (CLS2-10) as Column expressions.

Ordered keyword tables become ``when`` chains: Catalyst keeps them inside
whole-stage codegen and stops at the first true branch, which is exactly
the first-match-wins semantics of the rule tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import col_or_lit, contains_any, first_label
from sheaf.rules import defaults as D


def complexity_type(question, triggers=D.COMPLEXITY_TRIGGERS, starters=D.COMPLEX_STARTERS,
                    starter_type=D.COMPLEX_STARTER_TYPE) -> Column:
    """CLS2: first trigger substring (in table order) -> its type; else a starter prefix -> decision type; else null."""
    low = F.lower(col_or_lit(question))
    by_trigger = first_label(low, [(label, [pattern]) for pattern, label in triggers], None)
    starts = F.lit(False)
    for s in starters:
        starts = starts | low.startswith(s)
    return F.coalesce(by_trigger, F.when(starts, F.lit(starter_type)))


def route(question, mode) -> Column:
    """CLS3: ``struct(is_complex, complexity_type)`` with the mode override."""
    mode = col_or_lit(mode)
    auto = complexity_type(question)
    ctype = (F.when(mode == D.MODE_THINKING, F.lit(D.THINKING_TYPE))
             .when(mode == D.MODE_FAST, F.lit(None).cast("string"))
             .otherwise(auto))
    is_complex = (F.when(mode == D.MODE_THINKING, F.lit(True))
                  .when(mode == D.MODE_FAST, F.lit(False))
                  .otherwise(auto.isNotNull()))
    return F.struct(is_complex.alias("is_complex"), ctype.alias("complexity_type"))


def token_budget(mode, is_complex) -> Column:
    """CLS4: request cap by mode, then ``min(cap, 600)`` if complex else ``min(cap, 350)``."""
    mode = col_or_lit(mode)
    cap = F.lit(D.TOKEN_CAP_DEFAULT)
    for m, v in reversed(list(D.TOKEN_CAP_BY_MODE.items())):
        cap = F.when(mode == m, F.lit(v)).otherwise(cap)
    return F.when(col_or_lit(is_complex), F.least(cap, F.lit(D.TOKEN_CAP_COMPLEX)))\
        .otherwise(F.least(cap, F.lit(D.TOKEN_CAP_SIMPLE)))


def is_recipe_question(question) -> Column:
    """CLS5."""
    return contains_any(F.lower(col_or_lit(question)), D.RECIPE_QUESTION_KEYWORDS)


def is_cooking_question(question) -> Column:
    """CLS6 (cooking)."""
    return contains_any(F.lower(col_or_lit(question)), D.COOKING_KEYWORDS)


def is_nutrition_question(question) -> Column:
    """CLS6 (nutrition)."""
    return contains_any(F.lower(col_or_lit(question)), D.NUTRITION_KEYWORDS)


def use_adapter(model_type) -> Column:
    """CLS7: anything but ``base`` (case-insensitive) uses the tuned model; missing -> default."""
    mt = F.coalesce(col_or_lit(model_type), F.lit(D.DEFAULT_MODEL_TYPE))
    return F.lower(mt) != D.BASE_MODEL_TYPE


def confidence_band(score) -> Column:
    """CLS8: strictly greater than 80 -> high, than 50 -> medium, else low."""
    s = col_or_lit(score)
    out = None
    for threshold, label in D.CONFIDENCE_BANDS:
        out = F.when(s > threshold, F.lit(label)) if out is None else out.when(s > threshold, F.lit(label))
    return out.otherwise(F.lit(D.CONFIDENCE_LOW))


def nutrient_share(value, full_mark: float) -> Column:
    """CLS10: value as a share of an axis's full mark."""
    return col_or_lit(value) / F.lit(float(full_mark))
