"""Rule folds as DataFrame stages with literal pre-checks.

A regex pass runs only on rows whose current text contains one of the
pass's required literals (``required_literals``); on the other rows the
column is passed through.  Because the stage reads its input column more
than once (pre-check and pass), Catalyst keeps each stage as its own
projection instead of inlining the previous fold, so no expression is
evaluated twice; all stages still fuse into one whole-stage-codegen
pipeline.  Results are identical to the plain folds in
``sheaf.functions.textclean``: a pass without its literal cannot match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import textclean as T
from sheaf.functions.text import contains_any, let, ustrip
from sheaf.rules import defaults as D
from sheaf.rules.dialect import java_pattern, required_literals, sub

_SENTENCE_HEAD, _SENTENCE_TAIL = "[^.]*", "[^.]*\\.\\s*"


def folded(col: Column) -> Column:
    """Lower case for literal pre-checks; the letters that case-insensitive patterns also take for i and s become those."""
    return F.lower(F.translate(col, "\u0130\u0131\u017f", "iis"))


def fold_expr(col: Column, rules, flags: str | None = None, guard: Column | None = None) -> Column:
    """Apply ``rules`` to ``col`` in order, skipping passes that cannot match, as one expression.

    The fold is an ``aggregate`` over the pass indices whose accumulator holds the current text, that text folded once
    for all pre-checks, and the guard; each step evaluates exactly one pass (found by halving). A pass that changes the
    text folds the new one, so every pre-check is made on the text as it is then: exact, and a changed row is not put
    through all later passes. A pass without known literals always runs.
    """
    passes = []
    for rule in rules:
        if isinstance(rule, str):
            pattern, repl, fl = rule, "", flags or ""
        else:
            pattern, repl, *rest = rule
            fl = rest[0] if rest else (flags or "")
        passes.append((pattern, repl, fl, required_literals(pattern)))
    if not passes:
        return col
    init = F.struct(col.alias("t"), folded(col).alias("low"), (guard if guard is not None else F.lit(True)).alias("g"))

    def one(acc, k):
        pattern, repl, fl, lits = passes[k]
        t, low, g = acc["t"], acc["low"], acc["g"]
        done = let(sub(t, pattern, repl, fl), lambda new: F.struct(
            new.alias("t"), F.when(new == t, low).otherwise(folded(new)).alias("low"), g.alias("g")))
        return F.when(g & contains_any(low, lits) if lits else g, done).otherwise(acc)

    def step(acc, i, lo=0, hi=len(passes)):
        if hi - lo == 1:
            return one(acc, lo)
        mid = (lo + hi) // 2
        return F.when(i < mid, step(acc, i, lo, mid)).otherwise(step(acc, i, mid, hi))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(passes) - 1)), init, lambda acc, i: step(acc, i), lambda acc: acc["t"])


def fold_stage(df: DataFrame, col: str, rules, flags: str | None = None, guard: Column | None = None) -> DataFrame:
    """``fold_expr`` as a DataFrame stage (one projection)."""
    return df.withColumn(col, fold_expr(F.col(col), rules, flags, guard))


def cut_stage(df: DataFrame, col: str, markers=D.CUTOFF_MARKERS) -> DataFrame:
    """TXT1 as one stage per marker (the column is read three times per marker)."""
    for m in markers:
        df = df.withColumn(col, F.when(F.instr(F.col(col), m) > 0, ustrip(F.substring_index(F.col(col), m, 1)))
                           .otherwise(F.col(col)))
    return df


def clean_response_stage(df: DataFrame, src: str, out: str) -> DataFrame:
    """TXT15 as stages (same result as ``textclean.clean_response``)."""
    d = cut_stage(df.withColumn(out, ustrip(F.col(src))), out)
    d = d.withColumn(out, T.drop_contradictions(T.normalize_bullets(T.strip_prefixes(T.clean_asterisks(F.col(out))))))
    d = fold_stage(d, out, D.TRAINING_ARTIFACTS, D.TRAINING_ARTIFACT_FLAGS)
    d = fold_stage(d, out, D.TRAILING_PHRASES, D.TRAILING_FLAGS)
    d = d.withColumn(out, T.markdown_bullets(T.tidy_spacing(F.col(out))))
    d = fold_stage(d, out, T.conclusion_rules())
    d = d.withColumn(out, T.break_steps(F.col(out)))
    d = fold_stage(d, out, D.SECTION_RULES)
    return d.withColumn(out, T.collapse_newlines(F.col(out)))


def clean_leakage_stage(df: DataFrame, src: str, out: str) -> DataFrame:
    """TXT16 + FLT5 as stages."""
    d = fold_stage(df.withColumn(out, F.col(src)), out, D.LEAKAGE_PATTERNS, D.LEAKAGE_FLAGS)
    return d.withColumn(out, T.short_text_guard(ustrip(T.fold(F.col(out), D.LEAKAGE_TIDY_RULES))))


def sentence_core(pattern: str) -> str | None:
    """``X`` for a sentence-removal pattern ``[^.]*X[^.]*\\.\\s*`` whose ``X`` cannot match a '.'."""
    if not (pattern.startswith(_SENTENCE_HEAD) and pattern.endswith(_SENTENCE_TAIL)):
        return None
    core = pattern[len(_SENTENCE_HEAD):-len(_SENTENCE_TAIL)]
    if "." in core.replace("[^.]", "") or not core:
        return None
    return core


def sentence_filter_stage(df: DataFrame, col: str, groups) -> DataFrame:
    """Remove whole '.'-terminated segments, in one linear pass, for sentence-shaped rules.

    ``groups`` is ``[(guard Column, [X, ...], flags)]``.  A pass of
    ``[^.]*X[^.]*\\.\\s*`` deletes each segment (text after the previous '.'
    up to and including the next '.') in which ``X`` occurs, together with the
    whitespace after it; segment boundaries do not move when a segment is
    deleted, so consecutive passes of this shape commute and equal one filter
    over the segments.  The regex form backtracks quadratically per sentence;
    this form is linear.
    """
    low, segs, bad = f"_{col}_low", f"_{col}_segs", f"_{col}_bad"
    any_guard = F.lit(False)
    lits, exact = [], True
    for guard, cores, _ in groups:
        any_guard = any_guard | guard
        for core in cores:
            found = required_literals(core)
            if found is None:
                exact = False
            else:
                lits += found
    pre = any_guard & (contains_any(F.col(low), lits) if exact else F.lit(True))
    d = df.withColumn(low, folded(F.col(col)))
    d = d.withColumn(segs, F.when(pre, F.regexp_extract_all(F.col(col), F.lit(java_pattern(r"[^.]*\.|[^.]+\z")), 0)))

    def is_bad(seg):
        hit = F.lit(False)
        for guard, cores, flags in groups:
            g = F.lit(False)
            for core in cores:
                g = g | seg.rlike(java_pattern(core, flags))
            hit = hit | (guard & g)
        return seg.endswith(".") & hit

    d = d.withColumn(bad, F.transform(F.col(segs), is_bad))
    lead_ws = java_pattern(r"^\s+")
    kept = F.transform(F.col(segs), lambda s, i: F.when(F.element_at(F.col(bad), i + 1), F.lit("")).otherwise(
        F.when((i > 0) & F.element_at(F.col(bad), F.greatest(i, F.lit(1))), F.regexp_replace(s, lead_ws, ""))
        .otherwise(s)))
    d = d.withColumn(col, F.when(pre, F.array_join(kept, "")).otherwise(F.col(col)))
    return d.drop(low, segs, bad)


def filter_off_topic_stage(df: DataFrame, src: str, out: str, question: str) -> DataFrame:
    """TXT21 as stages: each topic's passes are guarded by its question flag.

    The leading sentence-shaped passes of both topics (all but the last
    nutrition pass) run as one segment filter; the rest as pre-checked folds.
    """
    ql = F.lower(F.col(question))
    cooking, nutrition = contains_any(ql, D.COOKING_KEYWORDS), contains_any(ql, D.NUTRITION_KEYWORDS)
    groups, rest = [], []
    for guard, patterns in ((cooking, D.FARMING_PATTERNS), (nutrition, D.OFF_TOPIC_NUTRITION_PATTERNS)):
        cores = []
        for p in patterns:
            core = sentence_core(p)
            if core is not None and not rest:
                cores.append(core)
            else:
                rest.append((guard, p))
        groups.append((guard, cores, D.TOPIC_FILTER_FLAGS))
    d = sentence_filter_stage(df.withColumn(out, F.col(src)), out, groups)
    for guard, p in rest:
        d = fold_stage(d, out, [p], D.TOPIC_FILTER_FLAGS, guard=guard)
    return d.withColumn(out, ustrip(T.fold(F.col(out), D.TOPIC_TIDY_RULES)))
