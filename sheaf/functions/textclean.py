"""Response text rules (TXT1-25) as native Column expressions.

Each function is an ordered fold of ``regexp_replace`` passes compiled from
the rule tables in ``sheaf.rules.defaults`` (see ``sheaf.rules.dialect`` for
the Python -> Java regex contract).  Passes are never merged into one
alternation: later passes see the output of earlier ones.

Column functions here are pure.  ``sheaf.operators.postprocess`` applies
them as DataFrame stages so a stage output that later steps read several
times is computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import capitalize_initial, col_or_lit, contains_any, lstrip_chars, ustrip
from sheaf.rules import defaults as D
from sheaf.rules.dialect import escape, fold, java_pattern, literal_replacement, matches, sub


# --------------------------------------------------------------------------- TXT1-14
def cut_at_markers(c, markers: Sequence[str] = D.CUTOFF_MARKERS) -> Column:
    """TXT1: for each marker in order, keep the text before its first occurrence, then strip."""
    c = col_or_lit(c)
    for m in markers:
        c = F.when(F.instr(c, m) > 0, ustrip(F.substring_index(c, m, 1))).otherwise(c)
    return c


def clean_asterisks(c) -> Column:
    """TXT2."""
    return fold(col_or_lit(c), D.ASTERISK_RULES)


def strip_prefixes(c) -> Column:
    """TXT3."""
    return fold(col_or_lit(c), D.PREFIX_RULES)


def normalize_bullets(c) -> Column:
    """TXT4."""
    return fold(col_or_lit(c), D.BULLET_RULES)


def drop_contradictions(c) -> Column:
    """TXT5."""
    return fold(col_or_lit(c), D.CONTRADICTION_RULES)


def drop_training_artifacts(c) -> Column:
    """TXT6 (IGNORECASE | DOTALL)."""
    return fold(col_or_lit(c), D.TRAINING_ARTIFACTS, D.TRAINING_ARTIFACT_FLAGS)


def drop_trailing_phrases(c) -> Column:
    """TXT7."""
    return fold(col_or_lit(c), D.TRAILING_PHRASES, D.TRAILING_FLAGS)


def tidy_spacing(c) -> Column:
    """TXT8: spaces, space after newline, 3+ newlines, strip."""
    return ustrip(fold(col_or_lit(c), D.SPACING_RULES))


def markdown_bullets(c) -> Column:
    """TXT9."""
    return fold(col_or_lit(c), D.MARKDOWN_BULLET_RULES)


def conclusion_rules() -> list[tuple[str, str, str]]:
    rules = []
    special, special_pat, special_repl = D.CONCLUSION_SPECIAL
    generic_pat, generic_repl = D.CONCLUSION_GENERIC
    for starter in D.CONCLUSION_STARTERS:
        if starter == special:
            rules.append((special_pat, special_repl, ""))
        else:
            rules.append((generic_pat.replace("{escaped}", escape(starter)), generic_repl, ""))
    return rules


def break_conclusions(c) -> Column:
    """TXT10: paragraph break before each conclusion starter that follows text."""
    return fold(col_or_lit(c), conclusion_rules())


def break_steps(c) -> Column:
    """TXT11 + TXT12."""
    return fold(col_or_lit(c), D.STEP_RULES)


def section_breaks(c) -> Column:
    """TXT13 (negative look-behind for a newline)."""
    return fold(col_or_lit(c), D.SECTION_RULES)


def collapse_newlines(c) -> Column:
    """TXT14."""
    return fold(col_or_lit(c), D.FINAL_NEWLINE_RULES)


def clean_response(c) -> Column:
    """TXT15: the first clean-up stage, TXT1 -> TXT14 on the stripped text."""
    c = ustrip(col_or_lit(c))
    for step in (cut_at_markers, clean_asterisks, strip_prefixes, normalize_bullets, drop_contradictions,
                 drop_training_artifacts, drop_trailing_phrases, tidy_spacing, markdown_bullets,
                 break_conclusions, break_steps, section_breaks, collapse_newlines):
        c = step(c)
    return c


# --------------------------------------------------------------------------- TXT16-22
def clean_leakage(c) -> Column:
    """TXT16: 65 removal passes, tidy-up, strip, FLT5 short-text fallback."""
    out = ustrip(fold(fold(col_or_lit(c), D.LEAKAGE_PATTERNS, D.LEAKAGE_FLAGS), D.LEAKAGE_TIDY_RULES))
    return short_text_guard(out)


def short_text_guard(c, limit: int = D.SHORT_TEXT_LIMIT, fallback: str = D.SHORT_TEXT_FALLBACK) -> Column:
    """FLT5."""
    c = col_or_lit(c)
    return F.when(F.length(c) < limit, F.lit(fallback)).otherwise(c)


def correct_species(c) -> Column:
    """TXT17: regex -> fixed sentence rewrites (replacement inserted literally)."""
    c = col_or_lit(c)
    for pattern, sentence in D.SPECIES_CORRECTIONS:
        c = F.regexp_replace(c, java_pattern(pattern, D.SPECIES_FLAGS), literal_replacement(sentence))
    return c


def fix_ocr(c) -> Column:
    """TXT18."""
    return fold(col_or_lit(c), D.OCR_RULES)


def _subject_pairs():
    for subject, wrongs in D.SUBJECT_CONFUSIONS:
        for wrong in wrongs:
            yield subject, wrong


def validate_subject(response, question, response_lower=None, question_lower=None) -> Column:
    """TXT19: question names a subject and the answer a dish of a confused one -> apology.

    First (subject, wrong) pair in table order wins; the title-cased subject
    is a constant per rule, computed when the plan is built.
    """
    r, q = col_or_lit(response), col_or_lit(question)
    rl = col_or_lit(response_lower) if response_lower is not None else F.lower(r)
    ql = col_or_lit(question_lower) if question_lower is not None else F.lower(q)
    out = None
    for subject, wrong in _subject_pairs():
        cond = (F.instr(ql, subject) > 0) & contains_any(rl, [wrong + s for s in D.SUBJECT_DISH_SUFFIXES])
        text = F.lit(D.SUBJECT_APOLOGY.format(title=subject.title()))
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(r)


def leads_with_wrong(response, question, response_lower=None, question_lower=None) -> Column:
    """TXT20 (re-aimed from a printed warning): a confused subject within the first 100 characters."""
    rl = col_or_lit(response_lower) if response_lower is not None else F.lower(col_or_lit(response))
    rl = F.substring(rl, 1, D.SUBJECT_LEAD_CHARS)
    ql = col_or_lit(question_lower) if question_lower is not None else F.lower(col_or_lit(question))
    out = F.lit(False)
    for subject, wrong in _subject_pairs():
        out = out | ((F.instr(ql, subject) > 0) & (F.instr(rl, wrong) > 0))
    return out


def filter_off_topic(response, question) -> Column:
    """TXT21: sentence removal by question topic (CLS6), then whitespace flattening for every row."""
    r, ql = col_or_lit(response), F.lower(col_or_lit(question))
    cooking = contains_any(ql, D.COOKING_KEYWORDS)
    nutrition = contains_any(ql, D.NUTRITION_KEYWORDS)
    r = F.when(cooking, fold(r, D.FARMING_PATTERNS, D.TOPIC_FILTER_FLAGS)).otherwise(r)
    r = F.when(nutrition, fold(r, D.OFF_TOPIC_NUTRITION_PATTERNS, D.TOPIC_FILTER_FLAGS)).otherwise(r)
    return ustrip(fold(r, D.TOPIC_TIDY_RULES))


def add_source_citation(c) -> Column:
    """TXT22: identity hook."""
    return col_or_lit(c)


# --------------------------------------------------------------------------- TXT23-24
def answer_split_index(response, response_lower=None) -> Column:
    """0-based index of the first marker (in table order) whose first occurrence is past 50, else null."""
    rl = col_or_lit(response_lower) if response_lower is not None else F.lower(col_or_lit(response))
    cands = [F.when(F.instr(rl, m.lower()) - 1 > D.MIN_THINKING_CHARS, F.instr(rl, m.lower()) - 1)
             for m in D.ANSWER_MARKERS]
    return F.coalesce(*cands)


def strip_transition(answer) -> Column:
    """TXT24: first matching start-anchored transition removed, then strip and re-capitalise."""
    a = col_or_lit(answer)
    out = None
    for p in D.TRANSITION_PATTERNS:
        cond = matches(a, p, D.TRANSITION_FLAGS)
        fixed = capitalize_initial(ustrip(sub(a, p, "", D.TRANSITION_FLAGS)))
        out = F.when(cond, fixed) if out is None else out.when(cond, fixed)
    return out.otherwise(a)


def tidy_answer(c) -> Column:
    """Underscore clean-up, then all asterisks, double spaces, strip."""
    return ustrip(fold(fold(col_or_lit(c), D.ANSWER_TIDY_RULES), D.ANSWER_FINAL_RULES))


def tidy_thinking(c) -> Column:
    c = col_or_lit(c)
    return F.when(c.isNotNull() & (c != ""), fold(c, D.THINKING_TIDY_RULES)).otherwise(c)


# --------------------------------------------------------------------------- TXT25
def parse_citations(text) -> Column:
    """TXT25 / GEN16: ``struct(main, citations)`` from a ``---`` tail section."""
    t = col_or_lit(text)
    has = F.instr(t, D.CITATION_SPLIT) > 0
    main = F.when(has, ustrip(F.substring_index(t, D.CITATION_SPLIT, 1))).otherwise(ustrip(t))
    tail = ustrip(F.substring_index(t, D.CITATION_SPLIT, -1))
    lines = F.transform(F.split(tail, "\n", -1), lambda l: ustrip(l))
    bullets = F.filter(lines, lambda l: l.startswith(D.CITATION_BULLETS[0]) | l.startswith(D.CITATION_BULLETS[1]))
    cleaned = F.filter(F.transform(bullets, lambda l: ustrip(lstrip_chars(l, D.CITATION_LSTRIP))),
                       lambda l: l != "")
    default = F.array(F.lit(D.CITATION_DEFAULT))
    cites = F.when(has & (F.size(cleaned) > 0), F.slice(cleaned, 1, D.CITATION_KEEP)).otherwise(default)
    return F.struct(main.alias("main"), cites.alias("citations"))
