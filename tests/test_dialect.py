import re

import pytest

from conftest import column_values
from sheaf.rules import defaults as D
from sheaf.rules.dialect import fold, java_pattern, java_replacement, required_literals


def py_fold(text, rules, flags=None):
    for rule in rules:
        if isinstance(rule, str):
            p, r, f = rule, "", flags or ""
        else:
            p, r, *rest = rule
            f = rest[0] if rest else (flags or "")
        fl = (re.I if "i" in f else 0) | (re.M if "m" in f else 0) | (re.S if "s" in f else 0)
        text = re.sub(p, r, text, flags=fl)
    return text


EDGE = [
    "", "   ", "\u00a0\tpadded\u00a0", "A\r\nB\r\nC", "é*x **bold** *it* a** : b*:", "line\n* star\n- dash\n",
    "Price is $5 and C:\\path", "Recipe 1: Jowar Roti: Ingredients: x Steps: y", "Ingredients: at start",
    "So, if you Therefore, go. High Now here. 1. one 2. two + three",
    "Please provide your response now\n```python\nx\n``` (Note: a) end. Feel free to ask more!  \n",
    "Thanks are due to scientists at X. FOREWORD text. foreword more. (ISBN: 12) www.balajiscan.in ok",
    "Café Ünïcode ß ÉLAN élan", "•a •  b • c", "x\n\n\n\ny   z \n  w",
]

GROUPS = [
    (D.ASTERISK_RULES, None), (D.PREFIX_RULES, None), (D.BULLET_RULES, None), (D.CONTRADICTION_RULES, None),
    (D.TRAINING_ARTIFACTS, D.TRAINING_ARTIFACT_FLAGS), (D.TRAILING_PHRASES, D.TRAILING_FLAGS),
    (D.SPACING_RULES, None), (D.MARKDOWN_BULLET_RULES, None), (D.STEP_RULES, None), (D.SECTION_RULES, None),
    (D.LEAKAGE_PATTERNS, D.LEAKAGE_FLAGS), (D.LEAKAGE_TIDY_RULES, None), (D.OCR_RULES, None),
    (D.FARMING_PATTERNS, D.TOPIC_FILTER_FLAGS), (D.OFF_TOPIC_NUTRITION_PATTERNS, D.TOPIC_FILTER_FLAGS),
    (D.ANSWER_TIDY_RULES, None), (D.THINKING_TIDY_RULES, None),
]


@pytest.mark.parametrize("gi", range(len(GROUPS)))
def test_rule_groups_match_python_re(spark, gi):
    rules, flags = GROUPS[gi]
    got = column_values(spark, EDGE, lambda c: fold(c, rules, flags))
    assert got == [py_fold(t, rules, flags) for t in EDGE]


def test_replacement_translation():
    assert java_replacement(r"\1\n\n\2") == "$1\n\n$2"
    assert java_replacement("$5 \\\\") == "\\$5 \\\\"
    assert java_pattern(r"\w+", "i").startswith("(?Udiu)")


def test_dollar_and_backslash_replacements(spark):
    rules = [(r"(a)", r"$\1\\", "")]
    got = column_values(spark, ["xay"], lambda c: fold(c, rules))
    assert got == [re.sub(r"(a)", r"$\1\\", "xay")]


def test_required_literals():
    assert required_literals(r"Thanks are due to scientists[^.]*\.") == ["thanks are due to scientists"]
    assert required_literals(r"[^.]*\b(?:sudan grass|johnson grass)\b[^.]*\.\s*") == ["sudan grass", "johnson grass"]
    assert required_literals(r"Project Co-?ordinator[^.]*\.") == ["project co"]
    assert required_literals(r"^\s+|\s+$") is None
    assert required_literals(r"\*\*[^*]+:\*\*") == ["**"]
