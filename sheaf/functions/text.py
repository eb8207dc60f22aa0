"""Small Column -> Column helpers shared by every operator.

All are built-in Spark expressions (whole-stage codegen friendly); none
calls Python per row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.rules import defaults as D
from sheaf.rules.dialect import java_pattern

# Python's str.strip() removes Unicode whitespace; Spark's trim removes only
# U+0020 by default.  These are the characters of (?U)\s, the Unicode White_Space class.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col_or_lit(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def ustrip(c) -> Column:
    """Python ``str.strip()``."""
    return F.trim(col_or_lit(c).cast("string"), F.lit(WHITE_SPACE))


def strip_chars(c, chars: str) -> Column:
    """Python ``str.strip(chars)``."""
    return F.trim(col_or_lit(c).cast("string"), F.lit(chars))


def lstrip_chars(c, chars: str) -> Column:
    """Python ``str.lstrip(chars)``."""
    return F.regexp_replace(col_or_lit(c), java_pattern("^[" + re.escape(chars) + "]+"), "")


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    An expression referenced inside a higher-order-function lambda is
    re-evaluated on every invocation; binding it first avoids that.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, fn)


def once(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with ``values`` as columns that are computed once a row, however often they are read.

    They come out of a generator, so the optimizer neither writes them out again in each place nor in a filter below.
    """
    each = df.select(*df.columns, F.explode(F.array(F.struct(*(v.alias(n) for n, v in values.items())))).alias("_once"))
    return each.select(*df.columns, *(F.col("_once")[n].alias(n) for n in values))


def long_array(values: Sequence[int]) -> Column:
    """A constant array of longs as one literal text that the optimizer folds (an expression an element is slow to plan)."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<bigint>")


def safe_get(c, default: str = D.NOT_AVAILABLE) -> Column:
    """PRJ1: null, empty or blank -> ``default``; otherwise the stripped string."""
    s = ustrip(col_or_lit(c).cast("string"))
    return F.when(s.isNull() | (s == ""), F.lit(default)).otherwise(s)


def contains_any(c, needles: Sequence[str]) -> Column:
    """Substring test of ``c`` against any literal (``any(k in c for k in needles)``)."""
    c = col_or_lit(c)
    out = F.lit(False)
    for n in needles:
        out = out | (F.instr(c, n) > 0)
    return out


def first_label(c, groups: Sequence[tuple[str, Sequence[str]]], default=None) -> Column:
    """Ordered keyword groups -> the label of the first group with a hit.

    ``groups`` is ``[(label, [substring, ...]), ...]``; the ``when`` chain
    short-circuits in order, which is the first-match-wins semantics of the
    rule tables.  Callers lower-case ``c`` themselves when needed.
    """
    c = col_or_lit(c)
    out = None
    for label, needles in groups:
        cond = contains_any(c, needles)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


_PLACEHOLDER = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def render(template: str, fields: Mapping[str, Column] | None = None) -> Column:
    """Render a ``{name}`` template as ``concat`` of literals and columns.

    Unknown names resolve to columns of the same name.  Null fields make the
    result null, as in SQL; callers pass ``safe_get`` columns.
    """
    fields = fields or {}
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        name = m.group(1)
        parts.append(fields[name] if name in fields else F.col(name))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    if not parts:
        return F.lit("")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def placeholders(template: str) -> list[str]:
    return _PLACEHOLDER.findall(template)


def is_lower_initial(c: Column) -> Column:
    """``s[0].islower()`` for the first character."""
    first = F.substring(c, 1, 1)
    return (F.lower(first) == first) & (F.upper(first) != first)


def capitalize_initial(c: Column) -> Column:
    """Upper-case the first character when it is lower case, keep the rest."""
    first = F.substring(c, 1, 1)
    rest = F.substring(c, 2, (1 << 31) - 1)
    return F.when(is_lower_initial(c), F.concat(F.upper(first), rest)).otherwise(c)
