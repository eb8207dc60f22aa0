"""Python ``re`` rules -> Spark (java.util.regex) expressions.

Rule tables are written in Python regex syntax.  Java regex differs in a
few places that change results on real text:

* ``\\w \\s \\b \\d`` are ASCII in Java unless UNICODE_CHARACTER_CLASS
  (``(?U)``) is on; Python ``str`` patterns are Unicode.
* Case-insensitive matching is ASCII-only without ``(?u)``.
* Under MULTILINE, and for ``.``, Java treats ``\\r``, U+0085, U+2028 and
  U+2029 as line terminators; Python only ``\\n``.  UNIX_LINES (``(?d)``)
  restores the Python behaviour.
* Replacements use ``$1`` rather than ``\\1`` and treat ``$`` and ``\\``
  as special.

Every compiled pattern therefore gets ``(?U d …)`` and every replacement
is rewritten.  Rules stay sequential: a list of rules becomes a fold of
``regexp_replace`` calls, never one alternation, because later rules see
the output of earlier ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLAG_MAP = {"i": "iu", "m": "m", "s": "s", "x": "x"}


def java_pattern(pattern: str, flags: str = "") -> str:
    """Prefix a Python-syntax pattern with Java inline flags of the same meaning."""
    letters = "Ud" + "".join(_FLAG_MAP[f] for f in flags)
    return f"(?{letters}){pattern}"


def java_replacement(repl: str) -> str:
    """Translate a Python ``re.sub`` replacement template to Java syntax.

    ``\\1`` -> ``$1``, ``\\g<1>`` -> ``${1}`` is not needed by the rule
    tables and is rejected; escapes such as ``\\n`` are expanded like
    Python does; literal ``$`` and ``\\`` are escaped.
    """
    out = []
    i = 0
    while i < len(repl):
        ch = repl[i]
        if ch == "\\" and i + 1 < len(repl):
            nxt = repl[i + 1]
            if nxt.isdigit():
                out.append("$" + nxt)
            elif nxt == "n":
                out.append("\n")
            elif nxt == "t":
                out.append("\t")
            elif nxt == "\\":
                out.append("\\\\")
            elif nxt == "g":
                raise ValueError("named group references are not supported in rule tables")
            else:
                out.append("\\\\" + nxt)
            i += 2
            continue
        if ch == "$":
            out.append("\\$")
        elif ch == "\\":
            out.append("\\\\")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def literal_replacement(text: str) -> str:
    """A replacement that inserts ``text`` verbatim."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def escape(text: str) -> str:
    """Escape a literal for use inside a pattern (same output as ``re.escape``)."""
    return re.escape(text)


def sub(col: Column, pattern: str, repl: str = "", flags: str = "") -> Column:
    """``re.sub(pattern, repl, col, flags)`` as a native Spark expression."""
    return F.regexp_replace(col, java_pattern(pattern, flags), java_replacement(repl))


def fold(col: Column, rules: Iterable[Sequence[str]], flags: str | None = None) -> Column:
    """Apply ``(pattern, replacement[, flags])`` rules in order.

    ``rules`` may also be bare pattern strings (removal), in which case
    ``flags`` applies to all of them.
    """
    for rule in rules:
        if isinstance(rule, str):
            col = sub(col, rule, "", flags or "")
        else:
            pattern, repl, *rest = rule
            col = sub(col, pattern, repl, rest[0] if rest else (flags or ""))
    return col


def matches(col: Column, pattern: str, flags: str = "") -> Column:
    """``re.search(pattern, col, flags) is not None``."""
    return col.rlike(java_pattern(pattern, flags))


_META = set(".^$*+?{}[]\\|()")


def _leading_literal(p: str) -> str:
    """The literal text every match must start with (possibly empty)."""
    out, i = [], 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            if p[i + 1].isalnum():
                break                      # class escape (\s, \d, \b, ...)
            lit, step = p[i + 1], 2
        elif ch == "[":
            m = re.match(r"\[(\w)(\w)\]", p[i:])
            if not (m and m.group(1).lower() == m.group(2).lower() and m.group(1) != m.group(2)):
                break
            lit, step = m.group(1), 4
        elif ch in _META:
            break
        else:
            lit, step = ch, 1
        nxt = p[i + step] if i + step < len(p) else ""
        if nxt in ("?", "*", "{"):
            break                          # optional atom: stop before it
        out.append(lit)
        if nxt == "+":
            break
        i += step
    return "".join(out)


def _top_level_alternation(p: str) -> bool:
    depth, in_class, i = 0, False, 0
    while i < len(p):
        ch = p[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            return True
        i += 1
    return False


def required_literals(pattern: str, min_len: int = 1) -> list[str] | None:
    """Literals of which at least one occurs (case-insensitively) in any text the pattern matches.

    Used as a cheap ``instr`` pre-check so a regex pass runs only on rows that
    can match; ``None`` when no such literal set is known.  Handles a leading
    ``[^.]*`` / ``\\b`` and a leading non-capturing alternation group.
    """
    if _top_level_alternation(pattern):
        return None
    p = pattern
    while True:
        if p.startswith("[^.]*"):
            p = p[5:]
        elif p.startswith("\\b"):
            p = p[2:]
        elif p.startswith("(?<!\\n)"):
            p = p[len("(?<!\\n)"):]
        elif p.startswith("(\\S)\\s+"):
            p = p[len("(\\S)\\s+"):]
        else:
            break
    if p.startswith("(") and not p.startswith("(?"):
        p = "(?:" + p[1:]
    if p.startswith("(?:"):
        depth, j = 0, 0
        while j < len(p):
            if p[j] == "\\":
                j += 2
                continue
            if p[j] == "(":
                depth += 1
            elif p[j] == ")":
                depth -= 1
                if depth == 0:
                    break
            j += 1
        if j + 1 < len(p) and p[j + 1] in "?*{":
            return None
        alts, depth, cur, k = [], 0, [], 3
        while k < j:
            ch = p[k]
            if ch == "\\":
                cur.append(p[k:k + 2])
                k += 2
                continue
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            if ch == "|" and depth == 0:
                alts.append("".join(cur))
                cur = []
            else:
                cur.append(ch)
            k += 1
        alts.append("".join(cur))
        lits = [_leading_literal(a).lower() for a in alts]
    else:
        lits = [_leading_literal(p).lower()]
    if any(len(x) < min_len for x in lits):
        return None
    return lits
