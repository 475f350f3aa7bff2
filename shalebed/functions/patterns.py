"""String functions of the scripting language's library, on the JVM: its patterns become regular expressions.

Positions count from 1, negative ones from the end. Not expressible, and refused: %b, position captures and %1 inside a
pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes of the pattern language as parts of a regular expression's set.
CLASSES = {"a": r"\p{Alpha}", "c": r"\p{Cntrl}", "d": "0-9", "g": r"\p{Graph}", "l": r"\p{Lower}", "p": r"\p{Punct}", "s": r"\s\x0B", "u": r"\p{Upper}", "w": r"\p{Alnum}", "x": r"\p{XDigit}"}
_SPECIAL = set(r"\^$.|?*+()[]{}&-~")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _literal(ch: str) -> str:
    return "\\" + ch if ch in _SPECIAL else ch


def _class(letter: str) -> str | None:
    """A set for a class letter; capitals are complements; none for an escaped character."""
    inside = CLASSES.get(letter.lower())
    return inside and (f"[{inside}]" if letter.islower() else f"[^{inside}]")


def _set(pattern: str, at: int) -> tuple[str, int]:
    """The set that begins at pattern[at] == '[' and the position after it."""
    out, i = ["["], at + 1
    if pattern[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while first or pattern[i : i + 1] != "]":
        if i >= len(pattern):
            raise ValueError("set without an end")
        first = False
        if pattern[i] == "%":
            out.append(_class(pattern[i + 1]) or _literal(pattern[i + 1]))
            i += 2
        elif pattern[i + 1 : i + 2] == "-" and pattern[i + 2 : i + 3] not in ("", "]"):
            out.append(f"{_literal(pattern[i])}-{_literal(pattern[i + 2])}")
            i += 3
        else:
            out.append(_literal(pattern[i]))
            i += 1
    return "".join(out) + "]", i + 1


def to_regex(pattern: str) -> str:
    """The regular expression of a pattern: . matches all characters, ^ and $ bind only at the pattern's ends."""
    return _translate(pattern)[0]


def _translate(pattern: str) -> tuple[str, int]:
    """The regular expression and how many captures it has."""
    out, i, captures = ["(?s)"], 0, 0
    if pattern.startswith("^"):
        out.append(r"\A")
        i = 1
    while i < len(pattern):
        ch = pattern[i]
        if ch in "()":
            if pattern[i : i + 2] == "()":
                raise ValueError("position captures are not supported")
            out.append(ch)
            captures += ch == "("
            i += 1
            continue
        if ch == "$" and i == len(pattern) - 1:
            out.append(r"\z")
            break
        if ch == "%":
            if i + 1 == len(pattern):
                raise ValueError("% at the end")
            letter = pattern[i + 1]
            if letter == "b" or letter.isdigit():
                raise ValueError(f"%{letter} is not supported")
            if letter == "f":
                inside, i = _set(pattern, i + 2)
                out.append(f"(?<!{inside})(?={inside}" + (r"|\z)" if inside.startswith("[^") else ")"))
                continue
            one, i = _class(letter) or _literal(letter), i + 2
        elif ch == "[":
            one, i = _set(pattern, i)
        else:
            one, i = "." if ch == "." else _literal(ch), i + 1
        many = pattern[i : i + 1]
        if many and many in "*+?-":
            one, i = one + {"-": "*?"}.get(many, many), i + 1
        out.append(one)
    return "".join(out), captures


def _groups(pattern: str) -> int:
    return _translate(pattern)[1]


def match(x: Column | str, pattern: str, capture: int = 1) -> Column:
    """The first capture (or another) of the first match, the whole match if there is none; null without a match."""
    regex = to_regex(pattern)
    return F.when(_c(x).rlike(regex), F.regexp_extract(_c(x), regex, capture if _groups(pattern) else 0))


def find(x: Column | str, pattern: str) -> Column:
    """struct(first, last) of the first match, null without one; an empty match ends before it begins."""
    regex = to_regex(pattern)
    hit = F.regexp_extract(_c(x), regex, 0)
    first = F.regexp_instr(_c(x), F.lit(regex))
    return F.when(_c(x).rlike(regex), F.struct(first.alias("first"), (first + F.length(hit) - 1).alias("last")))


def gmatch(x: Column | str, pattern: str) -> Column:
    """The first captures (or the matches) of all matches, in order."""
    return F.regexp_extract_all(_c(x), F.lit(to_regex(pattern)), F.lit(1 if _groups(pattern) else 0))


def gsub(x: Column | str, pattern: str, replacement: str) -> Column:
    """All matches replaced; %0 to %9 in the replacement are captures, %% is a percent sign."""
    out, i = [], 0
    alone = not _groups(pattern)
    while i < len(replacement):
        ch = replacement[i]
        if ch == "%" and i + 1 < len(replacement):
            nxt = replacement[i + 1]
            out.append(f"${0 if alone and nxt == '1' else nxt}" if nxt.isdigit() else _quote(nxt))
            i += 2
        else:
            out.append(_quote(ch))
            i += 1
    return F.regexp_replace(_c(x), to_regex(pattern), "".join(out))


def _quote(ch: str) -> str:
    return "\\" + ch if ch in "\\$" else ch


def sub(x: Column | str, first: int, last: int = -1) -> Column:
    """Characters first to last."""
    n = F.length(_c(x))
    start = F.greatest(F.lit(first), F.lit(1)) if first >= 0 else F.greatest(n + first + 1, F.lit(1))
    end = F.least(F.lit(last), n) if last >= 0 else n + last + 1
    return F.when(end >= start, F.substring(_c(x), start, end - start + 1)).otherwise(F.when(n.isNotNull(), F.lit("")))


def byte(x: Column | str, at: int = 1) -> Column:
    """The code at a position; null outside."""
    one = sub(x, at, at)
    return F.when(F.length(one) > 0, F.ascii(one))


def rep(x: Column | str, n: int, separator: str = "") -> Column:
    """n copies with a separator between them."""
    return F.when(_c(x).isNotNull(), F.lit("") if n < 1 else F.array_join(F.array_repeat(_c(x), n), separator))


def octal_escape(x: Column | str) -> Column:
    """UTF-8 bytes outside printable ASCII, the blank and the backslash as \\0 and three octal digits."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(_c(x))), lambda i: F.conv(F.hex(F.substring(F.encode(_c(x), "UTF-8"), i, F.lit(1))), 16, 10).cast("int"))
    shown = F.transform(codes, lambda b: F.when((b > 32) & (b < 127) & (b != 92), F.char(b)).otherwise(F.concat(F.lit("\\0"), F.lpad(F.conv(b.cast("string"), 10, 8), 3, "0"))))
    return F.when(F.octet_length(_c(x)) > 0, F.array_join(shown, "")).otherwise(_c(x))
