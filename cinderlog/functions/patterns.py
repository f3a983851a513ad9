"""User patterns: checked on the driver, translated to Java's dialect, and globs as patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_LENGTH = 1000


class InvalidPattern(ValueError):
    pass


def checked(pattern: str) -> str:
    """The pattern, if it is short enough and neither uses look-arounds nor references back, which a linear-time engine refuses."""
    if len(pattern) > MOST_LENGTH:
        raise InvalidPattern(f"pattern of {len(pattern)} characters; the most is {MOST_LENGTH}")
    if re.search(r"\(\?(?:<?[=!])|\\[1-9]|\(\?P=", re.sub(r"\\\\", "", pattern)):
        raise InvalidPattern("look-around and back-references are not supported")
    try:
        re.compile(pattern)
    except re.error as e:
        raise InvalidPattern(f"{pattern!r}: {e}") from None
    return pattern


@dataclass(frozen=True)
class JavaPattern:
    """A translated pattern, and the place of each named group."""

    text: str
    groups: dict[str, int]


def to_java(pattern: str, ignore_case: bool = False) -> JavaPattern:
    """Named groups become plain ones with a map of places (Java refuses names with ``_``); classes are Unicode as in the source dialect."""
    checked(pattern)
    names = dict(re.compile(pattern).groupindex)
    text = re.sub(r"\(\?P?<([A-Za-z_]\w*)>", "(", pattern)
    return JavaPattern(("(?iuU)" if ignore_case else "(?U)") + text, names)


def matches(pattern: str, *columns: Column, ignore_case: bool = True) -> Column:
    """Whether any column matches; null columns do not."""
    java = to_java(pattern, ignore_case).text
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.rlike(java), F.lit(False))
    return out


def glob_pattern(glob: str) -> str:
    """A shell pattern over a whole name as a Java pattern."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            inner = glob[i:j].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = j + 1
        else:
            out.append(re.escape(c))
    return r"(?s)\A" + "".join(out) + r"\z"


def base_name(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)


def name_matches(file: Column, glob: str | None) -> Column:
    """Whether the file's own name fits the glob; no glob fits all."""
    return F.lit(True) if not glob else F.coalesce(base_name(file).rlike(glob_pattern(glob)), F.lit(False))


def template(text: str, of: dict[str, Column]) -> Column:
    """``{name}`` replaced by the column's text; an unknown name stays as written, a null is empty."""
    parts: list[Column] = []
    for piece in re.split(r"(\{[A-Za-z_]\w*\})", text):
        name = piece[1:-1] if piece.startswith("{") and piece.endswith("}") else None
        parts.append(F.coalesce(of[name].cast("string"), F.lit("")) if name in of else F.lit(piece))
    return F.concat(*parts)
