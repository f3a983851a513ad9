"""Level words and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and numbers of each level.
WORDS = {
    "TRACE": ("TRACE", "VERBOSE"),
    "DEBUG": ("DEBUG",),
    "INFO": ("INFO", "INFORMATION", "NOTICE"),
    "WARN": ("WARN", "WARNING"),
    "ERROR": ("ERROR", "ERR", "SEVERE"),
    "FATAL": ("FATAL", "CRITICAL", "CRIT", "EMERG", "EMERGENCY", "ALERT", "PANIC"),
}
NUMBERS = {"TRACE": (10,), "DEBUG": (20, 7), "INFO": (30, 5, 6), "WARN": (40, 4), "ERROR": (50, 3), "FATAL": (60, 0, 1, 2)}
LEVELS = (*WORDS, "UNKNOWN")
ALL_WORDS = "|".join(sorted((w for ws in WORDS.values() for w in ws), key=lambda w: (-len(w), w)))
ERRORS = ("ERROR", "FATAL")


class UnknownLevel(ValueError):
    pass


def level_name(word: str) -> str:
    """The level that a user's word names; ``unknown`` is one."""
    up = word.strip().upper()
    if up == "UNKNOWN":
        return up
    for level, words in WORDS.items():
        if up in words:
            return level
    raise UnknownLevel(f"unknown level: {word!r}")


def parse_levels(levels: str | list[str] | None) -> list[str]:
    """A comma list (or a list) of level words as level names, each once."""
    if not levels:
        return []
    words = levels.split(",") if isinstance(levels, str) else levels
    return list(dict.fromkeys(level_name(w) for w in words if w.strip()))


def word_level(word: Column) -> Column:
    """The level of a word in any letter case; null if it is none."""
    up, out = F.upper(word), F.lit(None).cast("string")
    for level, words in WORDS.items():
        out = F.when(up.isin(*words), level).otherwise(out)
    return out


def number_level(number: Column) -> Column:
    out = F.lit(None).cast("string")
    for level, numbers in NUMBERS.items():
        out = F.when(number.isin(*numbers), level).otherwise(out)
    return out


def level_text(text: Column) -> Column:
    """Upper-cased and trimmed; blank or null is UNKNOWN."""
    up = F.upper(F.trim(text))
    return F.when(up.isNull() | (up == ""), "UNKNOWN").otherwise(up)
