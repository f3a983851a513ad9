"""strptime words that name a full date and time, compiled on the driver to a pattern and a cast."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that are read, and what each takes.
WORDS = {"Y": r"\d{4}", "y": r"\d{2}", "m": r"\d{1,2}", "b": r"[A-Za-z]{3}", "B": r"[A-Za-z]{3,9}", "d": r"\d{1,2}", "H": r"\d{1,2}", "M": r"\d{1,2}", "S": r"\d{1,2}", "f": r"\d{1,9}", "z": r"Z|[+-]\d{2}:?\d{2}"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


class BadTimestampFormat(ValueError):
    pass


def compiled(fmt: str) -> tuple[str, dict[str, int]]:
    """The pattern of a format, and the group of each word in it."""
    out, places, i = [], {}, 0
    while i < len(fmt):
        c = fmt[i]
        if c != "%":
            out.append(r"\s+" if c.isspace() else re.escape(c))
            i += 1
            continue
        if i + 1 >= len(fmt):
            raise BadTimestampFormat("a lone % at the end")
        word = fmt[i + 1]
        i += 2
        if word == "%":
            out.append("%")
        elif word not in WORDS:
            raise BadTimestampFormat(f"%{word} is not read")
        elif word in places:
            raise BadTimestampFormat(f"%{word} twice")
        else:
            places[word] = len(places) + 1
            out.append(f"({WORDS[word]})")
    if not ({"Y", "y"} & set(places) and {"m", "b", "B"} & set(places) and "d" in places):
        raise BadTimestampFormat("a year, a month and a day are needed")
    return r"(?s)\A" + "".join(out) + r"\z", places


def read_with(text: Column, fmt: str) -> Column:
    """Text in that format as zone-less UTC, else null."""
    pattern, places = compiled(fmt)
    group = lambda w: F.regexp_extract(text, pattern, places[w])
    number = lambda w: group(w).try_cast("int") if w in places else F.lit(0)
    year = number("Y") if "Y" in places else F.when(number("y") < 69, number("y") + 2000).otherwise(number("y") + 1900)
    if "m" in places:
        month = number("m")
    else:
        name = F.lower(group("b" if "b" in places else "B"))
        listed = F.array(*map(F.lit, MONTHS if "b" in places else FULL_MONTHS))
        month = F.nullif(F.array_position(listed, name).cast("int"), F.lit(0))
    fraction = F.rpad(F.substring(group("f"), 1, 6), 6, "0") if "f" in places else F.lit("000000")
    second = F.least(number("S"), F.when(number("S") <= 60, 59))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    built = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), two(month), F.lit("-"), two(number("d")), F.lit(" "), two(number("H")), F.lit(":"), two(number("M")), F.lit(":"), two(second), F.lit("."), fraction)
    local = F.when(text.rlike(pattern), built.try_cast("timestamp_ntz"))
    if "z" not in places:
        return local
    zone = F.translate(group("z"), ":", "")
    minutes = F.when(zone == "Z", 0).otherwise(F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")))
    return F.timestamp_add("MINUTE", -minutes, local)
