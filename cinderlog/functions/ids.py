"""Identifiers: virtual traces, export ids, and guesses at what an id is."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def virtual_trace_id(group: Column, rule: Column, key: Column) -> Column:
    return F.concat(F.lit("vt-"), F.substring(F.sha2(F.concat_ws(":", group, rule, key), 256), 1, 12))


def no_id(value: Column) -> Column:
    """An all-zero id of 16 or 32 characters names nothing."""
    return F.when(value.rlike(r"\A(?:0{16}|0{32})\z"), F.lit(None)).otherwise(value)


def hex_id(value: Column, digits: int, nth: Column | None = None) -> Column:
    """A valid id of so many hex digits in lower case, else the head of a digest; repeats are salted by their number."""
    low = F.lower(value)
    salted = value if nth is None else F.when(nth > 1, F.concat(value, F.lit("#"), nth.cast("string"))).otherwise(value)
    valid = low.rlike(rf"\A[0-9a-f]{{{digits}}}\z") & ~low.rlike(r"\A0+\z")
    if nth is not None:
        valid = valid & (nth == 1)
    return F.when(valid, low).otherwise(F.substring(F.sha2(salted, 256), 1, digits))


def id_shape(value: Column) -> Column:
    """What an id looks like: worker-N, uuid, req-..., trace-..., or other."""
    return (
        F.when(value.rlike(r"\Aworker-\d+\z"), "worker-N")
        .when(value.rlike(r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), "uuid")
        .when(value.startswith("req-"), "req-...")
        .when(value.startswith("trace-"), "trace-...")
        .when(value.isNotNull(), "other")
    )


def kind_of_id(identifier: str) -> str:
    """Whether an identifier given by a user is a trace or a correlation."""
    return "trace" if identifier.startswith("trace-") or re.fullmatch(r"[0-9a-fA-F]{32}", identifier) or len(identifier) == 32 else "correlation"
