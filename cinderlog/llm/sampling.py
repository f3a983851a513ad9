"""What the fitted operators share: folds by document, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 by FOLDS; a null id is in no fold and never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return doc_id.isNotNull() & ~held_out(doc_id)


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the id."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id.cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
