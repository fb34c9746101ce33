"""Folds by a checksum of the document id, so that every run holds out the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(key.cast("string").cast("binary")) % folds


def is_fold(id_col: str | Column, folds: int, fold: int) -> Column:
    """Whether a row belongs to ``fold``; false for a null id."""
    return F.coalesce(remainder(id_col, folds) == fold, F.lit(False))
