"""Text helpers on columns, with the edge cases the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def before_first(text: Column, mark: str) -> Column:
    """The text before the first ``mark``; all of it when there is none."""
    return F.substring_index(text, mark, 1)


def after_first(text: Column, mark: str) -> Column:
    """The text after the first ``mark``; empty when there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark))).otherwise(F.lit(""))


def head(text: Column, length: Column) -> Column:
    """The first ``length`` characters; none for a length of zero or less."""
    return F.substring(text, F.lit(1), F.greatest(length, F.lit(0)))
