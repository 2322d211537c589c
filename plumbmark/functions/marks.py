"""Epistemic marks as struct columns: tag, evidence, basis, gap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbmark.params import EXTRAPOLATED, GROUNDED, INFERRED, UNKNOWN

EVIDENCE = "array<struct<source:string,signal:string>>"


def evidence(source: str | Column, signal: str | Column) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(text(source).alias("source"), text(signal).alias("signal"))


def mark(tag: str | Column, found: Column | None = None, basis: Column | None = None, gap: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (tag if isinstance(tag, Column) else F.lit(tag)).alias("tag"),
        (F.array() if found is None else found).cast(EVIDENCE).alias("evidence"),
        (none if basis is None else basis).cast("string").alias("basis"),
        (none if gap is None else gap).cast("string").alias("gap"),
    )


def grounded(found: Column) -> Column:
    return mark(GROUNDED, found)


def inferred(found: Column) -> Column:
    return mark(INFERRED, found)


def extrapolated(found: Column, basis: Column) -> Column:
    return mark(EXTRAPOLATED, found, basis=basis)


def unknown(gap: Column) -> Column:
    return mark(UNKNOWN, gap=gap)


def tainted(tag: Column) -> Column:
    return tag.isin(EXTRAPOLATED, UNKNOWN)
