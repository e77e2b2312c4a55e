"""Feature descriptions: type, allowed range or codes, and what counts as missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("continuous", "discrete", "categorical")


@dataclass(frozen=True)
class Feature:
    """One column. ``codes`` holds the allowed codes of a categorical one, ``lo``/``hi`` the bounds of the others."""

    name: str
    kind: str
    lo: float | None = None
    hi: float | None = None
    codes: tuple[float, ...] = ()
    tolerance: float | None = None
    step: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in TYPES:
            raise ValueError(f"unknown feature type {self.kind!r} of {self.name}")


def features_of(domain: DataFrame, table_name: str) -> dict[str, Feature]:
    """The features of one table from a feature-domain table (a schema: one row per column)."""
    out = {}
    for r in domain.where(F.col("table_name") == table_name).collect():
        out[r["field_name"]] = Feature(r["field_name"], r["feature_type"], r["domain_lo"], r["domain_hi"], tuple(r["domain_codes"] or ()), r["overlap_tolerance"], r["cluster_step"])
    return out


def known(value: Column, feature: Feature) -> Column:
    """The value as double where it lies in the feature's domain, else NULL (null, NaN, out of range or codes)."""
    x = value.cast("double")
    ok = x.isin(*[float(c) for c in feature.codes]) if feature.codes else (x >= F.lit(float(feature.lo))) & (x <= F.lit(float(feature.hi)))
    return F.when(ok & ~F.isnan(x), x)


def plain(value: Column) -> Column:
    """Text for comparison: trimmed, lower case, inner white space single."""
    return F.lower(F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))
