"""Schema files: one ``name:type[:v1,v2,...].`` line per column."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probloom.schema import TYPES


@dataclass(frozen=True)
class Column_:
    """A declared column; ``domain`` is None where the file gives none. Categories may be text."""

    name: str
    kind: str
    domain: tuple | None = None


def parse_line(line: str) -> Column_:
    text = line.strip()
    if not text.endswith("."):
        raise ValueError(f"no full stop at the end of {text!r}")
    parts = text[:-1].split(":")
    if len(parts) not in (2, 3) or parts[1] not in TYPES:
        raise ValueError(f"not a column line: {text!r}")
    domain = None
    if len(parts) == 3 and parts[2]:
        raw = [v.strip() for v in parts[2].split(",")]
        numbers = all(re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", v) for v in raw)
        domain = tuple(sorted(float(v) for v in raw)) if numbers else tuple(sorted(raw))
    return Column_(parts[0], parts[1], domain)


def parse(text: str) -> list[Column_]:
    return [parse_line(x) for x in text.splitlines() if x.strip()]


def read(spark: SparkSession, path: str) -> list[Column_]:
    """The columns of a schema file, in order (a file of a line per column)."""
    return parse("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def format_line(c: Column_) -> str:
    show = lambda v: v if isinstance(v, str) else f"{v:.5f}" if c.kind == "continuous" else f"{int(v)}"
    return f"{c.name}:{c.kind}" + (":" + ",".join(map(show, c.domain)) if c.domain else "") + "."


def format_columns(columns: Sequence[Column_]) -> str:
    return "\n".join(map(format_line, columns)) + "\n"


def from_mappings(names: Sequence[str], kinds: Sequence[str], codes: Sequence[Mapping[object, int] | None]) -> list[Column_]:
    """Columns whose domains come from value-to-code mappings, as codes in order."""
    return [Column_(n, k, tuple(float(v) for v in sorted(m.values())) if m else None) for n, k, m in zip(names, kinds, codes)]


def coder(column: Column_, raw: Sequence[str]) -> dict[str, int]:
    """Value-to-code mapping of a domain in file order; for a discrete column text that is no number gets the greatest code plus one."""
    if column.kind == "discrete":
        out = {v: int(float(v)) for v in raw if re.fullmatch(r"[-+]?\d+(\.\d+)?", v)}
        for v in raw:
            out.setdefault(v, max(out.values(), default=-1) + 1)
        return out
    return {v: i for i, v in enumerate(dict.fromkeys(raw))}


def schema_of(columns: Sequence[Column_], families: Sequence[str] | None = None) -> T.StructType:
    """Double columns that carry type, domain and leaf family as metadata."""
    out = []
    for i, c in enumerate(columns):
        meta = {"feature_type": c.kind, "domain": [float(v) for v in c.domain] if c.domain and not isinstance(c.domain[0], str) else []}
        if families:
            meta["family"] = families[i]
        out.append(T.StructField(c.name, T.DoubleType(), True, meta))
    return T.StructType(out)


def output_formats(df: DataFrame, columns: Sequence[Column_]) -> list[Column]:
    """Text of every column as data files have it: whole numbers, or five places for continuous ones."""
    return [(F.format_string("%.5f", F.col(c.name).cast("double")) if c.kind == "continuous" else F.format_string("%d", F.col(c.name).cast("long"))).alias(c.name) for c in columns]
