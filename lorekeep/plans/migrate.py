"""Schema evolution of stored tables: a plan first, changes only on request."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.text import keywords_from_json
from lorekeep.operators.upkeep import duplicate_keys
from lorekeep.schemas import CHUNKS, VECTOR

ACTIONS = "step int, target string, action string, detail string"


@dataclass(frozen=True)
class Step:
    target: str
    action: str  # skip, change or blocked
    detail: str
    change: Callable[[dict[str, DataFrame]], DataFrame] | None = None


def _unique(tables: dict[str, DataFrame], name: str) -> Step:
    example = duplicate_keys(tables[name], "document_id").limit(1).collect()
    if example:
        row = example[0]
        return Step(name, "blocked", f"{row['document_id']} occurs {row['copies']} times")
    return Step(name, "skip", "document_id is unique")


def invalid_json(metadata: DataFrame) -> DataFrame:
    """How many values are no JSON: one row, ``invalid``."""
    values = metadata.where(F.col("keywords").isNotNull()).select("keywords")
    readable = F.try_parse_json(F.col("keywords")).isNotNull()
    return values.agg(F.count_if(~readable).alias("invalid"))


def convert_keywords(metadata: DataFrame) -> DataFrame:
    return metadata.withColumn("keywords", keywords_from_json(F.col("keywords")))


def add_missing(table: DataFrame, fields: dict[str, T.DataType]) -> DataFrame:
    """Columns that are absent, as NULL; existing ones stay as they are."""
    absent = {n: F.lit(None).cast(t) for n, t in fields.items() if n not in table.columns}
    return table.withColumns(absent) if absent else table


def _keywords(tables: dict[str, DataFrame]) -> Step:
    name = "document_ai_metadata"
    if "keywords" not in tables[name].columns:
        return Step(name, "blocked", "no keywords column")
    if isinstance(tables[name].schema["keywords"].dataType, T.ArrayType):
        return Step(name, "skip", "keywords is a list")
    bad = invalid_json(tables[name]).first()[0]
    return Step(
        name, "change", f"keywords to list, {bad} unreadable become []",
        lambda t: convert_keywords(t[name]),
    )


def _columns(tables: dict[str, DataFrame], name: str, fields: dict[str, T.DataType]) -> Step:
    missing = [n for n in fields if n not in tables[name].columns]
    if not missing:
        return Step(name, "skip", f"has {', '.join(fields)}")
    return Step(
        name, "change", f"add {', '.join(missing)}", lambda t: add_missing(t[name], fields)
    )


def migration_steps(spark: SparkSession, tables: dict[str, DataFrame]) -> list[Step]:
    """The six checks in their fixed order."""
    if "chunks" in tables:
        chunks = Step("chunks", "skip", "table exists")
        parent = _columns(tables, "chunks", {"parent_text": T.StringType()})
    else:
        chunks = Step("chunks", "change", "create", lambda t: spark.createDataFrame([], CHUNKS))
        parent = Step("chunks", "skip", "created with parent_text")
    return [
        _unique(tables, "document_content"),
        _unique(tables, "document_ai_metadata"),
        _keywords(tables),
        _columns(tables, "document_content", {"embedding": VECTOR}),
        chunks,
        parent,
    ]


def migration_plan(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """What a migration would do, one row per step; nothing is written."""
    rows = [
        (n, s.target, s.action, s.detail)
        for n, s in enumerate(migration_steps(spark, tables), start=1)
    ]
    return spark.createDataFrame(rows, ACTIONS)


def migrated_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables in the current schema; blocked steps leave theirs unchanged."""
    out = dict(tables)
    for step in migration_steps(spark, tables):
        if step.change is not None:
            out[step.target] = step.change(out)
    return out


def is_blocked(plan: DataFrame) -> bool:
    return not plan.where("action = 'blocked'").isEmpty()
