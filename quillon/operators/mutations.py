"""Writes of the data model as appends and derived state.

Parquet has no updates: rows are appended, and state is what the latest rows
say. Writers stamp what a database would by trigger or default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.ordered import with_previous


def append(df: DataFrame, path: str) -> DataFrame:
    """Append rows, stamped with the time of writing where they have no created_at."""
    if "created_at" not in df.columns:
        df = df.withColumn("created_at", F.current_timestamp())
    df.write.mode("append").parquet(path)
    return df


def with_defaults(df: DataFrame, schema: T.StructType, **stamps: Column | str | int | None) -> DataFrame:
    """Exactly the columns of a schema: those given, stamps, and null for the rest."""
    out = []
    for f in schema.fields:
        if f.name in stamps:
            v = stamps[f.name]
            c = v if isinstance(v, Column) else F.lit(v)
        else:
            c = F.col(f.name) if f.name in df.columns else F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def updated(rows: DataFrame, key: str, value, patch: dict[str, object]) -> DataFrame:
    """The rows with some columns of one key replaced; a row that is hit is stamped where the table has updated_at."""
    hit = F.col(key) == F.lit(value)
    if "updated_at" in rows.columns and "updated_at" not in patch:
        rows = rows.withColumn("updated_at", F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at")).cast(rows.schema["updated_at"].dataType))
    return rows.select(*[F.when(hit, F.lit(patch[c])).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in patch else F.col(c) for c in rows.columns])


def missing_rows(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Get or create: those wanted that have no row yet, one for each key, the least of several; null keys create nothing."""
    rest = [c for c in wanted.columns if c != key]
    one = wanted.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")) if rest else wanted.where(F.col(key).isNotNull()).distinct()
    new = one.join(existing.select(key).distinct(), key, "left_anti")
    return new.select(*[F.col("__row")[c].alias(c) if c in rest else F.col(c) for c in wanted.columns])


def website_rows(businesses: DataFrame, websites: DataFrame) -> DataFrame:
    """The websites (business_id, url), and one for each business that has an address and no row yet."""
    wanted = businesses.where(F.nullif(F.col("website_url"), F.lit("")).isNotNull()).select(F.col("id").alias("business_id"), F.col("website_url").alias("url"))
    return websites.select("business_id", "url").unionByName(missing_rows(wanted, websites, "business_id"))


def stage_changes(history: DataFrame, key: str = "lead_id", stage: str = "stage", at: str = "created_at", tie: str = "id") -> DataFrame:
    """Activities derived from successive stages of each lead: (lead, at, from_stage, to_stage) wherever the stage differs from the one before."""
    moved = with_previous(history.select(key, tie, at, F.col(stage).alias("to_stage")), key, [at, tie], "to_stage", "from_stage")
    return moved.where(F.col("from_stage").isNotNull() & (F.col("from_stage") != F.col("to_stage")))


def last_touched(rows: DataFrame, key: str, at: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(at).alias(name))


def follow_up(lead_id: Column, action: Column, date: Column) -> tuple[Column, Column, Column]:
    """Blank action and date become null, and a note is due only where there is an action."""
    own = F.nullif(F.trim(action), F.lit(""))
    note = F.when(own.isNotNull(), F.struct(lead_id.alias("lead_id"), F.lit("note").alias("type"), own.alias("description")))
    return own, F.nullif(F.trim(date), F.lit("")).try_cast("date"), note


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose reference points nowhere."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")
