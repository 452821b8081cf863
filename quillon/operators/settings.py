"""Settings: one row for each owner, with defaults where an owner has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.skew import even_join
from quillon.schemas import AGENCY_NAME, LEAD_WEIGHTS, OPPORTUNITY_WEIGHTS, SETTINGS


def default_rows(owners: DataFrame, ai_model: str | None = None) -> DataFrame:
    """The row that a new owner gets, for each distinct ``owner_id``."""
    weights = F.struct(
        F.struct(*[F.lit(v).alias(k) for k, v in OPPORTUNITY_WEIGHTS.items()]).alias("opportunity"),
        F.struct(*[F.lit(v).alias(k) for k, v in LEAD_WEIGHTS.items()]).alias("lead_score"),
    )
    none = F.array().cast("array<string>")
    given = {
        "owner_id": F.col("owner_id"), "agency_name": F.lit(AGENCY_NAME), "agency_identity": F.create_map().cast("map<string,string>"), "sectors": none,
        "countries": none, "cities": none, "services": none, "pricing": F.create_map().cast("map<string,double>"), "scoring_weights": weights,
        "ai_model": F.lit(ai_model), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(),
    }
    return owners.select("owner_id").where("owner_id is not null").distinct().select(*[given[f.name].cast(f.dataType).alias(f.name) for f in SETTINGS.fields])


def ensured(settings: DataFrame, owners: DataFrame, ai_model: str | None = None) -> DataFrame:
    """The settings, and a default row for each owner without one."""
    lacking = owners.select("owner_id").join(settings.select("owner_id"), "owner_id", "left_anti")
    return settings.select(*SETTINGS.names).unionByName(default_rows(lacking, ai_model))


#: So many owners' settings or fewer are sent to every task.
MOST_OWNERS = 20_000


def with_settings(rows: DataFrame, settings: DataFrame, *names: str) -> DataFrame:
    """Rows with some of their owner's settings, as struct ``settings``; settings have one row an owner.

    An owner may have any share of the rows, so rows are never dealt by owner alone:
    up to a bound the settings are fetched and broadcast; beyond it they are joined with the rows of
    frequent owners in pieces.
    """
    own = settings.select(F.col("owner_id").alias("__owner"), F.struct(*names).alias("settings"))
    few = own.limit(MOST_OWNERS + 1).collect()
    if len(few) <= MOST_OWNERS:
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(few, own.schema)), F.col("owner_id") == F.col("__owner"), "left").drop("__owner")
    return even_join(rows, own, F.col("owner_id"), "__owner").drop("__owner")


def weights(part: str) -> dict[str, Column]:
    """Weights out of the struct that ``with_settings`` adds, for scoring."""
    names = OPPORTUNITY_WEIGHTS if part == "opportunity" else LEAD_WEIGHTS
    return {n: F.col(f"settings.scoring_weights.{part}.{n}") for n in names}
