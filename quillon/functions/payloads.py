"""Parts of records as JSON for a language model, and what it returns as records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a business that each kind of text is written from.
AUDIT = ["name", "category", "sector", "city", "website_url", "rating", "review_count"]
PROPOSAL = OUTREACH = ["name", "category", "city"]
DEMO = ["name", "category", "sector", "city", "address", "phone", "rating", "review_count"]
# The parts of a scan and of a score that an audit is written from.
SCAN = ["technical", "seo", "conversion", "unavailable_metrics"]
SCORE = ["opportunity_score", "buying_intent_score", "opportunity_breakdown"]


def payload(names: list[str], row: str | None = None) -> Column:
    """Some columns, or fields of a struct, as one JSON text; nulls are written, and a null struct gives null."""
    parts = [F.col(f"{row}.{n}" if row else n).alias(n) for n in names]
    out = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    return F.when(F.col(row).isNotNull(), out) if row else out


def structured(answer: Column, schema: T.StructType) -> Column:
    """The answer as a record; null if it is no JSON object, lacks a field, has a null or one too many."""
    record = F.from_json(answer, schema, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(answer)
    whole = F.size(F.array_except(keys, F.array(*map(F.lit, schema.names)))) == 0
    for n in schema.names:
        whole = whole & record[n].isNotNull()
    return F.when(whole, record)
