"""Closed value sets and record types of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed value sets of the data model, in their natural order.
JOB_TYPES = ["discovery", "website_scan", "seo_analysis", "local_analysis", "competitor_analysis", "ai_audit", "proposal_generation", "demo_generation"]
JOB_STATUSES = ["QUEUED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"]
BUSINESS_SOURCES = ["csv_import", "google_places", "manual"]
SCAN_STATUSES = ["completed", "partial", "failed"]
PROPOSAL_STATUSES = ["draft", "sent", "accepted", "rejected"]
DEMO_STATUSES = ["draft", "ready", "published"]
STAGES = ["NEW", "ANALYZING", "QUALIFIED", "AUDIT_READY", "DEMO_READY", "CONTACTED", "REPLIED", "MEETING", "PROPOSAL", "NEGOTIATION", "WON", "LOST"]
STAGE_LABELS = [
    "Nuevo", "Analizando", "Cualificado", "Auditoría lista", "Demo lista", "Contactado", "Ha respondido", "Reunión", "Propuesta", "Negociación", "Ganado", "Perdido",
]
ACTIVITY_TYPES = ["stage_change", "note", "call", "email", "meeting", "whatsapp"]
USAGE_SERVICES = ["anthropic", "google_places", "google_pagespeed", "webflow"]
HIGH_VALUE_SECTORS = ["Hoteles", "Clínicas dentales", "Restaurantes"]

# Default weights, by name of the sub-score and in the order in which products are added up.
OPPORTUNITY_WEIGHTS = {
    "website_quality": 0.2, "seo": 0.2, "local_seo": 0.15, "performance": 0.1, "mobile_ux": 0.1, "conversion": 0.15, "competitive_gap": 0.1,
}
LEAD_WEIGHTS = {"opportunity": 0.35, "buying_intent": 0.35, "business_value": 0.15, "competitive_gap": 0.15}

#: What an import yields.
RECORD = T.StructType([
    T.StructField("name", T.StringType(), False),
    *(T.StructField(n, T.StringType()) for n in ("category", "sector", "address", "city", "region", "postal_code", "country", "phone", "website_url", "email", "gbp_place_id")),
    T.StructField("rating", T.DoubleType()), T.StructField("review_count", T.IntegerType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("source", T.StringType()),
])

#: A stored business: an imported record with its owner, the job it came by, and stamps.
BUSINESS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("owner_id", T.LongType()), *RECORD.fields, T.StructField("source_job_id", T.LongType()),
    T.StructField("last_analyzed_at", T.TimestampType()), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
])

# Fixed value: what an agency is called until it says so.
AGENCY_NAME = "My Agency"

_weights = lambda names: T.StructType([T.StructField(n, T.DoubleType()) for n in names])
SETTINGS = T.StructType([
    T.StructField("owner_id", T.LongType()), T.StructField("agency_name", T.StringType()), T.StructField("agency_identity", T.MapType(T.StringType(), T.StringType())),
    *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("sectors", "countries", "cities", "services")), T.StructField("pricing", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("scoring_weights", T.StructType([T.StructField("opportunity", _weights(OPPORTUNITY_WEIGHTS)), T.StructField("lead_score", _weights(LEAD_WEIGHTS))])),
    T.StructField("ai_model", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
])

# Fields of what language models return, texts (t) and lists of texts (l). All are required.
_output = lambda **kinds: T.StructType([T.StructField(n, T.StringType() if k == "t" else T.ArrayType(T.StringType())) for n, k in kinds.items()])
AUDIT_OUTPUT = _output(summary="t", problems="l", opportunities="l", commercial_impact="t", recommendations="l", priorities="l")
PROPOSAL_OUTPUT = _output(title="t", services="l", timeline="t", maintenance_terms="t", next_steps="t", content="t")
OUTREACH_OUTPUT = _output(subject="t", body="t")
DEMO_OUTPUT = _output(headline="t", subheadline="t", about="t", cta_text="t")

PAGE_SIGNALS = T.StructType([
    T.StructField("image_count", T.IntegerType()), T.StructField("images_missing_alt", T.IntegerType()),
    T.StructField("internal_link_count", T.IntegerType()), T.StructField("external_link_count", T.IntegerType()),
    T.StructField("word_count_estimate", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("title_length", T.IntegerType()),
    T.StructField("meta_description", T.StringType()), T.StructField("meta_description_length", T.IntegerType()),
    T.StructField("canonical_present", T.BooleanType()), T.StructField("has_viewport_meta", T.BooleanType()), T.StructField("schema_markup_present", T.BooleanType()),
    T.StructField("h1_count", T.IntegerType()), T.StructField("h2_count", T.IntegerType()), T.StructField("has_phone_link", T.BooleanType()),
    T.StructField("has_whatsapp_link", T.BooleanType()), T.StructField("has_contact_form", T.BooleanType()),
    T.StructField("cta_mentions_count", T.IntegerType()), T.StructField("has_testimonials_section", T.BooleanType()),
])
