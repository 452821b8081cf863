"""The derived relations as DuckDB SQL, for checking queries against."""

from __future__ import annotations

from quillon.schemas import STAGE_LABELS, STAGES
from quillon.sources.tables import TEST_PRICING

_STAGE_ROWS = ", ".join(f"({i}, '{s}', '{n}')" for i, (s, n) in enumerate(zip(STAGES, STAGE_LABELS, strict=True)))
_STAGE_LIST = ", ".join(f"'{s}'" for s in STAGES)

CTES: dict[str, str] = {
    "businesses": """
  SELECT c_custkey AS id, c_custkey % 3 AS owner_id, c_name AS name,
    CASE c_mktsegment WHEN 'FURNITURE' THEN 'Restaurantes' WHEN 'MACHINERY' THEN 'Hoteles' WHEN 'HOUSEHOLD' THEN 'Clínicas dentales'
      WHEN 'BUILDING' THEN 'Peluquerías' WHEN 'AUTOMOBILE' THEN 'Talleres' END AS sector,
    CASE WHEN c_custkey % 6 <> 0 THEN lower(c_mktsegment) END AS category, n_name AS city, r_name AS region, 'España' AS country,
    '+34' || CAST(c_custkey + 600000000 AS VARCHAR) AS phone,
    CASE WHEN c_custkey % 5 <> 0 THEN 'https://b' || CAST(c_custkey AS VARCHAR) || '.example' END AS website_url,
    CASE WHEN c_custkey % 3 <> 0 THEN 'place-' || CAST(c_custkey AS VARCHAR) END AS gbp_place_id,
    CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey * 7 % 51 AS DOUBLE) / 10 END AS rating,
    CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey * 37 % 800 AS INTEGER) END AS review_count
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "scores": """
  SELECT o_orderkey AS id, o_custkey AS business_id, o_orderdate AS computed_at, o_orderkey * 31 % 101 AS opportunity_score,
    o_orderkey * 17 % 101 AS buying_intent_score, CAST(floor(o_totalprice) AS BIGINT) % 101 AS lead_score FROM orders""",
    "website_scans": """
  SELECT o_orderkey AS id, o_custkey AS business_id, o_orderdate AS scanned_at,
    CASE WHEN m % 13 <> 0 THEN m % 3 <> 0 END AS https, m % 4 = 0 AS schema_markup_present, m % 5 <> 0 AS robots_txt_present,
    m % 5 < 3 AS sitemap_present, m % 7 < 3 AS canonical_present, m % 6 <> 0 AS has_viewport_meta, m % 23 AS image_count,
    (m % 23) * (m % 10) // 10 AS images_missing_alt, m * 7919 % 5000000 AS html_size_bytes,
    CASE WHEN m % 17 <> 0 THEN repeat('t', CAST(m % 80 + 1 AS INTEGER)) END AS title, CASE WHEN m % 17 = 0 THEN 0 ELSE m % 80 + 1 END AS title_length,
    CASE WHEN m % 6 <> 1 THEN repeat('d', CAST(m * 3 % 200 + 1 AS INTEGER)) END AS meta_description,
    CASE WHEN m % 6 = 1 THEN 0 ELSE m * 3 % 200 + 1 END AS meta_description_length,
    m % 3 AS h1_count, m * 37 % 900 AS word_count_estimate, m % 9 AS internal_link_count, m % 2 = 0 AS has_phone_link, m % 3 = 0 AS has_whatsapp_link,
    m % 4 <> 0 AS has_contact_form, m % 4 AS cta_mentions_count, m % 5 = 0 AS has_testimonials_section,
    CASE WHEN m % 2 = 0 THEN m % 101 END AS lighthouse_performance_score, m * 53 % 3000 AS server_response_time_ms
  FROM (SELECT *, o_orderkey // 2 AS m FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 9 <> 0)""",
    "leads": f"""
  SELECT c_custkey AS id, c_custkey AS business_id, stage, c_acctbal AS value_estimate, CASE WHEN stage = 'WON' THEN c_acctbal END AS value_won
  FROM (SELECT *, [{_STAGE_LIST}][c_custkey // 2 % 12 + 1] AS stage FROM customer WHERE c_custkey % 2 = 0)""",
    "lead_activities": """
  SELECT event_id AS id, user_id * 2 AS lead_id, CASE event_type WHEN 'signup' THEN 'stage_change' WHEN 'click' THEN 'note' WHEN 'view' THEN 'call'
    WHEN 'purchase' THEN 'email' WHEN 'error' THEN 'meeting' END AS type, event_type AS description, ts AS created_at FROM events""",
    "api_usage": """
  SELECT event_id AS id, ['anthropic', 'google_places', 'google_pagespeed'][user_id % 3 + 1] AS service, event_type AS operation, user_id AS business_id,
    CAST(floor(value) AS INTEGER) AS units, CAST(floor(value * 100) AS BIGINT) AS cost_units, ts AS created_at FROM events""",
    "jobs": """
  SELECT event_id AS id, event_id // 4 AS job_id, event_id // 4 % 3 AS owner_id, CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'RUNNING'
    WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS status, CAST(event_id % 7 AS INTEGER) AS progress_current,
    CAST(event_id % 5 AS INTEGER) AS progress_total, ts AS created_at FROM events""",
    "proposals": """
  SELECT o_orderkey AS id, o_custkey AS business_id, services,
    CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'sent' ELSE 'accepted' END AS status, o_orderdate AS created_at
  FROM orders JOIN (SELECT l_orderkey, list_sort(list(DISTINCT p_type)) AS services FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON o_orderkey = l_orderkey""",
    "demos": """
  SELECT o_orderkey AS id, o_custkey AS business_id, ['draft', 'ready', 'published'][o_orderkey % 9 // 3 + 1] AS status,
    CASE WHEN o_orderkey % 2 = 0 THEN '{"copy":{"headline":"Demo ' || CAST(o_orderkey AS VARCHAR) || '"}}' ELSE '{}' END AS content, o_orderdate AS created_at
  FROM orders WHERE o_orderkey % 3 = 0""",
    "ai_reports": """
  SELECT o_orderkey AS id, o_custkey AS business_id, ['standard', 'large', 'small', 'unlisted'][o_orderkey % 4 + 1] AS model,
    o_orderkey * 13 % 5000 AS input_tokens, o_orderkey * 7 % 3000 AS output_tokens, o_orderdate AS generated_at FROM orders WHERE o_orderkey % 5 = 0""",
    "websites": """
  SELECT c_custkey AS id, c_custkey AS business_id, 'https://b' || c_custkey || '.example' AS url FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 = 1""",
    "seo_audits": "\n  SELECT o_orderkey AS id, o_custkey AS business_id FROM orders WHERE o_orderkey % 6 = 0 AND o_custkey % 9 <> 0",
    "local_audits": "\n  SELECT c_custkey AS id, c_custkey AS business_id FROM customer WHERE c_custkey % 3 <> 0",
    "competitors": "\n  SELECT s_suppkey AS id, s_suppkey * 2 + 1 AS business_id, s_name AS competitor_name FROM supplier",
    "stages": f"\n  SELECT * FROM (VALUES {_STAGE_ROWS}) AS s(ord, stage, label)",
    "prices": "\n  SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in TEST_PRICING.items()) + ") AS p(service, price)",
}


def latest(name: str, at: str, key: str = "business_id") -> str:
    return f"\n  SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC, id DESC) = 1"


LATEST = {
    "latest_scores": ("scores", "computed_at"), "latest_scans": ("website_scans", "scanned_at"), "latest_reports": ("ai_reports", "generated_at"),
    "latest_proposals": ("proposals", "created_at"), "latest_demos": ("demos", "created_at"),
}


def sql(body: str, *needs: str, **more: str) -> str:
    """A query over derived relations, named in ``needs``, and further ones."""
    parts: dict[str, str] = {}
    for n in needs:
        if n in LATEST:
            table, at = LATEST[n]
            parts.setdefault(table, CTES[table])
            parts[n] = latest(table, at)
        else:
            parts.setdefault(n, CTES[n])
    parts |= more
    head = "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n" if parts else ""
    return head + body.strip() + "\n"
