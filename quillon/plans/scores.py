"""Scores of all businesses, part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import scoring
from quillon.plans.oracle import sql
from quillon.plans.registry import query
from quillon.sources import tables as t


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(scoring.scoring_input(t.businesses(spark, d), t.website_scans(spark, d)))


def _p(condition: str, points: int) -> str:
    return f"CASE WHEN {condition} THEN {points} ELSE 0 END"


_NO = lambda c: f"{c} IS DISTINCT FROM TRUE"
_SITE = "coalesce(website_url, '') = ''"
_INPUT = "\n  SELECT b.*, s.id AS scan_id, s.id IS NOT NULL AS scanned, s.* EXCLUDE (id, business_id) FROM businesses b LEFT JOIN latest_scans s ON b.id = s.business_id"
_WEBSITE = [(_NO("https"), 30, "La web no usa HTTPS"), (_NO("schema_markup_present"), 15, "Sin datos estructurados (schema.org)"), (_NO("robots_txt_present"), 10, "Sin robots.txt"), (_NO("sitemap_present"), 10, "Sin sitemap.xml"), (_NO("canonical_present"), 10, "Sin URL canónica"), ("image_count > 0 AND images_missing_alt::DOUBLE / image_count > 0.3::DOUBLE", 15, "Muchas imágenes sin texto alternativo"), ("html_size_bytes > 3000000", 10, "Página muy pesada (>3MB)")]
_SEO = [("coalesce(title, '') = ''", 20, "Sin meta title"), ("coalesce(title, '') <> '' AND (title_length < 10 OR title_length > 65)", 10, "Title poco optimizado (longitud)"), ("coalesce(meta_description, '') = ''", 20, "Sin meta description"), ("coalesce(meta_description, '') <> '' AND (meta_description_length < 50 OR meta_description_length > 160)", 10, "Meta description poco optimizada (longitud)"), ("coalesce(h1_count, 0) <> 1", 15, "Estructura de H1 incorrecta (0 o más de 1)"), ("coalesce(word_count_estimate, 0) < 300", 15, "Contenido escaso (menos de 300 palabras)"), ("coalesce(internal_link_count, 0) < 3", 10, "Enlazado interno débil")]
_LOCAL = [("coalesce(gbp_place_id, '') = ''", 40, "Sin ficha de Google Business Profile detectada"), ("coalesce(review_count, 0) = 0", 30, "Sin reseñas registradas"), ("rating < 4.0", 20, "Valoración media por debajo de 4.0")]
_CONVERSION = [(_NO("has_phone_link"), 15, "Sin enlace de teléfono directo (tel:)"), (_NO("has_whatsapp_link"), 10, "Sin enlace de WhatsApp"), (_NO("has_contact_form"), 25, "Sin formulario de contacto"), ("coalesce(cta_mentions_count, 0) = 0", 25, "Sin llamadas a la acción claras"), (_NO("has_testimonials_section"), 15, "Sin sección de testimonios/reseñas")]
_INTENT = [
    (_SITE, 35, "No tiene web"), (f"scanned AND {_NO('https')}", 10, "La web no usa HTTPS"),
    ("scanned AND (coalesce(title, '') = '' OR coalesce(meta_description, '') = '')", 10, "SEO on-page muy pobre (sin title o sin meta description)"),
    (f"scanned AND {_NO('has_phone_link')} AND {_NO('has_whatsapp_link')} AND {_NO('has_contact_form')}", 15, "Sin ninguna vía de contacto clara (teléfono, WhatsApp o formulario)"),
    (f"scanned AND {_NO('has_viewport_meta')}", 10, "Web no responsive (sin viewport)"),
    (f"scanned AND coalesce(review_count, 0) > 50 AND ({_NO('https')} OR coalesce(title, '') = '')", 15, "Muchas reseñas pero presencia web deficiente — reputación offline desaprovechada online"),
    ("sector IN ('Hoteles', 'Clínicas dentales', 'Restaurantes')", 5, "Sector de alto valor por cliente"),
]


def _sum(checks) -> str:
    return "least(100, " + " + ".join(_p(c, n) for c, n, _ in checks) + ")::DOUBLE"


def _guard(value: str) -> str:
    return f"CASE WHEN {_SITE} THEN 100::DOUBLE WHEN NOT scanned THEN 50::DOUBLE ELSE {value} END"


_PERF = "CASE WHEN lighthouse_performance_score IS NOT NULL THEN greatest(0, least(100, 100 - lighthouse_performance_score))::DOUBLE ELSE greatest(0::DOUBLE, least(100::DOUBLE, (coalesce(server_response_time_ms, 0) - 300)::DOUBLE / 20)) END"
_SUBS = (
    f"\n  SELECT *, {_guard(_sum(_WEBSITE))} AS v_website_quality, {_guard(_sum(_SEO))} AS v_seo, {_sum(_LOCAL)} AS v_local_seo, {_guard(_PERF)} AS v_performance,"
    f" {_guard('CASE WHEN has_viewport_meta IS NOT DISTINCT FROM TRUE THEN 15::DOUBLE ELSE 70::DOUBLE END')} AS v_mobile_ux, {_guard(_sum(_CONVERSION))} AS v_conversion, 50::DOUBLE AS v_competitive_gap FROM input"
)
_D = lambda x: f"{x}::DOUBLE"
_OPP = " + ".join(f"{w}::DOUBLE * v_{n}" for n, w in (("website_quality", 0.2), ("seo", 0.2), ("local_seo", 0.15), ("performance", 0.1), ("mobile_ux", 0.1), ("conversion", 0.15), ("competitive_gap", 0.1)))
_ALL = (
    f"\n  SELECT *, CAST(round(greatest(0, least(100, 0::DOUBLE + {_OPP}))) AS BIGINT) AS opportunity_score, CAST({_sum(_INTENT)} AS BIGINT) AS buying_intent_score,"
    " CAST(round(least(100, least(100, coalesce(review_count, 0)::DOUBLE / 500::DOUBLE * 70::DOUBLE) + coalesce(rating / 5::DOUBLE * 30::DOUBLE, 0))) AS BIGINT) AS business_value FROM subs"
)
_LEAD = "\n  SELECT *, CAST(round(greatest(0, least(100, 0.35::DOUBLE * opportunity_score + 0.35::DOUBLE * buying_intent_score + 0.15::DOUBLE * business_value + 0.15::DOUBLE * 50))) AS BIGINT) AS lead_score FROM scored"


def _sql(body: str) -> str:
    return sql(body, "businesses", "latest_scans", input=_INPUT, subs=_SUBS, scored=_ALL, led=_LEAD)


def with_led(body: str) -> str:
    """A query over ``led``: businesses with their sub-scores as v_<name>, and all scores."""
    return _sql(body)


def _sub_query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return scored(spark, d).select("id", F.col(f"sub_{name}.value").alias("value"), F.col(f"sub_{name}.limited").alias("limited"))

    limited = {
        "local_seo": "TRUE", "competitive_gap": "TRUE", "mobile_ux": f"NOT ({_SITE})",
        "performance": f"NOT ({_SITE}) AND (NOT scanned OR lighthouse_performance_score IS NULL)",
    }.get(name, f"NOT ({_SITE}) AND NOT scanned")
    run.__name__ = f"score_{name}"
    query(_sql(f"SELECT id, v_{name} AS value, {limited} AS limited FROM led"))(run)


for _n in ("website_quality", "seo", "local_seo", "performance", "mobile_ux", "conversion", "competitive_gap"):
    _sub_query(_n)


@query(_sql("SELECT id, opportunity_score FROM led"))
def score_opportunity(spark, d):
    return scored(spark, d).select("id", "opportunity_score")


@query(_sql("SELECT id, buying_intent_score FROM led"))
def score_buying_intent(spark, d):
    return scored(spark, d).select("id", "buying_intent_score")


@query(_sql("SELECT id, business_value FROM led"))
def score_business_value(spark, d):
    return scored(spark, d).select("id", "business_value")


@query(_sql("SELECT id, lead_score FROM led"))
def score_lead(spark, d):
    return scored(spark, d).select("id", "lead_score")


@query(_sql("""SELECT id, CASE WHEN lead_score >= 86 THEN 'Prioridad máxima' WHEN lead_score >= 71 THEN 'Muy alta' WHEN lead_score >= 51 THEN 'Alta' WHEN lead_score >= 31 THEN 'Moderada' ELSE 'Baja' END AS bucket,
  CASE WHEN lead_score >= 86 THEN 'critical' WHEN lead_score >= 71 THEN 'serious' WHEN lead_score >= 51 THEN 'warning' WHEN lead_score >= 31 THEN 'accent' ELSE 'neutral' END AS tone FROM led"""))  # fmt: skip
def score_bucket(spark, d):
    return scored(spark, d).select("id", scoring.bucket(F.col("lead_score")).alias("bucket"), scoring.bucket(F.col("lead_score"), 1).alias("tone"))


_NAMES = ("website_quality", "seo", "local_seo", "performance", "mobile_ux", "conversion", "competitive_gap")


@query(_sql(f"SELECT id, unnest([{', '.join(repr(n) for n in _NAMES)}]) AS part, unnest([{', '.join('v_' + n for n in _NAMES)}]) AS value FROM led"))
def score_breakdown(spark, d):
    return scoring.score_row(scored(spark, d)).select(F.col("business_id").alias("id"), F.explode("opportunity_breakdown").alias("part", "value"))


def _reasons(checks) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, _, r in checks) + "], lambda x: x IS NOT NULL)"


def _guarded_reasons(value: str) -> str:
    return f"CASE WHEN {_SITE} THEN ['No se ha detectado ninguna web'] WHEN NOT scanned THEN ['Web sin analizar todavía'] ELSE {value} END"


_PERF_REASON = f"""CASE WHEN lighthouse_performance_score IS NOT NULL THEN CASE WHEN v_performance > 40 THEN ['Puntuación Lighthouse de rendimiento: ' || lighthouse_performance_score || '/100'] ELSE [] END
  WHEN v_performance > 30 THEN ['Tiempo de respuesta del servidor elevado (' || server_response_time_ms || 'ms, proxy aproximado)'] ELSE [] END"""
_REASONS = {
    "website_quality": _guarded_reasons(_reasons(_WEBSITE)), "seo": _guarded_reasons(_reasons(_SEO)),
    "local_seo": f"list_concat({_reasons(_LOCAL)}, ['{scoring.LOCAL_NOTE}'])", "performance": _guarded_reasons(_PERF_REASON),
    "mobile_ux": _guarded_reasons(f"CASE WHEN has_viewport_meta IS NOT DISTINCT FROM TRUE THEN [] ELSE ['{scoring.VIEWPORT_NOTE}'] END"),
    "conversion": _guarded_reasons(_reasons(_CONVERSION)), "competitive_gap": f"['{scoring.GAP_NOTE}']",
}


@query(_sql(" UNION ALL ".join(f"SELECT id, '{n}' AS part, array_to_string({r}, ' | ') AS reasons FROM led" for n, r in _REASONS.items())))
def score_reasons(spark, d):
    """Why each part of the score is what it is, in order."""
    rows = scored(spark, d)
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.array_join(F.col(f"sub_{n}.reasons"), " | ").alias("reasons")) for n in _NAMES])
    return rows.select("id", F.explode(parts).alias("p")).select("id", "p.part", "p.reasons")


@query(_sql(" UNION ALL ".join(f"SELECT id, '{r}' AS label, {n} AS weight FROM led WHERE {c}" for c, n, r in _INTENT)))
def intent_signals(spark, d):
    return scored(spark, d).select("id", F.explode("intent_signals").alias("s")).select("id", "s.label", "s.weight")


@query(_sql("SELECT id, 0.35 AS opportunity_weight, 0.2 AS website_weight, CAST(opportunity_score AS DOUBLE) AS opportunity, CAST(buying_intent_score AS DOUBLE) AS buying_intent, CAST(business_value AS DOUBLE) AS business_value FROM led").replace("0.35 AS", "0.35::DOUBLE AS").replace("0.2 AS", "0.2::DOUBLE AS"))
def score_snapshot(spark, d):
    """The stored record: breakdown of the lead score and the weights it was made with."""
    rows = scoring.score_row(scored(spark, d))
    return rows.select(
        F.col("business_id").alias("id"), F.col("weights_snapshot.lead_score.opportunity").alias("opportunity_weight"), F.col("weights_snapshot.opportunity.website_quality").alias("website_weight"),
        *[F.col("lead_score_breakdown")[k].alias(k) for k in ("opportunity", "buying_intent", "business_value")],
    )
