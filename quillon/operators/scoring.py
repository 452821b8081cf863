"""Scores of businesses as column expressions over all of them at once.

Input rows are businesses with the columns of their latest scan; ``scanned``
says whether there is one. Every expression is built-in, so a score costs one
projection. Null signals count as not true, and a website that is null or empty
as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.checks import Check, blank, clamp, not_true, number, points, reasons, triggered
from quillon.operators.latest import latest
from quillon.schemas import HIGH_VALUE_SECTORS, LEAD_WEIGHTS, OPPORTUNITY_WEIGHTS

# Points, limits and wording of the checks.
NO_WEBSITE, UNSCANNED = "No se ha detectado ninguna web", "Web sin analizar todavía"
LOCAL_NOTE = "Señal limitada: análisis completo de Google Business Profile pendiente (Fase 4)"
GAP_NOTE = "Sin datos de competencia todavía (Fase 4 pendiente, requiere Google Places API)"
VIEWPORT_NOTE = "Sin meta viewport — probablemente no responsive"


def website_checks() -> list[Check]:
    missing_alt = F.when(number("image_count") > 0, number("images_missing_alt") / number("image_count")).otherwise(0.0)
    return [
        Check(not_true("https"), 30, "La web no usa HTTPS"),
        Check(not_true("schema_markup_present"), 15, "Sin datos estructurados (schema.org)"),
        Check(not_true("robots_txt_present"), 10, "Sin robots.txt"),
        Check(not_true("sitemap_present"), 10, "Sin sitemap.xml"),
        Check(not_true("canonical_present"), 10, "Sin URL canónica"),
        Check(missing_alt > 0.3, 15, "Muchas imágenes sin texto alternativo"),
        Check(number("html_size_bytes") > 3_000_000, 10, "Página muy pesada (>3MB)"),
    ]


def seo_checks() -> list[Check]:
    title, meta = number("title_length"), number("meta_description_length")
    return [
        Check(blank("title"), 20, "Sin meta title"),
        Check(~blank("title") & ~title.between(10, 65), 10, "Title poco optimizado (longitud)"),
        Check(blank("meta_description"), 20, "Sin meta description"),
        Check(~blank("meta_description") & ~meta.between(50, 160), 10, "Meta description poco optimizada (longitud)"),
        Check(number("h1_count") != 1, 15, "Estructura de H1 incorrecta (0 o más de 1)"),
        Check(number("word_count_estimate") < 300, 15, "Contenido escaso (menos de 300 palabras)"),
        Check(number("internal_link_count") < 3, 10, "Enlazado interno débil"),
    ]


def local_checks() -> list[Check]:
    return [
        Check(blank("gbp_place_id"), 40, "Sin ficha de Google Business Profile detectada"),
        Check(number("review_count") == 0, 30, "Sin reseñas registradas"),
        Check(F.coalesce(F.col("rating") < 4.0, F.lit(False)), 20, "Valoración media por debajo de 4.0"),
    ]


def conversion_checks() -> list[Check]:
    return [
        Check(not_true("has_phone_link"), 15, "Sin enlace de teléfono directo (tel:)"),
        Check(not_true("has_whatsapp_link"), 10, "Sin enlace de WhatsApp"),
        Check(not_true("has_contact_form"), 25, "Sin formulario de contacto"),
        Check(number("cta_mentions_count") == 0, 25, "Sin llamadas a la acción claras"),
        Check(not_true("has_testimonials_section"), 15, "Sin sección de testimonios/reseñas"),
    ]


def intent_checks() -> list[Check]:
    scanned = F.col("scanned")
    no_contact = not_true("has_phone_link") & not_true("has_whatsapp_link") & not_true("has_contact_form")
    famous = (number("review_count") > 50) & (not_true("https") | blank("title"))
    return [
        Check(blank("website_url"), 35, "No tiene web"),
        Check(scanned & not_true("https"), 10, "La web no usa HTTPS"),
        Check(scanned & (blank("title") | blank("meta_description")), 10, "SEO on-page muy pobre (sin title o sin meta description)"),
        Check(scanned & no_contact, 15, "Sin ninguna vía de contacto clara (teléfono, WhatsApp o formulario)"),
        Check(scanned & not_true("has_viewport_meta"), 10, "Web no responsive (sin viewport)"),
        Check(scanned & famous, 15, "Muchas reseñas pero presencia web deficiente — reputación offline desaprovechada online"),
        Check(F.coalesce(F.col("sector").isin(HIGH_VALUE_SECTORS), F.lit(False)), 5, "Sector de alto valor por cliente"),
    ]


def _guarded(value: Column, why: Column, limited: Column | bool) -> Column:
    """Without a website 100, without a scan 50; else as given."""
    limited = limited if isinstance(limited, Column) else F.lit(limited)
    sub = lambda v, r, x: F.struct(v.cast("double").alias("value"), r.alias("reasons"), x.alias("limited"))
    return (
        F.when(blank("website_url"), sub(F.lit(100.0), F.array(F.lit(NO_WEBSITE)), F.lit(False)))
        .when(~F.col("scanned"), sub(F.lit(50.0), F.array(F.lit(UNSCANNED)), F.lit(True)))
        .otherwise(sub(value, why, limited))
    )


def _performance() -> Column:
    lighthouse, ms = F.col("lighthouse_performance_score"), number("server_response_time_ms")
    known = lighthouse.isNotNull()
    value = F.when(known, clamp(100.0 - lighthouse)).otherwise(clamp((ms - 300) / 20.0))
    none = F.array().cast("array<string>")
    why = (
        F.when(known & (value > 40), F.array(F.concat(F.lit("Puntuación Lighthouse de rendimiento: "), lighthouse.cast("string"), F.lit("/100"))))
        .when(~known & (value > 30), F.array(F.concat(F.lit("Tiempo de respuesta del servidor elevado ("), ms.cast("string"), F.lit("ms, proxy aproximado)"))))
        .otherwise(none)
    )
    return _guarded(value, why, ~known)


def sub_scores() -> dict[str, Column]:
    """struct<value, reasons, limited> by name, in the order of the weights."""
    plain = lambda checks: _guarded(points(checks), reasons(checks), False)
    mobile = F.col("has_viewport_meta").eqNullSafe(F.lit(True))
    local = F.struct(points(local_checks()).alias("value"), F.concat(reasons(local_checks()), F.array(F.lit(LOCAL_NOTE))).alias("reasons"), F.lit(True).alias("limited"))
    gap = F.struct(F.lit(50.0).alias("value"), F.array(F.lit(GAP_NOTE)).alias("reasons"), F.lit(True).alias("limited"))
    return {
        "website_quality": plain(website_checks()),
        "seo": plain(seo_checks()),
        "local_seo": local,
        "performance": _performance(),
        "mobile_ux": _guarded(F.when(mobile, 15.0).otherwise(70.0), F.when(mobile, F.array().cast("array<string>")).otherwise(F.array(F.lit(VIEWPORT_NOTE))), True),
        "conversion": plain(conversion_checks()),
        "competitive_gap": gap,
    }


def weighted(values: dict[str, Column], weights: dict[str, float | Column]) -> Column:
    """Rounded, clamped sum of products in the order of the values; a value without weight counts nothing. Weights are numbers or columns."""
    total = F.lit(0.0)
    for name, v in values.items():
        w = weights.get(name, 0.0)
        total = total + (F.coalesce(w, F.lit(0.0)) if isinstance(w, Column) else F.lit(float(w))) * v
    return F.round(clamp(total)).cast("long")


def business_value() -> Column:
    reviews = clamp(number("review_count") / F.lit(500.0) * F.lit(70.0))
    rating = F.coalesce(F.col("rating") / F.lit(5.0) * F.lit(30.0), F.lit(0.0))
    return F.round(clamp(reviews + rating)).cast("long")


def scoring_input(businesses: DataFrame, scans: DataFrame) -> DataFrame:
    """Businesses with the columns of their latest scan and ``scanned``."""
    own = latest(scans, "business_id", "scanned_at").withColumnRenamed("id", "scan_id")
    joined = businesses.join(own, businesses["id"] == own["business_id"], "left").drop("business_id")
    return joined.withColumn("scanned", F.col("scan_id").isNotNull())


def score(rows: DataFrame, opportunity: dict[str, float | Column] = OPPORTUNITY_WEIGHTS, lead: dict[str, float | Column] = LEAD_WEIGHTS) -> DataFrame:
    """Adds the sub-scores (structs), opportunity_score, buying_intent_score, business_value, lead_score and intent_signals."""
    subs = sub_scores()
    out = rows.select("*", *[c.alias(f"sub_{n}") for n, c in subs.items()])
    out = out.withColumn("opportunity_score", weighted({n: F.col(f"sub_{n}.value") for n in subs}, opportunity))
    out = out.withColumn("buying_intent_score", F.round(points(intent_checks())).cast("long"))
    out = out.withColumn("intent_signals", triggered(intent_checks())).withColumn("business_value", business_value())
    parts = {"opportunity": F.col("opportunity_score"), "buying_intent": F.col("buying_intent_score"), "business_value": F.col("business_value"), "competitive_gap": F.col("sub_competitive_gap.value")}
    return out.withColumn("lead_score", weighted(parts, lead))


def score_row(scored: DataFrame, opportunity: dict[str, float] = OPPORTUNITY_WEIGHTS, lead: dict[str, float] = LEAD_WEIGHTS) -> DataFrame:
    """The record that is stored: scores, breakdowns as maps, and the weights they were made with."""
    values = F.create_map(*[x for n in OPPORTUNITY_WEIGHTS for x in (F.lit(n), F.col(f"sub_{n}.value"))])
    leads = F.create_map(
        F.lit("opportunity"), F.col("opportunity_score").cast("double"), F.lit("buying_intent"), F.col("buying_intent_score").cast("double"),
        F.lit("business_value"), F.col("business_value").cast("double"), F.lit("competitive_gap"), F.col("sub_competitive_gap.value"),
    )
    weights = F.struct(F.struct(*[F.lit(v).alias(k) for k, v in opportunity.items()]).alias("opportunity"), F.struct(*[F.lit(v).alias(k) for k, v in lead.items()]).alias("lead_score"))
    return scored.select(
        F.col("id").alias("business_id"), "opportunity_score", values.alias("opportunity_breakdown"), "buying_intent_score",
        F.map_from_entries("intent_signals").alias("buying_intent_breakdown"), "lead_score", leads.alias("lead_score_breakdown"), weights.alias("weights_snapshot"),
    )


# Lower bounds, names and tones of the priority buckets.
BUCKETS = [(86, "Prioridad máxima", "critical"), (71, "Muy alta", "serious"), (51, "Alta", "warning"), (31, "Moderada", "accent")]
LOWEST = ("Baja", "neutral")


def bucket(value: Column, part: int = 0) -> Column:
    """Name (0) or tone (1) of the bucket of a score; null is the lowest."""
    out = None
    for least, *names in BUCKETS:
        out = F.when(value >= least, names[part]) if out is None else out.when(value >= least, names[part])
    return out.otherwise(LOWEST[part])
