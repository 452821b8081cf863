import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import scoring
from quillon.schemas import LEAD_WEIGHTS, OPPORTUNITY_WEIGHTS

BUSINESS = "id string, website_url string, gbp_place_id string, rating double, review_count int, sector string"
SCAN = (
    "scanned boolean, https boolean, schema_markup_present boolean, robots_txt_present boolean, sitemap_present boolean, canonical_present boolean, image_count int, images_missing_alt int, html_size_bytes int, "
    "has_viewport_meta boolean, title string, title_length int, meta_description string, meta_description_length int, h1_count int, word_count_estimate int, internal_link_count int, has_phone_link boolean, "
    "has_whatsapp_link boolean, has_contact_form boolean, cta_mentions_count int, has_testimonials_section boolean, lighthouse_performance_score int, server_response_time_ms int"
)
GOOD = {
    "scanned": True, "https": True, "schema_markup_present": True, "robots_txt_present": True, "sitemap_present": True, "canonical_present": True, "image_count": 10, "images_missing_alt": 0,
    "html_size_bytes": 500000, "has_viewport_meta": True, "title": "t" * 38, "title_length": 38, "meta_description": "d" * 90, "meta_description_length": 90, "h1_count": 1, "word_count_estimate": 600,
    "internal_link_count": 10, "has_phone_link": True, "has_whatsapp_link": True, "has_contact_form": True, "cta_mentions_count": 3, "has_testimonials_section": True, "lighthouse_performance_score": 90,
    "server_response_time_ms": None,
}
PLAIN = {"id": "b1", "website_url": "https://example.com", "gbp_place_id": None, "rating": None, "review_count": None, "sector": None}
NONE = dict.fromkeys(GOOD) | {"scanned": False}
BAD = GOOD | {
    "https": False, "schema_markup_present": False, "robots_txt_present": False, "sitemap_present": False, "canonical_present": False, "images_missing_alt": 10, "html_size_bytes": 4_000_000,
    "has_viewport_meta": False, "title": None, "title_length": 0, "meta_description": None, "meta_description_length": 0, "h1_count": 0, "word_count_estimate": 10, "internal_link_count": 0,
    "has_phone_link": False, "has_whatsapp_link": False, "has_contact_form": False, "cta_mentions_count": 0, "has_testimonials_section": False,
}


def score(spark, rows, **kw):
    return scoring.score(spark.createDataFrame(rows, f"{BUSINESS}, {SCAN}"), **kw)


def test_golden(spark):
    rows = [
        PLAIN | NONE | {"id": "none", "website_url": None}, PLAIN | GOOD | {"id": "good"}, PLAIN | BAD | {"id": "bad"}, PLAIN | NONE | {"id": "unscanned"}, PLAIN | NONE | {"id": "blank", "website_url": ""},
    ]
    got = {r.id: r for r in score(spark, rows).collect()}
    three = lambda i: (got[i].opportunity_score, got[i].buying_intent_score, got[i].lead_score)
    assert three("none") == three("blank") == (91, 35, 52)
    assert three("good") == (18, 0, 14)
    assert three("unscanned") == (53, 0, 26)
    subs = [got["bad"][f"sub_{n}"].value for n in OPPORTUNITY_WEIGHTS]
    assert subs == [100, 80, 70, 10, 70, 90, 50] and three("bad") == (73, 45, 49)
    assert got["unscanned"].sub_seo.reasons == [scoring.UNSCANNED] and got["unscanned"].sub_seo.limited
    assert got["none"].sub_seo.reasons == [scoring.NO_WEBSITE] and not got["none"].sub_seo.limited


def test_reviews_and_sector_signals(spark):
    rows = [PLAIN | GOOD | {"review_count": 200, "https": False, "title": None, "sector": "Hoteles", "rating": 4.0}]
    got = score(spark, rows).first()
    assert {s.weight for s in got.intent_signals} == {10, 15, 5} and got.buying_intent_score == 10 + 10 + 15 + 5
    assert got.business_value == 52


def test_a_weight_of_zero_removes_influence(spark):
    weights = OPPORTUNITY_WEIGHTS | {"seo": 0.0, "website_quality": 0.4}
    rows = [PLAIN | GOOD, PLAIN | GOOD | {"title": None, "title_length": 0}]
    a, b = (r.opportunity_score for r in score(spark, rows, opportunity=weights).collect())
    assert a == b


def test_buckets(spark):
    rows = [(0.0, "Baja"), (30.0, "Baja"), (31.0, "Moderada"), (50.0, "Moderada"), (51.0, "Alta"), (70.0, "Alta"), (70.5, "Alta"), (71.0, "Muy alta"), (85.0, "Muy alta"), (86.0, "Prioridad máxima"), (100.0, "Prioridad máxima"), (None, "Baja")]
    df = spark.createDataFrame(rows, "v double, want string")
    assert df.where(scoring.bucket(F.col("v")) != F.col("want")).count() == 0


def test_stored_record(spark):
    got = scoring.score_row(score(spark, [PLAIN | BAD])).first()
    assert got.opportunity_breakdown["seo"] == 80 and sum(got.buying_intent_breakdown.values()) == 45
    assert got.weights_snapshot.lead_score.opportunity == LEAD_WEIGHTS["opportunity"] and got.lead_score_breakdown["competitive_gap"] == 50


flags = st.fixed_dictionaries({k: st.sampled_from([True, False, None]) for k, v in GOOD.items() if isinstance(v, bool) and k != "scanned"})


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(flags, min_size=10, max_size=30))
def test_scores_stay_in_range_and_flags_never_lower_them(spark, found):
    rows = [PLAIN | GOOD | f for f in found] + [PLAIN | GOOD | f | {"https": True} for f in found] + [PLAIN | GOOD | f | {"https": False} for f in found]
    got = score(spark, [r | {"id": str(i)} for i, r in enumerate(rows)]).orderBy(F.col("id").cast("int")).collect()
    assert all(0 <= r[c] <= 100 for r in got for c in ("opportunity_score", "buying_intent_score", "lead_score"))
    n = len(found)
    assert all(got[n + i].opportunity_score <= got[2 * n + i].opportunity_score for i in range(n))


@pytest.mark.parametrize("rating,reviews,want", [(None, None, 0), (5.0, 500, 100), (0.0, 0, 0), (4.2, 318, 70)])
def test_business_value(spark, rating, reviews, want):
    assert score(spark, [PLAIN | NONE | {"rating": rating, "review_count": reviews}]).first().business_value == want
