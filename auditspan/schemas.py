"""Schemas of the input and output tables."""
from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
_STRINGS = T.ArrayType(_S)

# One stored fetch per row, in crawl order within the site.
CRAWL = _struct(
    page_ord=_L, url=_S, status_code=_I, content_type=_S, html=_S, cookies=_STRINGS,
    pdf_text=_S, pdf_method=_S, is_fallback=_B)

REQUEST_LOG = _struct(page_ord=_L, page_url=_S, request_url=_S)

CHECKLIST = _struct(
    id=_S, category=_S, title=_S, description=_S, severity=_S, law_reference=_S,
    recommendation=_S, fine_reference=_S, method=_S)
PROHIBITED_SERVICES = _struct(
    name=_S, domains=_STRINGS, type=_S, alternative=_S, description=_S, fine_reference=_S)
FINES = _struct(
    id=_S, violation=_S, law_reference=_S, first_offense_min=_L, first_offense_max=_L,
    repeat_offense_max=_L, notes=_S)
LEGAL_UPDATES = _struct(
    id=_S, date=_S, effective_date=_S, source=_S, source_url=_S, title=_S, summary=_S,
    articles=_STRINGS, affected_documents=_STRINGS, requirements=_STRINGS, severity=_S,
    category=_S)
TRACKERS = _struct(name=_S, domains=_STRINGS, keywords=_STRINGS, is_foreign=_B)

SNAPSHOTS = _struct(
    id=_L, source_id=_S, url=_S, content_hash=_S, raw_text=_S, fetch_status=_S, captured_at=_TS)
CHANGES = _struct(
    id=_L, source_id=_S, url=_S, diff_summary=_S, change_type=_S, threat_score=_I,
    npa_critical=_B, detected_at=_TS)
DIGESTS = _struct(id=_L, period_start=_S, period_end=_S, content_md=_S, created_at=_TS)
WATCHED_SOURCES = _struct(
    source_id=_S, name=_S, kind=_S, url=_S, source_type=_S, js_render=_B, llm_analyze=_B,
    npa_critical=_B, keywords=_STRINGS, watch=_STRINGS)

ORGANIZATION_LISTS = (
    "data_categories", "processing_purposes", "data_subjects", "third_parties",
    "cross_border_countries", "info_systems")
ORGANIZATIONS = _struct(
    id=_S, legal_name=_S, short_name=_S, inn=_S, ogrn=_S, legal_address=_S, actual_address=_S,
    ceo_name=_S, ceo_position=_S, responsible_person=_S, responsible_contact=_S,
    website_url=_S, email=_S, phone=_S, data_categories=_STRINGS,
    processing_purposes=_STRINGS, data_subjects=_STRINGS, third_parties=_STRINGS,
    cross_border=_B, cross_border_countries=_STRINGS, hosting_location=_S,
    info_systems=_STRINGS, created_at=_TS, updated_at=_TS)
DOCUMENTS = _struct(
    id=_S, organization_id=_S, doc_type=_S, title=_S, version=_I, content_md=_S,
    created_at=_TS, updated_at=_TS)
REPORTS = _struct(
    id=_S, scan_id=_S, organization_id=_S, site_url=_S, report_date=_TS, overall_score=_I,
    risk_level=_S, total_checks=_I, passed_checks=_I, failed_checks=_I, report_json=_S,
    summary=_S)
