"""The built-in dimension tables as the files a user would supply.

Each table is written once per session as one JSON array in the shared folder;
the queries read it through the same readers as a user's own file.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspan import schemas
from auditspan.knowledge import fixed_values as fixed
from auditspan.localtable import local_table
from auditspan.session import scratch_path
from auditspan.sources import dimensions

_WRITTEN: dict = {}


def _file(spark: SparkSession, name: str, make) -> str:
    key = (spark.sparkContext.applicationId, name)
    if key not in _WRITTEN:
        path = scratch_path(spark, name)
        rows: DataFrame = make()
        # a few dozen hand-written rows
        rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def checklist(spark: SparkSession) -> DataFrame:
    return dimensions.checklist(spark, _file(spark, "checklist", lambda: dimensions.checklist(spark)))


def fines(spark: SparkSession) -> DataFrame:
    return dimensions.fines(spark, _file(spark, "fines", lambda: dimensions.fines(spark)))


def prohibited_services(spark: SparkSession) -> DataFrame:
    """The built-in services, after a hundred more that no page uses."""
    def rows() -> DataFrame:
        own = [(name, list(domains), kind, None, None, fine) for name, kind, fine, domains in fixed.PROHIBITED_SERVICES]
        more = [(f"Service {i}", [f"service{i}.invalid"], "other", None, None, None) for i in range(100)]
        return local_table(spark, more + own, schemas.PROHIBITED_SERVICES).coalesce(1)
    return dimensions.prohibited_services(spark, _file(spark, "services", rows))


#: services and trackers that no built-in registry has, between hundreds that no page uses
OWN_SERVICES = (("Segment", "FS-007", ("cookiebot.com",)), ("Hotjar", "FS-007", ("yandex.ru", "tawk")), ("Intercom", None, ("gstatic",)))
OWN_TRACKERS = (("Cookiebot", ("cookiebot.com",), ("куки", "cookie"), False), ("Gstatic", ("gstatic.com", "googleapis.com"), ("gstatic",), True),
                ("Analytics", ("google-analytics.com", "not-google-analytics.com"), ("GOOGLE anal",), True), ("Карты", ("www.google.com",), (), True))
MANY_SERVICES = [*((f"Service {i}", None, (f"service{i}.invalid",)) for i in range(500)), *OWN_SERVICES]
MANY_TRACKERS = [*((f"Tracker {i}", (f"t{i}.invalid", f"x.t{i}.invalid"), (f"word{i}",), i % 2 == 0) for i in range(500)), *OWN_TRACKERS]


def many_services(spark: SparkSession) -> DataFrame:
    def rows() -> DataFrame:
        return local_table(spark, [(name, list(domains), "other", None, None, fine) for name, fine, domains in MANY_SERVICES],
                           schemas.PROHIBITED_SERVICES).coalesce(1)
    return dimensions.prohibited_services(spark, _file(spark, "many-services", rows))


def many_trackers(spark: SparkSession) -> DataFrame:
    def rows() -> DataFrame:
        return local_table(spark, [(n, list(d), list(k), f) for n, d, k, f in MANY_TRACKERS], schemas.TRACKERS).coalesce(1)
    return dimensions.trackers(spark, _file(spark, "many-trackers", rows))


def legal_updates(spark: SparkSession) -> DataFrame:
    def rows() -> DataFrame:
        known = dimensions.legal_updates(spark)
        return known.withColumns({c: F.col(c).cast("string") for c in ("date", "effective_date")})
    return dimensions.legal_updates(spark, _file(spark, "updates", rows))
