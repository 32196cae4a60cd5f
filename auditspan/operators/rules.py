"""The check list of a site, declared as expressions over its one-row facts.

42 checks per site, in emission order.  A check is a status expression and a
detail text; a violation is a row for a failed check, except for the two form
checks that report every offending form.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed

PASS, FAIL, WARNING = "pass", "fail", "warning"
NA, REVIEW, MANUAL = "not_applicable", "manual_review_needed", "manual_check"


@dataclass(frozen=True)
class Check:
    id: str
    category: str
    status: Column
    details: Column
    title: Column | None = None        # of the violation
    description: Column | None = None
    page_url: Column | None = None
    recommendation: Column | None = None
    per_form: bool = False


def _pass_if(test: Column, otherwise: str = FAIL) -> Column:
    return F.when(test, F.lit(PASS)).otherwise(F.lit(otherwise))


def _yes(test: Column, yes: str, no: str) -> Column:
    return F.when(test, F.lit(yes)).otherwise(F.lit(no))


_T = fixed.CHECK_TEXTS


def _form_checks() -> list[Check]:
    has_forms = F.col("forms_pd") > 0

    def form(cid, status, *counts, violation=False, **more):
        texts = _T[cid]
        if violation:
            more |= {"title": F.lit(texts["title"]), "description": tx.fill(texts["description"], *counts)}
        return Check(
            cid, "forms", F.when(has_forms, status).otherwise(F.lit(NA)),
            F.when(has_forms, tx.fill(texts["details"], *counts)).otherwise(
                F.lit(texts.get("skipped", fixed.FORMS_SKIPPED))), **more)

    return [
        form("FORM_001", _pass_if(F.col("forms_no_box") == 0), "forms_pd", "forms_no_box", per_form=True),
        form("FORM_002", _pass_if(F.col("forms_prechecked") == 0), "forms_prechecked", per_form=True),
        form("FORM_003", _pass_if(F.col("forms_no_link") == 0), "forms_no_link", violation=True),
        form("FORM_006", F.lit(WARNING)),
        form("FORM_007", _pass_if(F.col("forms_excessive") == 0, WARNING), "forms_excessive"),
    ]


def missing_elements() -> Column:
    """Consent elements found neither in a form's consent text nor in the policy."""
    names = []
    for i, (name, _) in enumerate(fixed.CONSENT_ELEMENTS):
        in_policy = F.coalesce(F.get("policy.consent_elements", F.lit(i)), F.lit(False))
        names.append(F.when(~(F.get("form_elements", F.lit(i)) | in_policy), F.lit(name)))
    return F.concat_ws(", ", *names)


def _consent_checks() -> list[Check]:
    has_forms = F.col("forms_pd") > 0

    def policy(flag):
        return F.coalesce(F.col(f"policy.{flag}"), F.lit(False))

    def check(cid, ok, *shown):
        texts = _T[cid]

        def text(kind):
            return tx.fill(texts[kind], *(shown if "{}" in texts[kind] else ()))

        return Check(
            cid, "consent", F.when(~has_forms, F.lit(NA)).otherwise(_pass_if(ok)),
            F.when(~has_forms, F.lit(fixed.CONSENT_SKIPPED)).when(ok, F.lit(texts["ok"])).otherwise(text("details")),
            F.lit(texts["title"]), text("description"), F.col("site_url"))

    missing = missing_elements()
    withdrawal = policy("has_withdrawal") | policy("has_withdrawal_stem") | F.col("form_withdrawal")
    return [
        check("CONSENT_001", F.col("forms_no_mechanism") == 0, "forms_no_mechanism"),
        check("CONSENT_002", ~(policy("has_offer") & policy("has_consent_wording"))),
        check("CONSENT_003", missing == "", missing),
        check("CONSENT_004", withdrawal),
        check("CONSENT_005", ~F.col("mixed_consent")),
    ]


def _cookie_checks() -> list[Check]:
    found = F.col("banner_found")

    def flag(name):
        return F.coalesce(F.col(f"banner.{name}"), F.lit(False))

    def check(cid, ok, negative=FAIL, always=False):
        texts = _T[cid]
        fine = F.lit(texts["ok"]) if "ok" in texts else F.lit(None).cast("string")
        details = F.when(ok, fine).otherwise(F.lit(texts["details"]))
        status = _pass_if(ok, negative)
        if not always:
            status = F.when(found, status).otherwise(F.lit(NA))
            details = F.when(found, details).otherwise(F.lit(fixed.COOKIES_SKIPPED))
        title, description = texts.get("title"), texts.get("description")
        return Check(cid, "cookies", status, details, None if title is None else F.lit(title),
                     None if description is None else F.lit(description), F.col("site_url"))

    return [
        check("COOKIE_001", found, always=True),
        check("COOKIE_002", flag("has_decline")),
        check("COOKIE_003", flag("has_settings"), WARNING),
        check("COOKIE_005", ~flag("analytics_before_consent")),
    ]


def _policy_checks() -> list[Check]:
    found, has_text = F.col("policy_found"), F.col("policy_has_text")

    def check(cid, status, details, **violation):
        return Check(cid, "privacy_policy", F.when(found, status).otherwise(F.lit(NA)),
                     F.when(found, details).otherwise(F.lit(fixed.POLICY_SKIPPED)), **violation)

    first, footer, page = _T["POLICY_001"], _T["POLICY_002"], _T["POLICY_017"]
    counts = ("pages_without_link", "pages_scanned")
    checks = [
        Check("POLICY_001", "privacy_policy", _pass_if(found), _yes(found, first["ok"], first["details"]),
              F.lit(first["title"]), F.lit(first["description"]), F.col("site_url")),
        check("POLICY_002", _pass_if(F.col("pages_without_link") == 0), tx.fill(footer["details"], *counts),
              title=F.lit(footer["title"]), description=tx.fill(footer["description"], *counts)),
    ]
    flags = {cid: name for cid, name, _, _ in fixed.POLICY_FLAGS_RU}
    for cid, title, message in fixed.POLICY_FLAG_TITLES:
        value = F.coalesce(F.col(f"policy.{flags[cid]}"), F.lit(False))
        negative = WARNING if cid == "POLICY_012" else FAIL
        checks.append(check(
            cid, F.when(has_text, _pass_if(value, negative)).otherwise(F.lit(REVIEW)),
            F.when(has_text, F.lit(title)).otherwise(F.lit(fixed.POLICY_UNREADABLE)),
            title=F.lit(message or fixed.POLICY_FLAG_TITLE.format(title)),
            description=F.lit(message or fixed.POLICY_FLAG_DESCRIPTION.format(title)),
            page_url=F.col("policy_url")))
    separate = F.col("policy_separate")
    checks.append(check("POLICY_017", _pass_if(separate, WARNING), _yes(separate, page["ok"], page["details"])))
    return checks


def _technical_checks() -> list[Check]:
    ssl, texts = F.col("has_ssl"), _T["TECH_001"]
    checks = [Check(
        "TECH_001", "technical", _pass_if(ssl), _yes(ssl, texts["ok"], texts["details"]),
        F.lit(texts["title"]), F.lit(texts["description"]), F.col("site_url"))]
    for cid, service, replacement in fixed.SERVICE_CHECKS:
        used = F.array_contains("services_used", service)
        checks.append(Check(
            cid, "technical", _pass_if(~used),
            _yes(used, fixed.SERVICE_FOUND.format(service), fixed.SERVICE_ABSENT.format(service)),
            F.lit(fixed.SERVICE_TITLE.format(service)), F.lit(fixed.SERVICE_DESCRIPTION.format(service)),
            recommendation=F.lit(fixed.SERVICE_ADVICE.format(service, replacement))))
    return checks


def _tracker_checks() -> list[Check]:
    found, has_text = F.col("policy_found"), F.col("policy_has_text")
    hidden, foreign = F.col("trackers_hidden"), F.size("trackers_foreign") > 0
    transfer = F.coalesce(F.col("policy.discloses_transfer"), F.lit(False)) & has_text
    silent = ~transfer & foreign
    hidden_names, silent_names = F.array_join(hidden, ", "), F.array_join("trackers_foreign", ", ")
    one, two = _T["TRACKER_001"], _T["TRACKER_002"]
    return [
        Check("TRACKER_001", "trackers",
              F.when(~found | ~has_text, F.lit(NA)).otherwise(_pass_if(F.size(hidden) == 0)),
              F.when(~found, F.lit(fixed.POLICY_SKIPPED)).when(~has_text, F.lit(one["unreadable"]))
              .when(F.size(hidden) > 0, tx.fill(one["details"], hidden_names))
              .when(F.size("trackers_used") > 0, F.lit(one["ok"])).otherwise(F.lit(one["none"])),
              F.lit(one["title"]), tx.fill(one["description"], hidden_names), F.col("policy_url"),
              tx.fill(one["advice"], hidden_names)),
        Check("TRACKER_002", "trackers",
              F.when(~found, F.lit(NA)).otherwise(_pass_if(~silent)),
              F.when(~found, F.lit(fixed.POLICY_SKIPPED)).when(silent, tx.fill(two["details"], silent_names))
              .when(transfer & foreign, F.lit(two["ok"])).otherwise(F.lit(two["none"])),
              F.lit(two["title"]), tx.fill(two["description"], silent_names), F.col("policy_url"),
              tx.fill(two["advice"], silent_names)),
    ]


def _regulatory_checks() -> list[Check]:
    return [Check(cid, "regulatory", F.lit(MANUAL), F.lit(_T[cid]["details"]))
            for cid in ("REG_001", "REG_002", "REG_003")]


def checks() -> list[Check]:
    return (_form_checks() + _consent_checks() + _cookie_checks() + _policy_checks()
            + _technical_checks() + _tracker_checks() + _regulatory_checks())


def site_checks(sites: DataFrame) -> DataFrame:
    """Long form: 42 rows per site.  The explode keeps the partitioning by site."""
    declared = checks()
    rows = F.array(*[F.struct(
        F.lit(i).alias("check_ord"), F.lit(c.id).alias("check_id"), F.lit(c.category).alias("category"),
        c.status.alias("status"), c.details.cast("string").alias("details")) for i, c in enumerate(declared)])
    return sites.select("site", F.explode(rows).alias("c")).select("site", "c.*")


def _site_violations(sites: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = [F.when(c.status == FAIL, F.struct(
        F.lit(i).alias("check_ord"), F.lit(c.id).alias("check_id"), F.lit(c.category).alias("category"),
        c.title.alias("title"), c.description.alias("description"),
        (none if c.page_url is None else c.page_url).alias("page_url"),
        (none if c.recommendation is None else c.recommendation).alias("recommendation")))
        for i, c in enumerate(checks()) if not c.per_form and c.title is not None]
    return sites.select(
        "site", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("v")
    ).select("site", "v.*", F.lit(0).cast("bigint").alias("page_ord"), F.lit(0).alias("form_ord"))


def form_violations(forms: DataFrame) -> DataFrame:
    """One row per offending form; forms never leave their partition."""
    no_box = ~F.col("has_consent_checkbox")
    prechecked = F.col("has_consent_checkbox") & F.col("consent_prechecked")

    def row(order, cid, *shown):
        return F.struct(
            F.lit(order).alias("check_ord"), F.lit(cid).alias("check_id"), F.lit("forms").alias("category"),
            F.lit(_T[cid]["title"]).alias("title"), tx.fill(_T[cid]["description"], *shown).alias("description"),
            F.col("page_url").alias("page_url"), F.lit(None).cast("string").alias("recommendation"))

    rows = F.array(
        F.when(no_box, row(0, "FORM_001", "page_url", F.array_join("pd_categories", ", "))),
        F.when(prechecked, row(1, "FORM_002", "page_url")))
    return forms.filter("collects_pd").select(
        "site", "page_ord", "form_ord", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("v")
    ).select("site", "v.*", "page_ord", "form_ord")


def violations(sites: DataFrame, forms: DataFrame) -> DataFrame:
    """All violations; order within a site is (check_ord, page_ord, form_ord)."""
    return _site_violations(sites).unionByName(form_violations(forms))


def site_outcomes(sites: DataFrame, *keep: str) -> DataFrame:
    """(site, check_ord, check_id, status, occurrences): outcome and violation count.

    Counts come straight from the site facts, so score, risk and fines do not
    wait for the form rows.
    """
    weight = {"FORM_001": F.col("forms_no_box"), "FORM_002": F.col("forms_prechecked")}
    rows = F.array(*[F.struct(
        F.lit(i).alias("check_ord"), F.lit(c.id).alias("check_id"), c.status.alias("status"),
        F.when((c.status == FAIL) & F.lit(c.per_form or c.title is not None),
               weight.get(c.id, F.lit(1))).otherwise(F.lit(0)).cast("bigint").alias("occurrences"))
        for i, c in enumerate(checks())])
    return sites.select("site", *keep, F.explode(rows).alias("c")).select("site", *keep, "c.*")
