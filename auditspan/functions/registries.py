"""Matching of script hosts against the service and tracker registries.

Both built-in registries are short constants, so they compile into the row
expression: no join, no shuffle, and the result is a bit mask that a plain
``bit_or`` can fold over a site.  Registries loaded as tables are matched by the
joins in :mod:`auditspan.operators.scripts`.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed


def _first_match(host: Column, values) -> Column:
    """Value of the first service one of whose domains occurs in ``host``."""
    chain = F
    for (_, _, _, domains), value in zip(fixed.PROHIBITED_SERVICES, values, strict=True):
        chain = chain.when(tx.any_of(host, [d.lower() for d in domains]), value)
    return chain


def prohibited_service(host: Column) -> Column:
    """Name of the prohibited service behind a host, NULL when there is none."""
    return _first_match(host, [F.lit(name) for name, *_ in fixed.PROHIBITED_SERVICES])


def prohibited_mask(host: Column) -> Column:
    """Bit of that service, 0 when there is none."""
    bits = [F.lit(1 << i).cast("bigint") for i in range(len(fixed.PROHIBITED_SERVICES))]
    return F.coalesce(_first_match(host, bits), F.lit(0).cast("bigint"))


def tracker_mask(host: Column) -> Column:
    """Bit i is set when ``host`` is, or is under, a domain of tracker i."""
    dotted = F.concat(F.lit("."), host)
    mask = F.lit(0).cast("bigint")
    for i, (_, domains, _, _) in enumerate(fixed.TRACKERS):
        hit = F.lit(False)
        for domain in domains:
            hit = hit | dotted.endswith("." + domain)
        mask = mask.bitwiseOR(F.when(hit, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return mask


def disclosed_tracker_mask(policy_lower: Column) -> Column:
    """Bit i is set when the policy text names tracker i."""
    mask = F.lit(0).cast("bigint")
    for i, (_, _, keywords, _) in enumerate(fixed.TRACKERS):
        mask = mask.bitwiseOR(
            F.when(tx.any_of(policy_lower, keywords), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return mask


FOREIGN_TRACKERS = sum(1 << i for i, t in enumerate(fixed.TRACKERS) if t[3])


def _names(mask: Column, names) -> Column:
    """Names of the bits of a mask, in registry order."""
    return F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(names)]))


def site_columns(prohibited: Column, trackers: Column, disclosed: Column) -> dict[str, Column]:
    """Services and trackers of a site by name, from the masks of the built-in registries."""
    names = [t[0] for t in fixed.TRACKERS]
    return {
        "services_used": _names(prohibited, [s[0] for s in fixed.PROHIBITED_SERVICES]),
        "trackers_used": _names(trackers, names),
        "trackers_hidden": _names(trackers.bitwiseAND(F.bitwise_not(disclosed)), names),
        "trackers_foreign": _names(trackers.bitwiseAND(F.lit(FOREIGN_TRACKERS)), names)}
