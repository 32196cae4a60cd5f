"""Column functions over extracted form fields."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed


def field_text(field: Column) -> Column:
    """Name, label and placeholder of a field, those that are present."""
    parts = [F.when(field.getField(k) != "", field.getField(k)) for k in ("name", "label", "placeholder")]
    return F.concat_ws(" ", *parts)


def pd_categories(fields: Column) -> Column:
    """Personal-data categories of a form, in order of discovery.

    A field adds the first category that matches it and is not yet present, so a
    second e-mail field may fall through to a later category.
    """
    texts = F.transform(fields, field_text)

    def add(seen: Column, text: Column) -> Column:
        step = None
        for category, pattern in fixed.PD_CATEGORIES:
            hit = ~F.array_contains(seen, category) & tx.matches(text, pattern)
            grown = F.concat(seen, F.array(F.lit(category)))
            step = F.when(hit, grown) if step is None else step.when(hit, grown)
        return step.otherwise(seen)

    return F.aggregate(texts, F.array().cast("array<string>"), add)
