"""Structured and short summaries by kind of document, their validation, and
the projection that decides what is shown.

A variant lists the fields of a kind; each field takes the first of its
candidates that is not empty and not the same as an earlier field it must
differ from. Candidates are names of columns, so a variant is data, and the
summary of a row is one expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import collapse

#: A variant: [(field, candidates in order, fields it must differ from)].
Variant = list[tuple[str, list[str], list[str]]]


def candidate(options: list[Column], avoid: list[Column]) -> Column:
    """The first option that is neither null nor empty nor, in lower case, one
    of those to avoid."""
    fits = []
    for o in options:
        ok = F.length(F.trim(o)) > 0
        for a in avoid:
            ok = ok & ~F.lower(o).eqNullSafe(F.lower(a))
        fits.append(F.when(ok, o))
    return F.coalesce(*fits)


def fields_of(variant: Variant, values: dict[str, Column]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name, options, avoid in variant:
        out[name] = candidate([values[o] for o in options], [out[a] for a in avoid])
    return out


def structured(kind: Column, values: dict[str, Column], variants: dict[str, Variant]) -> Column:
    """map<string,string> of the fields of the row's kind; null of others."""
    out = F.lit(None).cast("map<string,string>")
    for name, variant in variants.items():
        fields = fields_of(variant, values)
        out = F.when(kind == name, F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields.values()))).otherwise(out)
    return out


def short(kind: Column, summary: Column, otherwise: Column, rules: dict[str, tuple[str, str]]) -> Column:
    """One line by kind: how it starts, and the field that follows. Kinds without
    a rule, and empty fields, give `otherwise`."""
    out = otherwise
    for name, (start, field) in rules.items():
        out = F.when(kind == name, F.concat(F.lit(start), F.coalesce(F.element_at(summary, field), otherwise))).otherwise(out)
    return out


def validated(kind: Column, payload: Column, variants: dict[str, Variant]) -> Column:
    """The payload (JSON) as a map with every field of its kind, values with
    single spaces and empty ones null; null if the payload is no object, has no
    fields or one that its kind does not know, or the kind is unknown."""
    given = F.from_json(payload, "map<string,string>")
    out = F.lit(None).cast("map<string,string>")
    for name, fields in variants.items():
        allowed = F.array(*[F.lit(f) for f, *_ in fields])
        known = F.transform(allowed, lambda f: F.nullif(collapse(F.element_at(given, f)), F.lit("")))
        fits = (kind == name) & (F.size(given) > 0) & (F.size(F.array_except(F.map_keys(given), allowed)) == 0)
        out = F.when(fits, F.map_from_arrays(allowed, known)).otherwise(out)
    return out


def flags(line: Column, summary: Column, topics: Column, confidence: Column) -> Column:
    """Reasons to look again, in a fixed order."""
    filled = F.size(F.filter(F.map_values(summary), lambda v: v.isNotNull()))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.length(line), F.lit(0)) < 30, "short_summary"),
            F.when(filled * 2 < F.size(summary), "few_fields"),
            F.when(F.size(topics) == 0, "no_topics"),
            F.when(confidence < 0.5, "low_confidence"),
        )
    )


def status(found: Column) -> Column:
    return F.when(F.size(found) == 0, "accepted").when(F.size(found) == 1, "review").otherwise("rejected")
