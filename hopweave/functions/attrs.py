"""Attribute values: buckets, comparable forms, conflicts and overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopweave import dictionaries as D
from hopweave.functions.names import fold


def any_of(text: Column, markers: list[str]) -> Column:
    """Whether the text holds one of the markers."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def looks_like_employer(value: Column) -> Column:
    """Whether a value could name a place of work: a short proper noun that is no party and no list of the rich."""
    toks = F.filter(F.split(value, r"(?U)\s+"), lambda t: t != "")
    content = F.filter(toks, lambda t: ~fold(t).isin(D.ORG_FUNCTION_WORDS))
    return F.coalesce((F.size(toks) > 0) & (F.size(toks) <= D.MOST_ORG_TOKENS) & ~F.trim(fold(value)).isin(D.NOT_EMPLOYERS) & (F.size(content) > 0) & F.forall(content, lambda t: t.rlike(r"^[\p{Lu}\p{Nd}]")) & value.rlike(r"\p{Lu}"), F.lit(False))


def classify_attribute(value: Column) -> Column:
    v = fold(value)
    return F.when(any_of(v, D.ROLES), "role").when(any_of(v, D.INSTITUTIONS), "institution").when(any_of(v, D.FIELDS), "field").when(looks_like_employer(value), "employer").otherwise("other")


def clean_attributes(values: Column, most: int = 8) -> Column:
    """Trimmed, blanks dropped, the first few."""
    return F.slice(F.filter(F.transform(values, F.trim), lambda v: v != ""), 1, most)


def bucket_attributes(values: Column) -> Column:
    """array of values -> map of bucket to sorted distinct values."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), F.trim), lambda v: v != "")
    keys = F.array(*[F.lit(k) for k in ("role", "institution", "field", "employer", "other")])
    made = F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_sort(F.array_distinct(F.filter(clean, lambda v: classify_attribute(v) == k))).alias("value")))
    return F.map_from_entries(F.filter(made, lambda e: F.size(e["value"]) > 0))


def compact(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{L}\p{N}]", "")


def compacts(values: Column) -> Column:
    """Values in the form in which they are compared, blanks dropped."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: compact(fold(v))), lambda v: v != "")


def near(x: Column, y: Column) -> Column:
    """overlaps of values that are in compact form already; equal ones are found without looking at every pair."""
    inside = lambda a, b: (F.length(a) > 3) & (F.length(b) > 3) & (F.contains(a, b) | F.contains(b, a))
    return F.coalesce(F.arrays_overlap(x, y), F.lit(False)) | F.coalesce(F.exists(x, lambda a: F.exists(y, lambda b: inside(a, b))), F.lit(False))


def prepared(attrs: Column) -> Column:
    """What pairs of observations are compared by, once a row: compact values per compared key, and the employer-shaped ones per exclusive key."""
    held = [compacts(_of(attrs, k)).alias(k) for k in D.COMPARED_KEYS]
    return F.struct(*held, *[compacts(F.filter(_of(attrs, k), looks_like_employer)).alias(f"only_{k}") for k in D.EXCLUSIVE_KEYS])


def prepared_conflict(a: Column, b: Column) -> Column:
    """Whether two prepared sets name organisations on an exclusive key of which none overlap."""
    out = F.lit(False)
    for k in D.EXCLUSIVE_KEYS:
        x, y = a[f"only_{k}"], b[f"only_{k}"]
        out = out | ((F.size(x) > 0) & (F.size(y) > 0) & ~near(x, y))
    return out


def prepared_match(a: Column, b: Column) -> Column:
    """Whether two prepared sets share a value on some compared key."""
    out = F.lit(False)
    for k in D.COMPARED_KEYS:
        out = out | near(a[k], b[k])
    return out


def overlaps(left: Column, right: Column) -> Column:
    """Any pair equal in compact form, or one inside the other when both are longer than three."""

    def pair(a, b):
        x, y = compact(fold(a)), compact(fold(b))
        return (x != "") & (y != "") & ((x == y) | ((F.length(x) > 3) & (F.length(y) > 3) & (F.contains(x, y) | F.contains(y, x))))

    return F.coalesce(F.exists(left, lambda a: F.exists(right, lambda b: pair(a, b))), F.lit(False))


def _of(attrs: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(attrs, F.lit(key)), F.array().cast("array<string>"))


def conflict(a: Column, b: Column) -> Column:
    """The first exclusive key on which both name organisations and none overlap, else null."""
    out = F.lit(None).cast("string")
    for key in reversed(D.EXCLUSIVE_KEYS):
        x, y = (F.filter(_of(m, key), looks_like_employer) for m in (a, b))
        out = F.when((F.size(x) > 0) & (F.size(y) > 0) & ~overlaps(x, y), key).otherwise(out)
    return out


def matching_keys(a: Column, b: Column) -> Column:
    found = F.array(*[F.when(overlaps(_of(a, k), _of(b, k)), k) for k in D.COMPARED_KEYS])
    return F.filter(found, lambda k: k.isNotNull())


def compatible(a: Column, b: Column) -> Column:
    return conflict(a, b).isNull() & (F.size(matching_keys(a, b)) > 0)


def candidate_facts(attrs: Column, most: int = 4) -> Column:
    return F.transform_values(attrs, lambda k, v: F.slice(F.array_sort(v), 1, most))
