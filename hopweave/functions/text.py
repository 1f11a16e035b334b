"""Pages, queries and small text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopweave import dictionaries as D
from hopweave.functions.attrs import any_of
from hopweave.functions.names import fold


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once however often it is used: a filter pushed through a projection would make it for each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_text(raw: Column) -> Column:
    """The canonical form that offsets refer to."""
    t = F.regexp_replace(raw, "\r\n|\r", "\n")
    t = F.translate(t, "\u00a0\u200b", " ")
    t = F.regexp_replace(t, r"(?U)[\s&&[^\n]]+(?=\n|$)", "")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]{2,}", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def page_problem(text: Column) -> Column:
    """Why a page is of no use, or null: too_short, soft_404, paywall, consent_or_bot_wall."""

    def problem(t: Column, head: Column) -> Column:
        return F.when(F.length(F.trim(t)) < D.LEAST_USEFUL_CHARS, "too_short").when(any_of(head, D.NOT_FOUND), "soft_404").when(any_of(head, D.PAYWALL), "paywall").when(any_of(head, D.CONSENT), "consent_or_bot_wall")

    return once(text, lambda t: once(F.lower(F.substring(t, 1, D.HEAD_CHARS)), lambda head: problem(t, head)))


def looks_like_instruction(text: Column) -> Column:
    return once(F.lower(text), lambda low: any_of(low, D.INSTRUCTIONS))


def host(url: Column) -> Column:
    """Lower-case host without port and a leading www."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")


def is_binary_url(url: Column) -> Column:
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return path.rlike(r"\.(" + "|".join(D.BINARY_SUFFIXES) + ")$")


def is_blocked_url(url: Column, extra: list[str] = ()) -> Column:
    """Whether the host or a parent domain of it (not the bare top level) is on the list."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.arrays_overlap(parents, F.array(*map(F.lit, [*D.BLOCKED_DOMAINS, *extra])))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(value: Column, default: Column | None = None) -> Column:
    got = F.try_to_timestamp(value)
    return got if default is None else F.coalesce(got, default)


def query_key(query: Column, num: int = 10, gl: str = "us", hl: str = "en") -> Column:
    return F.concat_ws("|", F.lower(F.regexp_replace(F.trim(query), r"\s+", " ")), F.lit(str(num)), F.lit(gl), F.lit(hl))


def render_query(template: str, **places: Column) -> Column:
    """A template's text, null where a required place is blank."""
    text, required = D.TEMPLATES[template]
    parts, at = [], 0
    import re

    for m in re.finditer(r"\{(\w+)\}", text):
        parts += [F.lit(text[at : m.start()]), places.get(m[1], F.lit(None).cast("string"))]
        at = m.end()
    ok = F.lit(True)
    for r in required:
        ok = ok & (F.coalesce(F.trim(places.get(r, F.lit(None).cast("string"))), F.lit("")) != "")
    return F.when(ok, F.concat(*parts, F.lit(text[at:])))


def sanitise_hypothesis(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(any_of(F.lower(clean), D.SEARCH_OPERATORS), "").otherwise(F.substring(clean, 1, D.MOST_HYPOTHESIS_CHARS))


def tolerant_json(text: Column) -> Column:
    """The JSON object in a text as VARIANT: the whole text, else its first braced block, else null."""
    found = F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def verdict(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("yes", "no", "unknown"), v).otherwise("unknown")


def domain_candidates(org: Column, tlds: list[str]) -> Column:
    """Guessed host names of an organisation: its words but for legal ones, joined, and joined by hyphens, under each top level (with its dot)."""
    words = F.filter(F.split(F.regexp_replace(fold(org), "[,.]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(D.DOMAIN_NOISE))
    stems = F.when(F.size(words) > 0, F.array_distinct(F.array(F.array_join(words, ""), F.array_join(words, "-")))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(stems, lambda s: F.transform(F.array(*map(F.lit, tlds)), lambda t: F.concat(s, t))))
