"""Personal names as Column expressions; everything but exact Unicode folding stays in the JVM."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hopweave import dictionaries as D

# Latin letters with marks, by rule: those whose compatibility decomposition is one letter and marks.
_MARKED = {c: "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).casefold() for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
_FROM = "".join(chr(c) for c, x in _MARKED.items() if len(x) == 1)
_TO = "".join(x for x in _MARKED.values() if len(x) == 1)


def _words(words) -> Column:
    return F.array(*map(F.lit, words))


def fold(text: Column) -> Column:
    """Accents off, case folded; Latin letters, ß and loose combining marks."""
    return F.translate(F.regexp_replace(F.lower(F.regexp_replace(text, r"\p{Mn}+", "")), "ß", "ss"), _FROM, _TO)


@F.pandas_udf(StringType())
def fold_exact(s: pd.Series) -> pd.Series:
    """Full Unicode folding (NFKD, combining marks off, casefold), for text outside the Latin scripts."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold())


def tokens(name: Column, folded: Column | None = None) -> Column:
    """Comparable tokens: folded, punctuation off, titles and suffixes left out. Null gives an empty array."""
    clean = F.regexp_replace(F.regexp_replace(folded if folded is not None else fold(name), "’", "'"), r"(?U)[^\w\s'-]", " ")
    bare = F.transform(F.split(F.trim(F.regexp_replace(clean, r"(?U)\s+", " ")), " "), lambda t: F.regexp_replace(t, r"^[.]*'*|'*$", ""))
    return F.coalesce(F.filter(bare, lambda t: (t != "") & ~t.isin(D.TITLES + D.SUFFIXES)), F.array().cast("array<string>"))


def normalize_name(toks: Column) -> Column:
    return F.array_join(toks, " ")


def surname(toks: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(toks, lambda t: ~t.isin(D.PARTICLES)), F.lit(-1)), F.lit(""))


def given(toks: Column) -> Column:
    return F.coalesce(F.try_element_at(toks, F.lit(1)), F.lit(""))


def name_key(toks: Column) -> Column:
    """The blocking key: initial of the given name and the surname, else the normalized name."""
    g, s = given(toks), surname(toks)
    return F.when((g != "") & (s != ""), F.concat(F.substring(g, 1, 1), F.lit("|"), s)).otherwise(normalize_name(toks))


@functools.cache
def _forms_maps() -> tuple[str, str]:
    """SQL maps from a formal given name to its short forms, and back; one string each, as hundreds of literals take long to build one by one."""
    back: dict[str, list[str]] = {}
    for formal, nicks in D.NICKNAMES.items():
        for n in nicks.split():
            back.setdefault(n, []).append(formal)
    text = lambda m: "map(" + ", ".join(f"'{k}', '{v}'" for k, v in m.items()) + ")"
    return text(D.NICKNAMES), text({n: " ".join(f) for n, f in back.items()})


def given_forms(g: Column) -> Column:
    """g with its short and formal forms."""
    more = lambda m: F.split(F.coalesce(F.try_element_at(F.expr(m), g), F.lit("")), " ")
    down, up = _forms_maps()
    return F.array_distinct(F.filter(F.concat(F.array(g), more(down), more(up)), lambda x: x != ""))


def could_be_same_name(a: Column, b: Column) -> Column:
    """Whether two token arrays could name one person; a precondition, not evidence."""
    ga, gb, sa, sb = given(a), given(b), surname(a), surname(b)
    same_given = F.when(ga == gb, True).when((F.length(ga) == 1) | (F.length(gb) == 1), F.substring(ga, 1, 1) == F.substring(gb, 1, 1)).otherwise(F.arrays_overlap(given_forms(ga), given_forms(gb)))
    return (F.size(a) > 0) & (F.size(b) > 0) & ((a == b) | ((sa != "") & (sa == sb) & same_given))


def prepared(toks: Column, g: Column, s: Column) -> Column:
    """What could_be_same_name looks at, once a row: the tokens, given name and surname of a name, and the given name's forms."""
    return F.struct(toks.alias("tok"), g.alias("given"), s.alias("surname"), given_forms(g).alias("forms"))


def prepared_same_name(a: Column, b: Column) -> Column:
    """could_be_same_name of prepared names."""
    ga, gb = a["given"], b["given"]
    same_given = F.when(ga == gb, True).when((F.length(ga) == 1) | (F.length(gb) == 1), F.substring(ga, 1, 1) == F.substring(gb, 1, 1)).otherwise(F.arrays_overlap(a["forms"], b["forms"]))
    return (F.size(a["tok"]) > 0) & (F.size(b["tok"]) > 0) & ((a["tok"] == b["tok"]) | ((a["surname"] != "") & (a["surname"] == b["surname"]) & same_given))


def variants(toks: Column) -> Column:
    g, s = given(toks), surname(toks)
    forms = F.concat(F.transform(given_forms(g), lambda f: F.concat(f, F.lit(" "), s)), F.array(F.concat(F.substring(g, 1, 1), F.lit(" "), s)))
    return F.array_sort(F.array_distinct(F.concat(F.array(normalize_name(toks)), F.when((g != "") & (s != ""), forms).otherwise(F.array().cast("array<string>")))))


def slugs(toks: Column) -> Column:
    """The six URL spellings of a name."""
    g, s = given(toks), F.coalesce(F.try_element_at(toks, F.lit(-1)), F.lit(""))
    i = F.substring(g, 1, 1)
    six = F.array(F.array_join(toks, "-"), F.array_join(toks, ""), F.concat_ws("-", g, s), F.concat(g, s), F.concat_ws("-", i, s), F.concat(i, s))
    return F.when(F.size(toks) > 0, F.array_sort(F.array_distinct(six))).otherwise(F.array().cast("array<string>"))


def looks_canonical_for(url: Column, toks: Column) -> Column:
    """Whether a URL reads like this person's own page."""
    rest = F.element_at(F.split(fold(url), "://", 2), -1)
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    compact = F.regexp_replace(host, "[.-]", "")
    return F.exists(slugs(toks), lambda s: F.contains(path, s) | ((F.replace(s, F.lit("-")) != "") & F.contains(compact, F.replace(s, F.lit("-")))))


def looks_like_org(name: Column, toks: Column) -> Column:
    """Whether a name denotes an organisation: fewer than two tokens, function words, more than five words, a marker, or all capitals."""
    raw = F.trim(name)
    parts = F.transform(F.split(raw, r"(?U)\s+"), lambda t: F.lower(F.regexp_replace(t, "^[.,]+|[.,]+$", "")))
    letters = F.regexp_replace(raw, r"[^\p{L}]", "")
    loud = (F.length(letters) > 3) & (letters == F.upper(letters)) & (letters != F.lower(letters)) & F.contains(raw, F.lit(" "))
    return F.coalesce((raw == "") | (F.size(toks) < 2) | F.arrays_overlap(parts, _words(D.FUNCTION_WORDS)) | (F.size(parts) > 5) | F.arrays_overlap(parts, _words(D.ORG_MARKERS + D.ORG_NAME_MARKERS)) | loud, F.lit(True))


# A capitalised token or an initial, at most one particle, and one or two more; fixed value.
PERSON_PATTERN = r"\b(?:[A-Z][a-z'’\-]{1,20}|[A-Z]\.)(?:\s+(?:van|von|de|del|della|di|da|der|den|la|le|bin|ibn|al|Mc|Mac))?(?:\s+(?:[A-Z][a-z'’\-]{1,20}|[A-Z]\.)){1,2}\b"


def find_person_names(text: Column) -> Column:
    """Candidate full names in a text, first spelling of each normalized name, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PERSON_PATTERN), F.lit(0)), lambda m: F.regexp_replace(m, r"\s+", " "))
    bare = lambda m: F.transform(F.split(m, " "), lambda t: F.lower(F.regexp_replace(t, r"^\.+|\.+$", "")))
    good = F.filter(found, lambda m: (F.size(F.split(m, " ")) >= 2) & ~F.arrays_overlap(bare(m), _words(D.ORG_MARKERS)) & F.exists(bare(m), lambda t: F.length(t) > 1))
    keyed = F.filter(F.transform(good, lambda m: F.struct(normalize_name(tokens(m)).alias("k"), m.alias("m"))), lambda s: s["k"] != "")
    # A lambda's argument is made once; an expression used in a lambda is made anew for every element.
    first = lambda ks: F.transform(F.filter(ks, lambda s, i: F.array_position(ks["k"], s["k"]) == i + 1), lambda s: s["m"])
    return F.element_at(F.transform(F.array(keyed), first), 1)
