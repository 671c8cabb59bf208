"""Keys and clean values from names, money and lists; all are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PUNCTUATION = r"""[.,/#!$%^&*;:{}=_`~()"']"""
ORG_SUFFIXES = ["INCORPORATED", "INC", "CORPORATION", "CORP", "COMPANY", "CO", "LLC", "L L C", "LLP", "LP", "LTD", "PLLC", "PC", "PA", "LIMITED", "HOLDINGS", "GROUP", "THE"]
TITLES = ["SEN", "SENATOR", "REP", "REPRESENTATIVE", "CONG", "CONGRESSMAN", "CONGRESSWOMAN", "HON", "HONORABLE", "DR", "MR", "MRS", "MS"]
CAMPAIGN_PATTERNS = [
    r"^(?:THE\s+)?(?:RE-?ELECT\s+)?(.+?)\s+FOR\s+(?:U\.?\s*S\.?\s+)?(?:CONGRESS|SENATE)(?:\s+(?:COMMITTEE|INC\.?))?$",
    r"^FRIENDS\s+OF\s+(.+)$",
    r"^(?:THE\s+)?COMMITTEE\s+TO\s+RE-?ELECT\s+(.+)$",
]
ORG_WORDS = ["PAC", "COMMITTEE", "ASSOCIATION", "INSTITUTE", "FOUNDATION", "CAUCUS", "PARTY", "FUND"]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def squash(s: Column) -> Column:
    """Upper case, trimmed, runs of white space as one space; null is empty."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(s.cast("string"), F.lit("")), r"(?U)\s+", " ")))


def org_key(s: Column) -> Column:
    """An organisation's key: punctuation and corporate suffixes dropped anywhere in the name."""
    bare = F.regexp_replace(squash(s), PUNCTUATION, " ")
    return squash(F.regexp_replace(bare, r"\b(" + "|".join(ORG_SUFFIXES) + r")\b", " "))


def strip_titles(s: Column) -> Column:
    """Honorifics before a name are dropped, however many."""
    return F.regexp_replace(squash(s), r"^(?:(?:" + "|".join(TITLES) + r")\.?\s+)+", "")


def person_key(s: Column) -> Column:
    return squash(F.regexp_replace(strip_titles(s), PUNCTUATION, " "))


def last_first_key(s: Column) -> Column:
    """LAST|FIRST from "First Last" or "Last, First"; one word stays bare; parentheses are dropped."""
    raw = F.regexp_replace(squash(s), r"\([^)]*\)", " ")
    words = lambda c: F.filter(F.split(person_key(c), " "), lambda x: x != "")
    last = F.coalesce(F.try_element_at(words(F.substring_index(raw, ",", 1)), F.lit(-1)), F.lit(""))
    rest = raw.substr(F.instr(raw, ",") + 1, F.length(raw))
    first = F.coalesce(F.try_element_at(words(rest), F.lit(1)), F.lit(""))
    plain = words(raw)
    straight = F.when(F.size(plain) == 0, "").when(F.size(plain) == 1, plain[0]).otherwise(F.concat(F.element_at(plain, -1), F.lit("|"), plain[0]))
    turned = F.when(first != "", F.concat(last, F.lit("|"), first)).otherwise(last)
    return F.when((F.instr(raw, ",") > 0) & (last != ""), turned).otherwise(straight)


def campaign_candidate(s: Column) -> Column:
    """The person's name in a campaign committee's name: at most four words, none that marks an organisation; else null."""
    raw = F.trim(F.regexp_replace(squash(s), r"\.+$", ""))
    found = []
    for p in CAMPAIGN_PATTERNS:
        name = F.trim(F.regexp_extract(raw, p, 1))
        words = F.split(name, " ")
        found.append(F.when((name != "") & (F.size(words) <= 4) & ~F.arrays_overlap(words, F.array(*map(F.lit, ORG_WORDS))), name))
    return F.coalesce(*found)


def money(s: Column) -> Column:
    """A number from text with $ and thousands separators; null for blanks and anything else."""
    bare = F.trim(F.regexp_replace(s.cast("string"), "[,$]", ""))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def leading_int(s: Column) -> Column:
    """The integer that text begins with, else 0."""
    return F.coalesce(F.regexp_extract(s.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def text_year(s: Column) -> Column:
    """A year from text such as 2025 or 2025.0."""
    return F.when(F.trim(s).rlike(NUMBER), F.trim(s).try_cast("double")).cast("int")


def name_list(names: Column) -> Column:
    """Distinct, sorted, trimmed names of an array<struct<name>> joined by "; "."""
    clean = F.filter(F.transform(names, lambda x: F.trim(x["name"])), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_sort(F.array_distinct(clean)), "; ")


def full_name(first: Column, last: Column) -> Column:
    """Non-empty parts joined by a space."""
    return F.concat_ws(" ", F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(last), F.lit("")))


def like_literal(text: Column, part: str) -> Column:
    """Case-insensitive containment in which % and _ stand for themselves."""
    return F.contains(F.lower(text), F.lit(part.lower()))
