"""Column expressions shared by the jobs. All are built-ins; none is a UDF."""

from __future__ import annotations

from string import ascii_letters, ascii_lowercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters one by one: a class of single characters is looked up in one table, while each range
#: in it is a call a character (six times as long a pass, measured).
LOWER = ascii_lowercase + digits
WORD = ascii_letters + digits + "_"
#: ASCII word boundary before and after a word character; the last one stands behind the
#: first character of a word, so that only words that begin with it are looked at.
BEFORE, AFTER, BEGUN = f"(?<![{WORD}])", f"(?![{WORD}])", f"(?<![{WORD}].)"
#: What single spaces replace; a single space is no match, since each match is a copy.
SPACES = r"\s\s++|[^\S ]"
PERCENT = r"(?<!\d)\d++(?:\.\d++)?+\s*+%"
_ODD_SPACES = " ﻿"


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, for arrays that lambdas index."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def js_round(c: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(c + 0.5)


def round1(c: Column) -> Column:
    """One decimal, halves toward plus infinity, as a double."""
    return F.floor(c * 10 + 0.5).cast("double") / 10


def missing(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def num(c: Column) -> Column:
    """Number or numeric text as double; anything else, NaN and infinity null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def plain_spaces(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    odd = F.contains(t, F.lit(_ODD_SPACES[0])) | F.contains(t, F.lit(_ODD_SPACES[1]))
    return F.when(odd, F.translate(t, _ODD_SPACES, "  ")).otherwise(t)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def by_first_letter(phrases: str) -> str:
    """A pattern of the same ``phrases``, which ``|`` separates, that tries those of a word's first letter only."""
    rest = {}
    for p in phrases.split("|"):
        rest.setdefault(p[0], []).append(p[1:])
    return "|".join(f"{c}(?:{'|'.join(r)})" for c, r in rest.items())


def only_with(c: Column, sign: str, pattern: str, by: str) -> Column:
    """``pattern`` replaced in texts that have ``sign``, without which it never matches."""
    return F.when(F.contains(c, F.lit(sign)), F.regexp_replace(c, pattern, by)).otherwise(c)


def without_brackets(c: Column, by: str) -> Column:
    """Text in round brackets replaced; ``by`` has ``$1``, what an open bracket leaves as it is.

    The rest after an open bracket is matched once, so many of them cost no more than one.
    """
    return only_with(c, "(", r"\([^)]*+\)|(\([^)]*+)", by)


def norm(c: Column) -> Column:
    """Lower-case ASCII words, digits, ``& ' -``; parentheses and percentages go."""
    t = without_brackets(F.lower(F.coalesce(c, F.lit(""))), " $1")
    t = only_with(t, "%", PERCENT, " ")
    return squeeze(F.regexp_replace(t, rf"[^{LOWER}&'\- ]", " "))


def tokens(c: Column) -> Column:
    """Runs of letters and digits of normalised text."""
    return F.filter(F.split(c, rf"[^{LOWER}]+"), lambda x: x != "")


def letter_runs(c: Column, size: Column) -> Column:
    """Distinct runs of ``size`` letters; none of shorter texts."""
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, size))
    return F.when(F.length(c) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def title_case(c: Column) -> Column:
    """First word character after every boundary in upper case, the rest untouched."""
    parts = F.split(c, BEFORE + "(?=[A-Za-z0-9_])")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30))), "")


def cap(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def is_food(product_type: Column) -> Column:
    return F.coalesce(missing(product_type), F.lit("food")).isin("food", "petfood")


def family(product_type: Column) -> Column:
    return F.when(is_food(product_type), "food").otherwise("nonfood")


def status_rank(status: Column) -> Column:
    return F.when(status == "avoid", 4).when(status == "caution", 3).when(status == "limit", 2).when(status == "unknown", 1).otherwise(0)


def type_label(product_type: Column) -> Column:
    t = F.coalesce(missing(product_type), F.lit("food"))
    return F.when(t == "food", "Food").when(t == "petfood", "Pet food").when(t == "beauty", "Cosmetics").otherwise("Household and others")


def verdict(badge_cls: Column) -> Column:
    return (
        F.when(badge_cls == "exc", "Nothing of note against it.")
        .when(badge_cls == "good", "Little to hold against it.")
        .when(badge_cls == "mid", "Some points to keep an eye on.")
        .when(badge_cls == "bad", "Better left alone or kept rare.")
    )


def portion_or_one(portion: Column) -> Column:
    return F.coalesce(F.nullif(portion, F.lit(0.0)), F.lit(1.0))


def step_portion(portion: Column, by: Column) -> Column:
    """Portion moved in quarter steps within 0.25 and 10."""
    return F.least(F.lit(10.0), F.greatest(F.lit(0.25), F.floor((portion_or_one(portion) + by) * 4 + 0.5) / 4))


def per_serving(serving: Column, per_100: Column, quantity: Column) -> Column:
    """Rounded amount of a serving, else of 100 g scaled to the serving, else of 100 g."""
    scaled = F.when(quantity.isNotNull() & (quantity != 0), per_100 * quantity / 100).otherwise(per_100)
    return F.coalesce(js_round(serving), js_round(scaled)).cast("int")


def body_from_imperial(feet: Column, inches: Column, pounds: Column) -> tuple[Column, Column]:
    """``(cm, kg)``."""
    cm = js_round((F.coalesce(feet, F.lit(0)) * 12 + F.coalesce(inches, F.lit(0))) * 2.54).cast("double")
    return cm, round1(pounds * 0.45359)
