"""Small value expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters that count as blank, as they stand in a character class.
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def or_else(value: Column, other: Column) -> Column:
    """`value`, or `other` where it is null or empty text."""
    return F.coalesce(F.nullif(value, F.lit("")), other)


def blank(value: Column) -> Column:
    """True where `value` is null or empty text."""
    return F.coalesce(value, F.lit("")) == ""


def pair_key(a: Column, b: Column) -> list[Column]:
    """Both ends of a conversation in one order, as columns `party_low`, `party_high`.

    `least` and `greatest` skip nulls, so rows without a party must be dropped first.
    """
    return [F.least(a, b).alias("party_low"), F.greatest(a, b).alias("party_high")]


def salted_md5(value: Column, salt: Column) -> Column:
    """MD5 of text followed by its salt (F2)."""
    return F.md5(F.concat(value, salt))


def send_delay_ms(key: Column, seed: int = 0) -> Column:
    """Delay below 60 s that is the same on every run for the same key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(60000)).cast("int")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Put values in place of `{{name}}`, one name after the other, as literal text."""
    filled = template
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{{" + name + "}}"), value)
    return filled


def raw_json(document: Column) -> Column:
    """A struct as JSON text that keeps its null fields."""
    return F.to_json(document, {"ignoreNullFields": "false"})


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value worked out once, however often `f` uses it, also after Catalyst has joined
    projections and pushed filters."""
    return F.transform(F.array(value), f)[0]
