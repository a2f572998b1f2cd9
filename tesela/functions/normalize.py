"""Column expressions that bring raw text fields into their normal form; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesela.functions.vocab import RAW_NULLS, TRIMMED_NULLS

BOM = "﻿"
#: Decimal numbers and infinities as both Spark and SQL engines read them; try_cast alone takes more.
NUMBER = r"(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)"
NOT_NUMBER = rf"(?s)^(?!{NUMBER}$).*$"
IS_NUMBER = f"^{NUMBER}$"
#: A text that is made of groups of thousands; of at most 13 after the first.
GROUPED = r"^[+-]?\d{1,3}(\.\d{3}){1,13}$"
GROUPED_TWICE = r"^[+-]?\d{1,3}(\.\d{3}){2,}$"
#: Starts of fields that are no token of no value; of those tokens, only 1.#IND and 1.#QNAN start with a digit.
KNOWN_START = r"^ *\d(?!\.#)"


def column_name(name: str) -> str:
    return name.replace(BOM, "").strip().lower()


#: All characters that count as white space at the ends of a field.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_all(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


# Catalyst puts a projection's expressions in place of their names wherever that is cheap, and always in filters. So the
# functions of a whole field mention their argument once (the one-element array stands for a local variable), which
# keeps them out of generated code; those of steps (below) mention it as often as they like, take a plain column and
# are projected one after another, each by generated code.
def only_if(c: Column, keep) -> Column:
    """c where keep(c), else null."""
    return F.get(F.filter(F.array(c), keep), F.lit(0))


def raw_null(c: Column) -> Column:
    """Null where the whole raw field is a token for no value; padded tokens stay text."""
    return only_if(c, lambda v: ~v.isin(*RAW_NULLS))


def clean(c: Column) -> Column:
    """Trimmed text, null for tokens of no value."""
    return only_if(trim_all(c.cast("string")), lambda v: ~v.isin(*TRIMMED_NULLS))


# Facts of files look at every field, so a cheap test that is enough goes before the whole one.
def is_number(c: Column) -> Column:
    """Whether a raw field is a number, with points as decimal points."""
    return F.coalesce(c.rlike(IS_NUMBER) | F.translate(trim_all(c), ",", ".").rlike(IS_NUMBER), F.lit(False))


def is_known(c: Column) -> Column:
    """Whether a raw field, trimmed, is no token of no value."""
    return F.coalesce(c.rlike(KNOWN_START) | (~c.isin(*RAW_NULLS) & ~trim_all(c).isin(*TRIMMED_NULLS)), F.lit(False))


# Steps, on plain columns of text.
def known(c: Column, tokens: tuple[str, ...] = TRIMMED_NULLS) -> Column:
    """c, or null where it is a token of no value."""
    return F.when(~c.isin(*tokens), c)


def zeros_step(c: Column) -> Column:
    return F.when(c.contains("."), without_zeros(c)).otherwise(c)


def zone_step(c: Column) -> Column:
    return F.when(c.contains("."), zone_text(c)).otherwise(c)


def digits_step(c: Column) -> Column:
    """The eight digits of a date whose trailing zeros are gone."""
    return F.lpad(F.translate(c, "-/ ", ""), 8, "0")


def dashes_step(digits: Column) -> Column:
    year, month, day = (F.substring(digits, at, n) for at, n in ((1, 4), (5, 2), (7, 2)))
    return F.concat(year, F.lit("-"), month, F.lit("-"), day)


def ungrouped_step(c: Column, grouped: Column) -> Column:
    """Without the points between thousands, where the file has them."""
    return F.when(grouped & c.rlike(GROUPED), F.translate(c, ".", "")).otherwise(c)


def number_step(c: Column) -> Column:
    return F.when(c.rlike(IS_NUMBER), c.try_cast("double"))


def without_zeros(c: Column) -> Column:
    return F.regexp_replace(c, r"\.0+$", "")


def zone_text(text: Column) -> Column:
    return F.regexp_replace(without_zeros(text), r"(?<=\d)\.(?=\d)", "")


def zone_id(c: Column) -> Column:
    """Identifier text: no trailing '.0', and no point between digits ('28.079' is '28079')."""
    return zone_text(clean(c))


def iso_date(c: Column) -> Column:
    """YYYY-MM-DD by position from eight digits in any of the source's spellings; not checked against a calendar."""
    return F.regexp_replace(digits_step(without_zeros(clean(c))), "(?s)^(.{4})(.{2})(.{2})$", "$1-$2-$3")


def point_decimal(c: Column) -> Column:
    return F.translate(clean(c), ",", ".")


def has_thousands(c: Column) -> Column:
    """Whether a field shows at least two groups of thousands; one such field decides for its column and file."""
    return F.coalesce((F.length(c) >= 9) & F.translate(trim_all(c), ",", ".").rlike(GROUPED_TWICE), F.lit(False))


def number_text(text: Column) -> Column:
    return F.regexp_replace(text, NOT_NUMBER, "x").try_cast("double")


def number(c: Column, grouped: Column | None = None) -> Column:
    """A double, null where the text isn't a number. grouped: whether points part thousands in this file."""
    text = point_decimal(c)
    return number_text(text if grouped is None else ungrouped_step(text, grouped))


def grouped_integer(c: Column) -> Column:
    """An integer whose points part thousands, unless all that follows the point is zeros."""
    text = point_decimal(c)
    plain = F.when(text.rlike(r"^[+-]?\d+(\.0+)?$"), text).otherwise(F.translate(text, ".", ""))
    return number_text(plain).try_cast("bigint")


def trip_label(c: Column) -> Column:
    """A label such as '2+'; '2.0' is '2'."""
    return without_zeros(trim_all(c.cast("string")))


def relabel(c: Column, labels: dict[str, str]) -> Column:
    """labels[c] where there is one, else c; exact matches only."""
    pairs = F.create_map(*(F.lit(x) for item in labels.items() for x in item))
    return F.coalesce(F.try_element_at(pairs, c), c)
