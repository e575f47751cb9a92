"""Scalar functions of the warehouse's SQL that Spark words differently.

``upper``, ``lower``, ``to_date``, ``split`` and ``trim`` mean the same in both
and are used from ``pyspark.sql.functions`` directly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters after which the warehouse starts a new word.
WORD_BREAKS = r"""\s\[\](){}/|\\<>!?@"^#$&~_,.:;*%+\-"""

_BREAK = f"([{WORD_BREAKS}])"
_BREAK_BESIDES_SPACE = f"[{WORD_BREAKS}&&[^ ]]"
_BREAK_THEN_SPACE = f"([{WORD_BREAKS}]) "


def title_case(text: Column) -> Column:
    """Upper-case the first character of each word and lower-case the others.

    Spark's ``initcap`` starts words at blanks only.  So a blank is put after
    every word break, ``initcap`` does the work, and the blanks are taken out
    again; as *every* break got one, real blanks included, that is unambiguous.
    Text without other breaks goes to ``initcap`` as it is.
    """
    spaced = F.initcap(F.regexp_replace(text, _BREAK, "$1 "))
    return F.when(
        text.rlike(_BREAK_BESIDES_SPACE), F.regexp_replace(spaced, _BREAK_THEN_SPACE, "$1")
    ).otherwise(F.initcap(text))


def seconds_between(start: Column, end: Column) -> Column:
    """Complete seconds from start to end, cut towards zero (0.9 s to 2.1 s is 1)."""
    return (end - start).cast("interval second").cast("bigint")


def days_between(start: Column, end: Column) -> Column:
    """Calendar days from start to end, whatever the time of day."""
    return F.datediff(F.to_date(end), F.to_date(start)).cast("bigint")


def times(total: Column, count: Column) -> Column:
    """Exact ``total * count`` for a DECIMAL(38,9) and a whole count.

    A plain product of these types would be cut to six decimals.  Whole part and
    fraction are multiplied apart, each within 38 digits; a result too large for
    its type is an error under ANSI, as a sum of the copies would be.
    """
    one = F.lit(1).cast("decimal(1,0)")
    whole = F.floor(total) * count
    fraction = F.pmod(total, one) * count
    return (whole.cast("decimal(37,9)") + fraction.cast("decimal(37,9)")).cast("decimal(38,9)")


def table_of_file(path: Column) -> Column:
    """Target table of an arrived file: its base name up to the first dot, trimmed, lower-case."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.trim(F.split(base, r"\.").getItem(0)))
