"""What a column of texts holds: whole numbers, decimals, words for true and false, times, dates in several orders, timestamps.

Every text gets a bit mask of the kinds it fits; the kinds of a column are the
bits that all its texts share, one ``bit_and`` per column.  What a text is taken
apart into is worked out once: Spark would repeat an expression at each of its
uses within a ``CASE``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders of a date, the first that fits all is taken: year, month, day with four or two digits of the year, and so on.
ORDERS = ("ymd4", "ymd2", "dmy4", "dmy2", "mdy4", "mdy2")
_BOOLEAN, _BIGINT, _DOUBLE, _TIME, _DATE, _TIMESTAMP = (1 << i for i in range(6))
_ORDER = {name: 1 << (6 + i) for i, name in enumerate(ORDERS)}
_HEX = 1 << 12
_ALL = (1 << 13) - 1

#: Words for true and for false.
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes"), ("false", "f", "no")

_WHOLE = r"^-?(0|[1-9][0-9]*)$"
_DECIMAL = r"^-?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_HEXADECIMAL = r"^0[xX][0-9a-fA-F]{1,15}$"
_CLOCK_24 = r"([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?"
_CLOCK_12 = r"(0?[1-9]|1[0-2]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)? ?[aApP][mM]"
_DAY = r"^([0-9]{1,4})([-/. ])([0-9]{1,2})\2([0-9]{1,4})"
_TIME_ONLY, _DATED = f"^{_CLOCK_24}$", f"{_DAY}($|[ T]({_CLOCK_24}|{_CLOCK_12})$)"
#: What may follow the last character of a text that a pattern with ``$`` finds.
_ENDS = "\n\r\u0085\u2028\u2029"
#: Years of two digits (or one) and what goes before them.
_SHORT_YEARS = (("[0-5][0-9]|6[0-8]", "20"), ("[0-9]", "200"), ("69|[7-9][0-9]", "19"))


def _iso(text: Column, order: str) -> Column:
    """``text``, which begins with a date in this order, with that date as year, month and day; what follows the date stays."""
    place = {k: "134"[i] for i, k in enumerate(order[:3])}
    for years, before in (("[0-9]{4}", ""),) if order.endswith("4") else _SHORT_YEARS:
        first, second, third = (f"({years if k == 'y' else '[0-9]{1,2}'})" for k in order[:3])
        # A year of four digits is no longer met by the patterns of short ones.
        text = F.regexp_replace(text, rf"^{first}([-/. ]){second}\2{third}(?![0-9])", f"{before}${place['y']}-${place['m']}-${place['d']}")
    return text


def _moment(text: Column, order: str) -> Column:
    """The timestamp of a date with or without a time of day, of 24 hours or of twice twelve."""
    iso = _iso(text, order)
    morning = F.regexp_replace(F.regexp_replace(iso, "[ T]12:", " 0:"), " ?[aApP][mM]$", "")
    half = F.when(text.rlike("[pP][mM]$"), F.expr("INTERVAL '12' HOUR")).otherwise(F.expr("INTERVAL '0' HOUR"))
    return F.when(text.rlike("[mM]$"), morning.try_cast("timestamp_ntz") + half).otherwise(iso.try_cast("timestamp_ntz"))


def _even(text: Column) -> Column:
    """A text that begins with a date, with one separator for all."""
    return F.rtrim(reduce(lambda t, sep: F.replace(t, F.lit(sep), F.lit("-")), "/. ", text), F.lit(_ENDS))


def _numbers(even: Column) -> list[Column]:
    """The three numbers of the date that a text of ``_even`` begins with, as texts."""
    first = lambda n: F.substring_index(even, "-", n)
    return [first(1), F.substring_index(first(2), "-", -1), F.substring_index(F.substring_index(first(3), "-", -1), "T", 1)]


def _orders(numbers: list[Column]) -> Column:
    """The bits of all orders in which three numbers are a date of the calendar."""
    out = F.lit(0)
    for order in ("ymd", "dmy", "mdy"):
        year, month, day = (numbers[order.index(k)] for k in "ymd")
        # A cast to date takes four digits of a year, one or two of a month and a day; which century a short year is in doesn't matter for leap days.
        century = F.when(year == "0000", F.lit(None)).when(F.length(year) == 4, "").when(F.length(year) == 2, "20").when(F.length(year) == 1, "200")
        known = F.concat(century, year, F.lit("-"), month, F.lit("-"), day).try_cast("date").isNotNull()
        out = out + F.when(known, F.when(F.length(year) == 4, _ORDER[f"{order}4"]).otherwise(_ORDER[f"{order}2"])).otherwise(0)
    return out


def _mask(t: Column, dated: Column, orders: Column) -> Column:
    """The kinds of a trimmed text, of which is known whether it has the shape of a date or timestamp, and in which orders."""
    whole = F.when((F.length(t) < 19) | t.try_cast("long").isNotNull(), _BIGINT | _DOUBLE).otherwise(_DOUBLE)
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("int"))
        .when(dated, F.when(orders == 0, 0).otherwise(orders + F.when(F.instr(t, ":") == 0, _DATE | _TIMESTAMP).otherwise(_TIMESTAMP)))
        .when(t.rlike(_WHOLE), whole)
        .when(t.rlike(_DECIMAL), F.lit(_DOUBLE))
        .when(F.lower(t).isin(*TRUE_WORDS, *FALSE_WORDS), F.lit(_BOOLEAN))
        .when(t.rlike(_TIME_ONLY), F.lit(_TIME))
        .when(t.rlike(_HEXADECIMAL), F.lit(_BIGINT | _HEX))
        .otherwise(0)
    )


def kind_mask(text: Column) -> Column:
    """The kinds of one text; null where it is null or blank, which fits all."""
    t = F.trim(text)
    return _mask(t, t.rlike(_DATED), _orders(_numbers(_even(t))))


def kinds_met(text: Column) -> Column:
    """An aggregate: the kinds that all texts fit; null without texts."""
    return F.bit_and(kind_mask(text))


def kinds_in(df: DataFrame, texts: list[Column]) -> list[int | None]:
    """``kinds_met`` of many columns of texts, in one pass.

    Each cell becomes a row, so that the code doesn't grow with the columns, and
    each step (trimmed text, shape, numbers of a date, orders, kinds) is taken
    once per cell.
    """
    if not texts:
        return []
    cells = df.select(F.posexplode(F.array(*texts)).alias("i", "t")).select("i", F.trim("t").alias("t"))
    shaped = cells.select("i", "t", F.coalesce(F.col("t").rlike(_DATED), F.lit(False)).alias("dated"))
    parted = shaped.select("*", F.when(F.col("dated"), _even(F.col("t"))).alias("even"))
    parted = parted.select("i", "t", "dated", *[n.alias(f"n{k}") for k, n in enumerate(_numbers(F.col("even")))])
    ordered = parted.select("i", "t", "dated", F.when(F.col("dated"), _orders([F.col(f"n{k}") for k in range(3)])).alias("orders"))
    met = ordered.groupBy("i").agg(F.bit_and(_mask(F.col("t"), F.col("dated"), F.col("orders"))).alias("met"))
    found = {r.i: r.met for r in met.collect()}
    return [found.get(i) for i in range(len(texts))]


def kind_of(met: int | None) -> tuple[str, str | None]:
    """The kind of a column and the order of its dates; VARCHAR without texts or a common kind."""
    if met is None or not met:
        return "VARCHAR", None
    order = next((o for o, bit in _ORDER.items() if met & bit), None)
    for name, bit in (("BOOLEAN", _BOOLEAN), ("TIME", _TIME), ("DATE", _DATE), ("TIMESTAMP", _TIMESTAMP), ("BIGINT", _BIGINT), ("DOUBLE", _DOUBLE)):
        if met & bit and (order or name not in ("DATE", "TIMESTAMP")):
            return name, order
    return "VARCHAR", None


def as_kind(text: Column, kind: str, order: str | None = None) -> Column:
    """A text of a kind as a value; a time of day stays text (``HH:MM:SS``), since the types have none."""
    t = F.trim(text)
    if kind == "BOOLEAN":
        return F.when(t != "", F.lower(t).isin(*TRUE_WORDS))
    if kind == "BIGINT":
        return F.when(t.rlike(_HEXADECIMAL), F.conv(F.substring(t, F.lit(3), F.lit(15)), 16, 10).try_cast("long")).otherwise(t.try_cast("long"))
    if kind == "DOUBLE":
        return t.try_cast("double")
    if kind == "DATE":
        return F.when(t.rlike(_DATED), _iso(t, order).try_cast("date"))
    if kind == "TIMESTAMP":
        return F.when(t.rlike(_DATED), _moment(t, order))
    if kind == "TIME":
        whole = F.regexp_replace(F.regexp_extract(t, _TIME_ONLY, 0), "^([0-9]:)", "0$1")
        return F.nullif(F.regexp_replace(whole, "^([0-9]{2}:[0-9]{2})$", "$1:00"), F.lit(""))
    return text
