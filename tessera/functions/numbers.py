"""The two ways a text is a number, and numbers with a fixed count of decimals.

``sql_*`` follow SQL casts; ``grid_number`` follows the cells of a data grid,
where a blank is 0 and ``0x``, ``0o`` and ``0b`` begin a number in another base.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "[0-9]+(_[0-9]+)*"
_WHOLE = rf"^\s*[+-]?{_DIGITS}\s*$"
_NUMBER = rf"^\s*[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?[0-9]+)?\s*$"
_WORD = r"^\s*[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
_BASED = {16: r"^\s*0[xX][0-9a-fA-F]{1,15}\s*$", 2: r"^\s*0[bB][01]{1,62}\s*$"}

#: Decimal numbers of the grid, without the blanks around them.
_GRID = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|Infinity)$"
_GRID_BASED = {16: "^0[xX][0-9a-fA-F]+$", 8: "^0[oO][0-7]+$", 2: "^0[bB][01]+$"}


def _plain(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit("_"), F.lit(""))


def sql_double(text: Column) -> Column:
    """As SQL casts a text to a double; null for all that is no whole number, decimal, infinity or nan."""
    return F.when(text.rlike(_NUMBER), _plain(text).try_cast("double")).when(text.rlike(_WORD), F.regexp_replace(F.trim(text), r"(?i)^([+-]?)inf(inity)?$", "$1Infinity").try_cast("double"))


def sql_whole(text: Column, kind: str) -> Column:
    """As SQL casts a text to ``int`` or ``bigint``: decimals are rounded half away from zero, ``0x`` and ``0b`` are other bases."""
    whole = F.when(text.rlike(_WHOLE), _plain(text).try_cast(kind))
    based = [F.when(text.rlike(p), F.conv(F.substring(F.trim(text), F.lit(3), F.lit(64)), base, 10).try_cast(kind)) for base, p in _BASED.items()]
    # Beyond 38 digits the decimal is null, and so is what no whole number type could hold.
    rounded = F.when(text.rlike(_NUMBER) & (F.length(text) <= 400), F.round(_plain(text).try_cast("decimal(38,10)")).try_cast(kind))
    return F.coalesce(whole, rounded, *based)


def _folded(digits: Column, base: int) -> Column:
    """The value of digits in a base: exact up to 31 digits, rounded once; beyond, rounded at each digit."""
    each = F.transform(F.split(F.lower(digits), ""), lambda d: (F.instr(F.lit("0123456789abcdef"), d) - 1))
    each = F.filter(each, lambda d: d >= 0)
    exact = F.aggregate(each, F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc * base + d).cast("decimal(38,0)"))
    return F.when(F.length(digits) <= 31, exact.cast("double")).otherwise(F.aggregate(each, F.lit(0.0), lambda acc, d: acc * base + d))


def grid_number(text: Column) -> Column:
    """The number that a grid cell with this text counts as; null where it is none."""
    t = F.regexp_replace(text, r"^[\s ﻿ -   ]+|[\s ﻿ -   ]+$", "")
    out = F.when(t == "", F.lit(0.0)).when(t.rlike(_GRID), t.try_cast("double"))
    for base, pattern in _GRID_BASED.items():
        out = out.when(t.rlike(pattern), _folded(F.substring(t, F.lit(3), F.lit(2**31 - 1)), base))
    return out


def scientific_text(x: Column) -> Column:
    """Shortest digits and exponent, as in 1.2345678e+4, rebuilt from the double's own text."""
    text = F.abs(x).cast("string")
    mantissa, power = F.split(text, "E").getItem(0), F.coalesce(F.get(F.split(text, "E"), 1).try_cast("int"), F.lit(0))
    whole, part = F.split(mantissa, r"\.").getItem(0), F.coalesce(F.get(F.split(mantissa, r"\."), 1), F.lit(""))
    digits = F.concat(whole, part)
    lead = F.length(digits) - F.length(F.ltrim(digits, F.lit("0")))
    body = F.rtrim(F.substring(digits, lead + 1, F.lit(400)), F.lit("0"))
    exponent = F.length(whole) - 1 - lead + power
    out = F.concat(_sign(x), F.substring(body, 1, 1), F.when(F.length(body) > 1, F.concat(F.lit("."), F.substring(body, F.lit(2), F.lit(400)))).otherwise(""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent).cast("string"))
    return F.when(x == 0, F.lit("0e+0")).when(_infinite(x), _infinity(x)).otherwise(out)


def _sign(x: Column) -> Column:
    return F.when(x < 0, "-").otherwise("")


def _infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def _infinity(x: Column) -> Column:
    return F.concat(_sign(x), F.lit("Infinity"))


#: Decimals up to which a text is exact whatever the size of the number.
MOST_PLACES = 14


def _exact(size: Column, places: int) -> Column:
    """A double from 0 to 1e21 with ``places`` decimals, from its exact binary digits, a tie rounded up."""
    big = lambda c, digits=38: c.cast(f"decimal({digits},0)")
    whole = size - size % 1
    rest, part = size - whole, []
    for _ in range(3):  # 26 binary digits at a time; a power of two changes no digit
        rest = rest * float(1 << 26)
        part.append(rest - rest % 1)
        rest = rest % 1
    fixed = lambda n, digits: F.lit(Decimal(n)).cast(f"decimal({digits},0)")
    one = fixed(1 << 78, 24)
    binary = (big(part[0], 8) * fixed(1 << 52, 16) + big(part[1], 8) * fixed(1 << 26, 8) + big(part[2], 8)).cast("decimal(24,0)")
    scaled = (binary * fixed(10**places, 15)).cast("decimal(38,0)")
    down = F.call_function("div", scaled, one)
    left = scaled - (big(down, 15) * one).cast("decimal(38,0)")
    part_up = down + F.when(left * 2 >= one, 1).otherwise(0)
    high = whole / float(1 << 40) - (whole / float(1 << 40)) % 1
    units = big(high, 16) * fixed(1 << 40, 14) + big(whole - high * float(1 << 40), 16) + F.when(part_up == 10**places, 1).otherwise(0)
    units = units.cast("decimal(38,0)").cast("string")
    return F.concat(units, F.lit("."), F.lpad((part_up % 10**places).cast("string"), places, "0")) if places else units


def fixed_text(x: Column, places: int) -> Column:
    """A double with ``places`` decimals, rounded from its exact binary value; a tie goes away from zero.

    From 1e21 on it is the shortest digits with an exponent.  Beyond
    ``MOST_PLACES`` decimals, digits after the seventeenth are zeros.
    """
    size = F.abs(x)
    near = F.call_function("format_number", size, F.lit("0" + ("." + "0" * places if places else "")))
    if places <= MOST_PLACES:
        # With few digits in all the shorter way is exact, but for ties: a double lies midway only if times 2 ** (places + 1) it is odd.
        odd = size * float(2 ** (places + 1))
        plain = (size * float(10**places) < 1e15) & ~((odd % 1 == 0) & (odd % 2 == 1))
        near = F.when(plain, near).when(size < 1e21, _exact(size, places)).otherwise(near)
    return F.when(_infinite(x), _infinity(x)).when(size >= 1e21, scientific_text(x)).otherwise(F.concat(_sign(x), near))
