"""Fuzzy dates: bounds and qualifier of an EDTF subset as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY, _MONTH, _YEAR = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}$", r"^\d{4}$"


def _shift(d: Column, years: Column) -> Column:
    """d moved by whole years; February 29 becomes March 1 where the year has none."""
    moved = F.add_months(d, (years * 12).cast("int"))
    return F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29) & (F.dayofmonth(moved) == 28), F.date_add(moved, 1)).otherwise(moved)


def _qualified(s: Column) -> tuple[Column, Column, Column]:
    """(lower, upper, qualifier) of a date, month or year with ~ before and ? after it; nulls if it is none."""
    approximate, uncertain = s.startswith("~"), s.endswith("?")
    core = F.regexp_replace(F.regexp_replace(s, r"^~", ""), r"\?$", "")
    first = F.when(core.rlike(_DAY), core).when(core.rlike(_MONTH), F.concat(core, F.lit("-01"))).when(core.rlike(_YEAR), F.concat(core, F.lit("-01-01")))
    low = F.try_to_date(first, "yyyy-MM-dd")
    high = F.when(core.rlike(_DAY), low).when(core.rlike(_MONTH), F.last_day(low)).otherwise(F.try_to_date(F.concat(core, F.lit("-12-31")), "yyyy-MM-dd"))
    spread = F.when(approximate & uncertain, 2).when(approximate | uncertain, 1).otherwise(0)
    qualifier = F.when(uncertain, "estimated").when(approximate, "approximate").otherwise("exact")
    moved = lambda d, sign: F.when(spread > 0, _shift(d, sign * spread)).otherwise(d)
    return moved(low, F.lit(-1)), moved(high, F.lit(1)), F.when(low.isNotNull(), qualifier)


def parse(s: Column) -> Column:
    """struct<raw, lower, upper, qualifier, valid>; the empty string and null are valid and have nothing."""
    return F.element_at(F.transform(F.array(s), lambda x: _parse(x)), 1)


def _parse(s: Column) -> Column:
    left, right = F.split_part(s, F.lit("/"), F.lit(1)), F.regexp_replace(s, r"^[^/]*/", "")
    open_left, open_right = left.isin("..", ""), right.isin("..", "")
    l, r, q = _qualified(left), _qualified(right), _qualified(s)
    ranged = s.contains("/")
    decade = s.rlike(r"^\d{3}x$")
    ten = F.try_to_date(F.concat(F.substring(s, 1, 3), F.lit("0-01-01")), "yyyy-MM-dd")
    nine = F.try_to_date(F.concat(F.substring(s, 1, 3), F.lit("9-12-31")), "yyyy-MM-dd")
    nothing = s.isNull() | (s == "")
    valid = F.when(nothing, True).when(ranged, (open_left | l[0].isNotNull()) & (open_right | r[0].isNotNull())).when(s.endswith("x"), decade).otherwise(q[0].isNotNull())
    none = F.lit(None).cast("date")
    lower = F.when(ranged, F.when(open_left, none).otherwise(l[0])).when(decade, ten).otherwise(q[0])
    upper = F.when(ranged, F.when(open_right, none).otherwise(r[1])).when(decade, nine).otherwise(q[1])
    qualifier = F.when(ranged, "range").when(decade, "decade").otherwise(q[2])
    known = valid & ~nothing
    return F.struct(s.alias("raw"), F.when(known, lower).alias("lower"), F.when(known, upper).alias("upper"), F.when(known, qualifier).alias("qualifier"), valid.alias("valid"))


def edge_bounds(start: Column, end: Column) -> Column:
    """struct<lower, upper, qualifier, valid> of an edge: the start's lower and the end's upper bound."""
    a, b = parse(start), parse(end)
    has_a, has_b = start.isNotNull() & (start != ""), end.isNotNull() & (end != "")
    qualifier = F.when(has_a & has_b, "range").when(has_a, a.qualifier).when(has_b, b.qualifier)
    return F.struct(a.lower.alias("lower"), b.upper.alias("upper"), qualifier.alias("qualifier"), (a.valid & b.valid).alias("valid"))
