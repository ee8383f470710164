"""Rule conditions as data, compiled to two-valued Spark columns.

A condition is a tuple: ``("null", c)``, ``("not_null", c)``, ``("eq", c, *values)``,
``("ne", c, *values)``, ``("and", *terms)``, ``("or", *terms)``, ``("not", term)``.

Conditions are two-valued: ``ne`` on NULL is true and ``eq`` on NULL is false, so
every leaf is coalesced and ``not`` stays plain negation.  ``lenient`` also reads
'' as null, in the null and not_null leaves only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(name: str, lenient: bool = True, text: bool = True) -> Column:
    missing = F.col(name).isNull()
    return missing | (F.col(name) == "") if lenient and text else missing


def compile_condition(condition: tuple, lenient: bool, texts: set[str]) -> Column:
    kind, *terms = condition
    if kind in ("and", "or"):
        parts = [compile_condition(t, lenient, texts) for t in terms]
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), parts)
    if kind == "not":
        return ~compile_condition(terms[0], lenient, texts)
    name, *values = terms
    if kind in ("null", "not_null"):
        blank = F.coalesce(is_blank(name, lenient, name in texts), F.lit(False))
        return blank if kind == "null" else ~blank
    listed = F.col(name).isin(*values)
    if kind == "eq":
        return F.coalesce(listed, F.lit(False))
    if kind == "ne":
        return F.coalesce(~listed, F.lit(True))
    raise ValueError(f"unknown condition {kind!r}")


def columns_in(condition: tuple | None) -> list[str]:
    if condition is None:
        return []
    kind, *terms = condition
    if kind in ("and", "or", "not"):
        return list(dict.fromkeys(c for t in terms for c in columns_in(t)))
    return [terms[0]]


def describe(condition: tuple) -> str:
    kind, *terms = condition
    if kind in ("and", "or"):
        return f" {kind} ".join(describe(t) for t in terms)
    if kind == "not":
        return f"not ({describe(terms[0])})"
    name, *values = terms
    if kind == "null":
        return f"{name} is null"
    if kind == "not_null":
        return f"{name} is not null"
    return f"{name} is {'' if kind == 'eq' else 'not '}{' or '.join(values)}"
