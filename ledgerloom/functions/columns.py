"""Column helpers shared by the questions and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reads(*names: str):
    """Record which bill columns a job reads, so callers can project exactly those."""
    def mark(job):
        job.columns = names
        return job
    return mark


@dataclass(frozen=True)
class Span:
    """A half-open civil-date window, tested on a start column only."""

    start: str
    end: str

    def on(self, column: str) -> Column:
        # Compared at the column's own type so the filter reaches the parquet scan.
        return (F.col(column) >= F.lit(self.start).cast("timestamp_ntz")) & (
            F.col(column) < F.lit(self.end).cast("timestamp_ntz"))

    def on_date(self, column: str) -> Column:
        return (F.col(column) >= F.lit(self.start).cast("date")) & (
            F.col(column) < F.lit(self.end).cast("date"))


def usage() -> Column:
    return F.col("ChargeCategory") == "Usage"


def not_correction() -> Column:
    """Excluded by class, never by sign; a null class is kept."""
    return F.col("ChargeClass").isNull() | (F.col("ChargeClass") != "Correction")


def team() -> Column:
    return F.coalesce(F.get_json_object("Tags", "$.team"), F.lit("UNTAGGED"))


def resource_key() -> Column:
    return F.coalesce("ResourceId", "ResourceName")


def charge_day(column: str = "ChargePeriodStart") -> Column:
    return F.to_date(column)


def rows() -> Column:
    return F.count(F.lit(1))


def total(name: str, where: Column | None = None) -> Column:
    """Exact decimal sum, optionally over the rows matching a condition."""
    value = F.col(name)
    return F.sum(value if where is None else F.when(where, value))


def display(amount: Column, digits: int = 2) -> Column:
    """Rounding happens here, once, after all summing."""
    return F.round(amount, digits)


def ratio(top: Column, bottom: Column, digits: int = 1, scale: int = 100) -> Column:
    """``scale * top / bottom`` for display; a zero denominator gives NULL.

    Divided as doubles and rounded as a decimal, because decimal division
    widths and double rounding are where engines disagree.
    """
    quotient = F.lit(scale) * top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
    return F.round(quotient.cast("decimal(28,6)"), digits)


def count_where(condition: Column) -> Column:
    """How many rows meet a condition; null is no.

    Not `count_if`: Spark computes its conditions in a projection before the aggregate, written into the one method of the
    step, which the JVM does not compile where they are many.  What stands inside the aggregate is cut into small methods.
    """
    return F.count(F.when(condition, F.lit(1)))


def kept_apart(column: Column) -> Column:
    """The column as it is (though null by its type), by a function with a lambda, which keeps its step apart.

    Spark writes all that happens to a row between two shuffles into one method, and the JVM compiles no method of more than
    8000 bytes: some forty bill columns in one go run interpreted.  A step that holds such a function is kept out of that
    method and cut into small ones, however many columns it has.  What goes through it is itself interpreted, so let it be
    one cheap column of the step.
    """
    return F.element_at(F.transform(F.array(column), lambda value: value), 1)


def apart(frame: DataFrame, columns: dict[str, Column], through: list[str] | None = None) -> DataFrame:
    """These columns of a frame, computed in a step of their own; use it where a projection is wide.

    The first of `through` that may be null (so that the schema stays) is the one that is passed through `kept_apart`.
    """
    named = {name: column.alias(name) for name, column in columns.items()}
    made = frame.select(*named.values())
    may_be_null = [f.name for f in made.schema.fields if f.nullable and f.name in (through or named)]
    if not may_be_null:
        return made
    named[may_be_null[0]] = kept_apart(columns[may_be_null[0]]).alias(may_be_null[0])
    return frame.select(*named.values())
