"""Temporal tests and constraints. Days are dates; a helper is a condition on two bound columns, never a table of pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CASE = "case_id"


def before(a: Column, b: Column) -> Column:
    return a < b


def within_days(n: int) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.abs(F.datediff(b, a)) <= n


def within_days_after(n: int) -> Callable[[Column, Column], Column]:
    """b lies 0 to n days after a."""
    return lambda a, b: F.datediff(b, a).between(0, n)


def same(period: str) -> Callable[[Column, Column], Column]:
    """Both in the same day, ISO week, month or year."""
    if period == "day":
        return lambda a, b: F.to_date(a) == F.to_date(b)
    return lambda a, b: F.date_trunc(period, a) == F.date_trunc(period, b)  # weeks begin on Monday, as ISO weeks do


class _Tests(dict):
    """Helper predicates by name; within_N_days and within_N_days_after for any N."""

    def __missing__(self, name: str) -> Callable[[Column, Column], Column]:
        if name not in self:
            raise KeyError(name)
        parts = name.split("_")
        return within_days_after(int(parts[1])) if name.endswith("_after") else within_days(int(parts[1]))

    def __contains__(self, name: object) -> bool:
        parts = str(name).split("_")
        return dict.__contains__(self, name) or (len(parts) in (3, 4) and parts[0] == "within" and parts[1].isdigit() and parts[2] == "days" and parts[3:] in ([], ["after"]))


HELPER_TESTS = _Tests({"before": before, **{f"same_{p}": same(p) for p in ("day", "week", "month", "year")}})


@dataclass(frozen=True)
class Constraint:
    """kind: order (later is not earlier), same (both in one period) or window (later within n days from earlier)."""

    name: str
    kind: str
    earlier: tuple[str, str, str]  # predicate, key role, date role
    later: tuple[str, str, str]
    period: str = "day"
    days: int = 14

    def broken(self, a: Column, b: Column) -> Column:
        if self.kind == "order":
            return b < a
        if self.kind == "same":
            return ~same(self.period)(a, b)
        return ~within_days_after(self.days)(a, b)


def bind(constraints: list[Constraint], predicates: set[str]) -> tuple[list[Constraint], list[tuple[str, str]]]:
    """Constraints whose predicates exist, and (name, missing predicate) of the others."""
    missing = [(c.name, p) for c in constraints for p in (c.earlier[0], c.later[0]) if p not in predicates]
    names = {n for n, _ in missing}
    return [c for c in constraints if c.name not in names], missing


def violations(frames: dict[str, DataFrame], constraints: list[Constraint]) -> DataFrame:
    """case_id, constraint, key: each key that breaks a constraint, once."""
    out = None
    for c in constraints:
        (p, k, d), (q, m, e) = c.earlier, c.later
        a = frames[p].select(CASE, F.col(k).alias("key"), F.col(d).alias("a"))
        b = frames[q].select(CASE, F.col(m).alias("key"), F.col(e).alias("b"))
        part = a.join(b, [CASE, "key"]).where(c.broken(F.col("a"), F.col("b"))).select(CASE, F.lit(c.name).alias("constraint"), "key").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def report(found: DataFrame) -> DataFrame:
    """Violations per case and constraint."""
    return found.groupBy(CASE, "constraint").agg(F.count(F.lit(1)).alias("n_violations"))


def paid_in_time(orders: DataFrame, payments: DataFrame, days: int = 2) -> DataFrame:
    """Orders with a payment 0 to `days` days after them: orders(case_id, ORDER, DATE), payments alike."""
    p = payments.select(CASE, "ORDER", F.col("DATE").alias("paid"))
    o, q = orders.alias("o"), p.alias("q")
    return o.join(q, (F.col(f"o.{CASE}") == F.col(f"q.{CASE}")) & (F.col("o.ORDER") == F.col("q.ORDER")) & F.datediff(F.col("q.paid"), F.col("o.DATE")).between(0, days), "left_semi")


def meets_minimum(amounts: DataFrame, minima: DataFrame) -> DataFrame:
    """case_id, COUPON, ORDER: order amounts that reach a coupon's minimum, within a case. The result itself is a product of the
    orders and coupons of a case; where counts are enough, use reached()."""
    return amounts.join(minima, CASE).where("AMOUNT >= MINIMUM").select(CASE, "COUPON", "ORDER")


def reached(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left(key, id, value) with n: the rows of right(key, value) of the same key with left.value >= right.value. Rows of a key are
    counted in one pass in order of value, so no pairs are made; on either side, rows may repeat."""
    lefts = left.select(key, "id", "value", F.lit(1).alias("is_left"))
    rights = right.select(key, F.lit(None).cast(left.schema["id"].dataType).alias("id"), "value", F.lit(0).alias("is_left"))
    up = Window.partitionBy(key).orderBy("value", "is_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lefts.unionByName(rights).withColumn("n", F.sum(1 - F.col("is_left")).over(up)).where("is_left = 1").select(key, "id", "value", "n")


def not_expired(applied: DataFrame) -> DataFrame:
    """Every applied coupon counts as valid; an expiry date is for a rule of the user's to check."""
    return applied.select(CASE, "COUPON").distinct()
