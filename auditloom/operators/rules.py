"""Rules as data: a guard and the values of the issue it raises, compiled into one projection.

All rules of a pack are evaluated in a single pass: each row makes an array of the structs whose guards
hold, and the array is exploded. No rule costs a scan or a shuffle of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE_WIDE = "(site-wide)"

#: Severities with their rank, priority text and deductions from a page's and the site's 100 points.
SEVERITIES = {
    "Critical": (0, "P1 - fix immediately", 25, 12),
    "Important": (1, "P2 - fix soon", 8, 4),
    "Optimization": (2, "P3 - improve", 2, 1),
    "Info": (3, "P4 - for information", 0, 0),
}


@dataclass(frozen=True, eq=False)
class Rule:
    severity: str
    category: str
    issue: str
    guard: Column
    current: Column | None = None
    element: Column | None = None
    report: str | None = None


def evaluate(rows: DataFrame, rules: list[Rule], report: str = "", url: str = "url") -> DataFrame:
    """One row (url, severity, category, issue, current_value, element, report) for each rule that fires on a row."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    fired = [
        F.when(r.guard, F.struct(F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(r.issue).alias("issue"), text(r.current).alias("current_value"), text(r.element).alias("element"), F.lit(r.report or report).alias("report")))
        for r in rules
    ]
    out = rows.select(F.col(url).alias("url"), F.explode(F.array_compact(F.array(*fired))).alias("i"))
    return out.select("url", "i.*")


def _by_severity(severity: Column, position: int, default) -> Column:
    out = F.lit(default)
    for name, values in SEVERITIES.items():
        out = F.when(severity == name, F.lit(values[position])).otherwise(out)
    return out


def rank(severity: Column) -> Column:
    return _by_severity(severity, 0, 9)


def priority(severity: Column) -> Column:
    return _by_severity(severity, 1, "")


def page_weight(severity: Column) -> Column:
    return _by_severity(severity, 2, 0)


def site_weight(severity: Column) -> Column:
    return _by_severity(severity, 3, 0)
