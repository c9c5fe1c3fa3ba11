"""Fail-closed results: every rule breach is a row, raising is the caller's choice."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RuleViolation(ValueError):
    """Raised by ``Checked.strict`` when at least one violation row exists."""


@dataclass(frozen=True)
class Checked:
    """A result and the rows that broke its rules (``rule, key, detail``)."""

    rows: DataFrame
    violations: DataFrame

    def strict(self) -> DataFrame:
        sample = self.violations.limit(5).collect()
        if sample:
            raise RuleViolation("; ".join(f"{r.rule}[{r.key}] {r.detail}" for r in sample))
        return self.rows


def violation(df: DataFrame, rule: str, when: Column, key: Column | str, detail: Column | str = "") -> DataFrame:
    """Rows of ``df`` for which ``when`` is true, as violation rows."""
    key = F.col(key) if isinstance(key, str) else key
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.where(when).select(
        F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def all_violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def failing(*rules: tuple[Column, str | Column]) -> Column:
    """Names of the rules whose condition is true, in the given order (never NULL)."""
    return F.array_compact(F.array(*[
        F.when(cond, F.lit(name) if isinstance(name, str) else name) for cond, name in rules]))


def missing_fields(*names: str) -> Column:
    """Names of the string fields that are NULL, empty or an explicit unknown marker."""
    return failing(*[(known(F.col(n)).isNull(), n) for n in names])


# Spellings that mean "not known" in the input tables.
UNKNOWN_MARKERS = ("", "UNKNOWN", "UNVERIFIED")


def known(col: Column) -> Column:
    """The trimmed text, or NULL when it is one of the unknown markers."""
    text = F.trim(col.cast("string"))
    return F.when(~text.isin(*UNKNOWN_MARKERS), text)
