"""Audits that count in a single pass.

An audit states its aggregates and how their one row becomes a report. Run on
its own it is one aggregation; any number of audits can share one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbmeter.session import cut_lineage


@dataclass(frozen=True)
class Audit:
    """``measures`` are aggregates by name; ``render`` gets the row that holds them."""

    measures: dict
    render: Callable[[DataFrame], DataFrame]

    def of(self, df: DataFrame) -> DataFrame:
        """The report on ``df``."""
        return self.render(df.agg(*[value.alias(name) for name, value in self.measures.items()]))


def per_column(columns, measures: dict, shared: dict, render) -> Audit:
    """An audit with the same measures for each column.

    ``measures`` maps a name to a function from column name to aggregate,
    ``shared`` holds aggregates that are the same for all columns. ``render``
    gets one row per column.
    """
    columns = list(columns)
    aggregates = dict(shared)
    for i, c in enumerate(columns):
        for name, make in measures.items():
            aggregates[f"{name}_{i}"] = make(c)

    def rows(one: DataFrame) -> DataFrame:
        entries = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    *[F.col(f"{name}_{i}").alias(name) for name in measures],
                )
                for i, c in enumerate(columns)
            ]
        )
        return render(one.select(*shared, F.inline(entries)))

    return Audit(aggregates, rows)


def run_together(df: DataFrame, audits: dict) -> dict:
    """All reports from one scan of ``df``; the row of measures is kept in a checkpoint."""
    one = cut_lineage(
        df.agg(
            *[
                value.alias(f"{i}_{name}")
                for i, audit in enumerate(audits.values())
                for name, value in audit.measures.items()
            ]
        )
    )
    return {
        title: audit.render(
            one.select(*[F.col(f"`{i}_{name}`").alias(name) for name in audit.measures])
        )
        for i, (title, audit) in enumerate(audits.items())
    }
