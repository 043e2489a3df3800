"""Health of a store: one aggregate over all tables, and what it says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def score(tables: dict[str, DataFrame], orphans: DataFrame | None = None) -> DataFrame:
    """(tables, total_rows, empty_tables, orphans, health_score): 20 points off 100 for each empty table, and for orphans."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.union(one)
    sums = counts.agg(F.count(F.lit(1)).alias("tables"), F.sum("n").alias("total_rows"), F.count(F.when(F.col("n") == 0, 1)).alias("empty_tables"))
    lost = orphans.agg(F.count(F.lit(1)).alias("orphans")) if orphans is not None else counts.sparkSession.range(1).select(F.lit(0).cast("long").alias("orphans"))
    issues = F.col("empty_tables") + (F.col("orphans") > 0).cast("long")
    return sums.crossJoin(lost).withColumn("health_score", F.greatest(F.lit(0), 100 - 20 * issues).cast("long"))  # one row each


def status(points: int) -> str:
    return "HEALTHY" if points >= 80 else "ISSUES_FOUND" if points >= 50 else "CRITICAL"


def batch_health_check(spark: SparkSession, roots: Sequence[str], fix: bool = False) -> dict:
    """The health of several stores, and how many are of each status; a store that isn't there is CRITICAL."""
    from .store import Store

    reports = {}
    for root in roots:
        try:
            with Store(spark, root, mode="rw") as store:
                if fix:
                    store.optimize()
                reports[str(root)] = store.check_health()
        except FileNotFoundError:
            reports[str(root)] = {"tables": {}, "issues": ["there is no store"], "health_score": 0, "status": status(0)}
    statuses = [r["status"] for r in reports.values()]
    return {"reports": reports, "summary": {s: statuses.count(s) for s in ("HEALTHY", "ISSUES_FOUND", "CRITICAL")}}
