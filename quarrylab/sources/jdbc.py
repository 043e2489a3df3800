"""PostgreSQL and other databases by JDBC; the driver's jar must be on Spark's class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def url(dbname: str, host: str = "localhost", port: int = 5432) -> str:
    return f"jdbc:postgresql://{host}:{port}/{dbname}"


def read_table(spark: SparkSession, address: str, table: str, user: str, password: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A table, or a query in parentheses with a name; with a key and its bounds, in as many ranges as partitions."""
    reader = spark.read.format("jdbc").options(url=address, dbtable=table, user=user, password=password, fetchsize=10_000)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def write_table(df: DataFrame, address: str, table: str, user: str, password: str, mode: str = "append") -> None:
    df.write.format("jdbc").options(url=address, dbtable=table, user=user, password=password, batchsize=1000).mode(mode).save()
