"""What a masking job did, counted while it writes: no second pass, nothing in workers' logs.

The masked frame carries a Spark observation.  Its metrics are sums of conditions that
the plan has anyway (which rule decided), so they cost a few additions a row, and they
come with the one job that writes the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Names of metrics: rows, then "rule <tab> path".
ROWS = "rows"
SCHEMA = "path string, rule string, rows long"


def observed(df: DataFrame, observation: Observation | str, counts: list[tuple[str, str, Column]]) -> DataFrame:
    """``df``, counting its rows and those for which each (path, rule, condition) holds."""
    sums: dict[tuple[str, str], Column] = {}
    for path, rule, when in counts:
        one = F.sum(F.coalesce(when, F.lit(False)).cast("long"))
        sums[path, rule] = one if (path, rule) not in sums else sums[path, rule] + one
    metrics = [F.coalesce(c, F.lit(0).cast("long")).alias(f"{rule}\t{path}") for (path, rule), c in sums.items()]
    return df.observe(observation, F.count(F.lit(1)).alias(ROWS), *metrics)


def report(spark: SparkSession, metrics: Observation | dict) -> DataFrame:
    """(path, rule, rows) of a finished job; the row of all rows has no path and the rule "rows".

    ``metrics``: the observation, or what a stream's listener got under its name.
    """
    found = metrics.get if isinstance(metrics, Observation) else metrics
    rows = [(None, ROWS, found[ROWS])] + [(path, rule, n) for name, n in found.items() if name != ROWS for rule, _, path in [name.partition("\t")]]
    return spark.createDataFrame(rows, SCHEMA)
