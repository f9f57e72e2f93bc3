"""Session defaults and the fixed clock of all time-dependent queries."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: "Now" for the queries on driver tables. Operators take it as a parameter and read no clock.
AS_OF = "2024-01-31 00:00:00"


def build(app: str = "mnemospark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC, with adaptive execution and Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def moment(value: str = AS_OF) -> Column:
    return F.lit(value).cast("timestamp_ntz")
