"""Registration of queries, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def register_into(queries: dict[str, Query], sql: dict[str, str]) -> Callable[..., Callable[[Query], Query]]:
    """A decorator query(sql) that files plans by name.

    Plans are built under UTC, which their casts of timestamps then hold; the session gets its own zone back.
    """

    def query(text: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                zone = spark.conf.get("spark.sql.session.timeZone")
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                try:
                    return f(spark, sf_dir)
                finally:
                    spark.conf.set("spark.sql.session.timeZone", zone)

            queries[f.__name__] = run
            if text:
                sql[f.__name__] = text
            return f

        return register

    return query
