"""Registration of queries: each names its input views, the operator call and the SQL
that checks it. A view is SQL over the driver's tables, the same for Spark and the
oracle; tables are written as {documents}."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = set(re.findall(r"\{([a-z]\w*)\}", sql))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def query(name: str, oracle: str | None = None, **views: str | tuple[str, str]):
    """Register a function of DataFrames (named as the views) under a query name.
    A pair of texts is the view for Spark and for the oracle."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(**{k: view(spark, sf_dir, v if isinstance(v, str) else v[0]) for k, v in views.items()})

        QUERIES[name] = run
        if oracle:
            named = ", ".join(f"{k} as ({v if isinstance(v, str) else v[1]})" for k, v in views.items())
            body = oracle.strip()
            if body.lower().startswith("with "):
                text = f"with {named}, {body[5:]}"
            else:
                text = f"with {named} {body}"
            ORACLES[name] = re.sub(r"\{([a-z]\w*)\}", r"\1", text)
        return build

    return register
