"""Tables between jobs and positions in a total order, which no single task holds."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows whose results a Python function holds at a time.
SLICE = 512


def sliced(returns: str) -> Callable[[Callable[..., pd.Series]], Callable[..., Column]]:
    """UDF of a function of series that gets SLICE rows at a time, so that the results of a
    whole batch are never in Python at once; made when called, as a UDF needs a session."""

    def made(function: Callable[..., pd.Series]) -> Callable[..., Column]:
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                columns = batch if isinstance(batch, tuple) else (batch,)
                for at in range(0, len(columns[0]), SLICE):
                    yield function(*(c.iloc[at : at + SLICE] for c in columns))

        return F.pandas_udf(run, returns)

    return made


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only if it is unset one of our own: in
    the warehouse, which a cluster shares, or in the temporary folder of a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            folder = f"file://{os.path.join(tempfile.gettempdir(), 'corvane-shared')}"
        else:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/corvane-shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a
    lost executor costs no recomputation of what stands before."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of keep() that no later job reads."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, order: list[Column], out: str = "n", within: list[str] | None = None) -> DataFrame:
    """df with its place, from 1, in a total order: row_number() without a window that
    holds all rows. Rows are dealt by ranges of the order and written with their place in
    the part; the parts before it add an offset. `within` names columns whose values are
    numbered apart (null is a value): the least place of each is taken off.

    Rows that are equal in the order follow in no promised order, but stay as written.
    """
    keys = [F.col(c).asc_nulls_first() for c in within or []]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = keep(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))  # a row for each part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    every = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(out, at + F.col("_before") + 1)
    every = every.drop("_part", "_at", "_before")
    if not within:
        return every
    first = every.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(within))).agg(F.min(out).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(within)]
    apart = every.join(first, same).withColumn(out, F.col(out) - F.col("_first") + 1)
    return apart.drop("_first", *(f"_k{i}" for i in range(len(within))))
