"""Tables written to the shared folder, input tables, and names that don't clash."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_dir, ship


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor
    without recomputing what came before.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Bytes of an Arrow batch of whole texts, which lies in memory several times; a longer text is a batch.
BATCH_BYTES = 4_000_000


def batched(function):
    """Of a function of a session: bounds the session's Arrow batches to BATCH_BYTES, and sends the package to the executors.

    Plans are lazy, so the bound stays; it changes no result, only how many rows Python gets at once.
    """

    @wraps(function)
    def run(spark: SparkSession, *args, **kwargs):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        ship(spark)
        return function(spark, *args, **kwargs)

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df_or_names, stem: str) -> str:
    """A column name that clashes with none of ``df``'s, whatever their case."""
    names = df_or_names.columns if hasattr(df_or_names, "columns") else df_or_names
    taken = {c.lower() for c in names}
    name, i = stem, 0
    while name.lower() in taken:
        i += 1
        name = f"{stem}{i}"
    return name


def besides(df: DataFrame, new: tuple[str, ...], drop: str | None = None) -> list[int]:
    """Places of ``df``'s columns but ``drop`` and those with the name of one in ``new``, whatever its case: a new column takes the old one's place."""
    taken = {n.lower() for n in new}
    return [i for i, c in enumerate(df.columns) if c != drop and c.lower() not in taken]
