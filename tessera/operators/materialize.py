"""Cut lineage by writing a table into the shared checkpoint folder and reading it back.

Used where an intermediate is read by several later jobs (it is computed once) and inside
iterative jobs (the plan stays small). The folder comes from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.session import shared_dir


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if partition_by else spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getParent().getName() == "tables":  # only what shared_dir gave
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
