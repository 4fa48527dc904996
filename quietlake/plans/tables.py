"""The given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file for each task that searches texts. A row group is one task, however long its texts take.
SPLIT = 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are to be searched, which costs far more than reading them.

    A file may have one row group, hence one task, and row groups of large files are long ones;
    the rows are dealt out first, to all cores and to tasks of bounded size.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    cores = spark.sparkContext.defaultParallelism
    return load(spark, sf_dir, name).repartition(max(cores, size // SPLIT))


#: Rows of a small table from which a task of its own pays.
TASK_ROWS = 2000
#: The same where rows become short texts: sending a task a plan of many patterns costs as much as some hundred of them.
SHORT_ROWS = 10_000


def dealt(spark: SparkSession, sf_dir: str, name: str, rows: int = TASK_ROWS, by: str | None = None) -> DataFrame:
    """A small table whose rows become texts of some size, dealt out to tasks of bounded numbers of rows: its file may be one task, whatever is made of it.

    by: a column whose equal values go to the same task, so that what is made of a row needs no shuffle by it.
    """
    table = load(spark, sf_dir, name)
    return table.repartition(max(spark.sparkContext.defaultParallelism, table.count() // rows), *([by] if by else []))
