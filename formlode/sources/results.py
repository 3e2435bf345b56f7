"""Results stored by user, session and form: a batch that is written again replaces itself, a form that is saved again its former results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlode.shared import written

FORM = ("user_id", "session_id", "pdf_id")
#: Folders of a batch. A folder for each user and session would be millions of small files.
BUCKETS, SPREAD = 64, 16


def _bucket(user: Column) -> Column:
    return F.pmod(F.xxhash64(user.cast("string")), F.lit(BUCKETS)).cast("int")


def _folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch:08d}"


def write_results(results: DataFrame, path: str, batch: int) -> None:
    """Store rows (user_id, session_id, pdf_id, ..) below ``path`` as the batch of that number, replacing it if it is there.

    A batch has a folder for each bucket of users, in files sorted by user, session and form, so that the files' statistics find a
    form. A hot user's sessions are spread over SPREAD files.
    """
    rows = results.withColumn("user_bucket", _bucket(F.col("user_id")))
    spread = F.pmod(F.xxhash64("session_id", "pdf_id"), F.lit(SPREAD))
    rows = rows.repartition("user_bucket", spread).sortWithinPartitions("user_bucket", *FORM)
    rows.write.mode("overwrite").partitionBy("user_bucket").parquet(_folder(path, batch))


def read_batch(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The rows of one batch as they were stored, whether or not a later one replaced them."""
    return spark.read.parquet(_folder(path, batch)).drop("user_bucket")


def read_results(spark: SparkSession, path: str, user: object | None = None) -> DataFrame:
    """The latest results of each form, of one user if asked for: then only the user's bucket is read.

    Results of a form count from the last batch that holds it; null ids are ids like others.
    """
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    if user is not None:
        # The bucket is a constant, so folders are pruned.
        rows = rows.filter((F.col("user_bucket") == _bucket(F.lit(user))) & (F.col("user_id") == user))
    last = F.max("batch").over(Window.partitionBy(*FORM))
    return rows.withColumn("_last", last).filter("batch = _last").drop("_last", "user_bucket")


#: Rows of one folder that one task writes.
ROWS = 500_000


def write_partitioned(rows: DataFrame, path: str, by: list[str], key: str, most: int = ROWS) -> None:
    """Write rows in folders by columns that are never null, each folder by as many tasks as its number of rows asks for.

    ``key`` deals a folder's rows to its tasks. Rows are read twice, so they should be stored ones.
    """
    sizes = written(rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts")), "sizes")
    tasks = sizes.agg(F.sum("_parts").alias("n")).first().n or 1
    dealt = rows.join(sizes, by).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")))
    dealt.repartition(tasks, *by, "_part").drop("_parts", "_part").write.partitionBy(*by).parquet(path)
