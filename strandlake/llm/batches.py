"""Arrow batches that hold whole texts or their ids."""
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROWS = "1000"  # documents to a batch


@contextmanager
def small_batches(spark: SparkSession, rows: str = ROWS):
    """Fewer rows to an Arrow batch, for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
