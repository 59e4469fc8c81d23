"""Training logs: one line for each logged iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "i int, Time double, Loss double, `Train Accuracy` double, `Test Accuracy` double"


def write_log(spark: SparkSession, rows: list[tuple], path: str) -> None:
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """i, time, loss, train_accuracy, test_accuracy and the file of each line as run."""
    names = ("i", "time", "loss", "train_accuracy", "test_accuracy")
    return spark.read.csv(list(paths), header=True, schema=LOG).toDF(*names).withColumn("run", F.input_file_name())
