"""Labelled samples: balance of classes, splits, confusion, errors, epochs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A table of classes beyond this isn't one of labels; the bound makes broadcasting it safe.
MOST_CLASSES = 10_000


def class_balance(counts: DataFrame) -> DataFrame:
    """counts (class, n) with the percentage by which n deviates from the mean; classes with no rows count."""
    mean = F.avg("n").over(Window.partitionBy())
    return counts.select("class", F.col("n").cast("long").alias("n"), F.round((F.col("n") - mean) / mean * 100, 6).alias("deviation"))


def balance_report(*splits: DataFrame) -> DataFrame:
    """(class, n, deviation) over the rows (class) of all splits together, in the order of classes; no rows give none."""
    counts = reduce(DataFrame.unionByName, [s.select("class") for s in splits]).groupBy("class").agg(F.count("*").alias("n"))
    return class_balance(counts).orderBy("class")


def with_all_classes(counts: DataFrame, classes: DataFrame) -> DataFrame:
    return classes.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """(true_label, pred_label, n) with zero cells, for a small table of classes (label)."""
    few = classes.limit(MOST_CLASSES + 1).count()
    if few > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    cells = classes.select(F.col("label").alias("true_label")).join(F.broadcast(classes.select(F.col("label").alias("pred_label"))))
    counted = predictions.groupBy("true_label", "pred_label").agg(F.count("*").alias("n"))
    return cells.join(counted, ["true_label", "pred_label"], "left").select("true_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n"))


def normalised(matrix: DataFrame) -> DataFrame:
    """Shares of each true class; a class without rows has zeros."""
    total = F.sum("n").over(Window.partitionBy("true_label"))
    return matrix.select("true_label", "pred_label", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.0), 6).alias("share"))


def class_errors(matrix: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0))
    total = F.sum("n")
    return matrix.groupBy("true_label").agg(F.round(1 - F.when(total > 0, hit / total).otherwise(0.0), 6).alias("error"))


def worst_classes(matrix: DataFrame, k: int = 20) -> DataFrame:
    return class_errors(matrix).orderBy(F.desc("error"), "true_label").limit(k)


def worst_submatrix(matrix: DataFrame, k: int = 20) -> DataFrame:
    """The square of the normalised matrix among the k worst classes."""
    worst = F.broadcast(worst_classes(matrix, k).select(F.col("true_label").alias("c")))
    part = normalised(matrix)
    return part.join(worst, part.true_label == worst.c, "left_semi").join(worst, F.col("pred_label") == F.col("c"), "left_semi")


def accuracy(predictions: DataFrame) -> DataFrame:
    """Rows, and accuracy in per cent."""
    hit = (F.col("true_label") == F.col("pred_label")).cast("double")
    return predictions.agg(F.count("*").alias("n"), F.round(F.avg(hit) * 100, 6).alias("accuracy"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    return rows.agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias("mean"))


def overfit(epochs: DataFrame, by: float = 1e-3) -> DataFrame:
    """Epochs (epoch, train, val) at which the validation loss rises while the training loss falls."""
    order = Window.orderBy("epoch")  # a row for each epoch, few
    rises = (F.col("val") - F.lag("val").over(order) > by) & (F.lag("train").over(order) - F.col("train") > by)
    return epochs.select("epoch", F.coalesce(rises, F.lit(False)).alias("overfit"))


def portable_hash(key: Column) -> Column:
    """A number under 1,000,003 from a whole number, the same in every engine."""
    return (key % 1_000_003) * 7_919 % 1_000_003


def split(rows: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """rows with split: val for about the share, by a hash of the key; else train."""
    return rows.withColumn("split", F.when(portable_hash(F.col(key)) < int(share * 1_000_003), "val").otherwise("train"))


def sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows without replacement, the same ones every time."""
    return rows.orderBy(portable_hash(F.col(key)), key).limit(n)


def save_matrix(matrix: DataFrame, path: str) -> None:
    """The cells of a matrix that aren't zero."""
    matrix.where("n > 0").write.mode("overwrite").parquet(path)


def save_epoch(metrics: DataFrame, path: str) -> None:
    """Add an epoch's numbers to the table from which a run resumes."""
    metrics.write.mode("append").parquet(path)


def next_epoch(metrics: DataFrame) -> int:
    """The epoch to go on with: 1 where none has been saved."""
    return (metrics.agg(F.max("epoch")).first()[0] or 0) + 1
