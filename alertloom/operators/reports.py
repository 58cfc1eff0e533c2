"""Counts, classification reports and the rule inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("row_count"))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", classes: tuple = (0, 1)) -> DataFrame:
    """One row per label, one column per predicted class."""
    counts = confusion_counts(df, label, prediction)
    cells = [
        F.coalesce(F.sum(F.when(F.col("prediction") == c, F.col("n"))), F.lit(0)).cast("long").alias(f"predicted_{c}")
        for c in classes
    ]
    return counts.groupBy("label").agg(*cells)


def _ratio(top, bottom):
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", names: dict | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs, then accuracy and both averages.

    One pass counts (label, prediction) pairs; all else is arithmetic on those few rows.
    """
    names = names or {0: "Benign", 1: "Malicious"}
    counts = confusion_counts(df, label, prediction)
    # Each pair of counts feeds its label's support and its prediction's total.
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("label").cast("long").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("prediction").cast("long").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s")
    ).groupBy("s.c").agg(*[F.sum(f"s.{m}").alias(m) for m in ("support", "predicted", "hit")])
    precision = _ratio(F.col("hit"), F.col("predicted"))
    recall = _ratio(F.col("hit"), F.col("support"))
    f1 = _ratio(2 * F.col("hit"), F.col("predicted") + F.col("support"))
    label_name = F.col("c").cast("string")
    for key, text in names.items():
        label_name = F.when(F.col("c") == key, F.lit(text)).otherwise(label_name)
    classes = sides.select(
        label_name.alias("name"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hit"
    )
    mean = lambda c: F.avg(c).alias(c)
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    support = F.sum("support").alias("support")
    share = F.sum("hit") / F.sum("support")
    accuracy = classes.agg(
        F.lit("accuracy").alias("name"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), share.alias("f1"), support,
    )
    macro = classes.agg(F.lit("macro avg").alias("name"), *[mean(c) for c in ("precision", "recall", "f1")], support)
    average = classes.agg(F.lit("weighted avg").alias("name"), *[weighted(c) for c in ("precision", "recall", "f1")], support)
    return classes.drop("hit").unionByName(accuracy).unionByName(macro).unionByName(average)


def rule_inventory(rules: DataFrame) -> DataFrame:
    """Rules and duplicates, then the rules by protocol and port side."""
    per_text = rules.groupBy("rule_text").agg(F.count(F.lit(1)).alias("copies"))
    totals = per_text.agg(
        F.sum("copies").alias("total"), F.sum(F.col("copies") - 1).alias("duplicates")
    ).select(
        F.explode(F.map_from_arrays(
            F.array(F.lit("total rules"), F.lit("duplicate rules")),
            F.array("total", "duplicates"),
        )).alias("item", "rule_count")
    )
    src, dst = F.col("src_port") != "any", F.col("dst_port_text") != "any"
    side = F.when(src & dst, "both").when(src, "src").when(dst, "dst").otherwise("any")
    by_side = rules.groupBy(F.concat_ws(" ", "proto", side).alias("item")).agg(F.count(F.lit(1)).alias("rule_count"))
    return totals.unionByName(by_side)
