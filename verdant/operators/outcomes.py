"""Verdicts of closed-class and component answers, and the tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.functions.matching import stripped
from verdant.functions.normalize import component_tokens, vendor_token

COMPONENT_OUTCOMES = ["Match", "Partial", "No Match", "Declined", "Malformed"]
OUTCOMES = ["Correct", "Incorrect", "Unmapped", "Declined", "Malformed"]


def closed_class_outcome(has_block: Column, raw: Column, predicted: Column, truth: Column) -> Column:
    """No block: Malformed; null: Declined; no class: Unmapped; else Correct or Incorrect (V1)."""
    return (
        F.when(~has_block, "Malformed").when(raw.isNull(), "Declined").when(predicted.isNull(), "Unmapped")
        .when(predicted == truth, "Correct").otherwise("Incorrect")
    )


def component_outcome(answer: Column, truths: Column, has_block: Column | None = None) -> Column:
    """No block: Malformed; blank: Declined; tokens contain or are contained: Match; a vendor named: Partial (V2)."""
    own = component_tokens(answer)

    def matches(t: Column) -> Column:
        other = component_tokens(t)
        return (F.size(own) > 0) & (F.size(other) > 0) & ((F.size(F.array_except(other, own)) == 0) | (F.size(F.array_except(own, other)) == 0))

    return (
        F.when(~(F.lit(True) if has_block is None else has_block), "Malformed").when(answer.isNull() | (stripped(answer) == ""), "Declined").when(F.exists(truths, matches), "Match")
        .when(F.exists(truths, lambda t: F.coalesce(F.array_contains(own, vendor_token(t)), F.lit(False))), "Partial").otherwise("No Match")
    )


def outcome_counts(rows: DataFrame, cell: list[str], outcomes: list[str] = OUTCOMES) -> DataFrame:
    """A row per cell, a column per outcome, zeros kept (A1)."""
    return rows.groupBy(*cell).agg(*(F.count_if(F.col("outcome") == o).alias(o.lower().replace(" ", "_")) for o in outcomes), F.count("*").alias("n"))


def confusion(rows: DataFrame, cell: list[str]) -> DataFrame:
    """truth x (predicted class, or the outcome where there is none): long form (A2)."""
    seen = F.when(F.col("outcome").isin("Correct", "Incorrect"), F.col("predicted")).otherwise(F.col("outcome"))
    return rows.groupBy(*cell, "truth", seen.alias("seen")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame, cell: list[str], classes: list[str]) -> DataFrame:
    """tp, fp, fn, support, precision, recall and F1 of every class of every cell (A3, A4)."""
    wide = [F.explode(F.array(*(F.struct(F.lit(c).alias("class"), *flags) for c, flags in ((c, _flags(c)) for c in classes))))]
    each = matrix.select(*cell, "n", wide[0].alias("x")).select(*cell, "n", "x.*")
    sums = each.groupBy(*cell, "class").agg(*(F.coalesce(F.sum(F.when(F.col(k), F.col("n"))), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, 0.0).otherwise(tp / (tp + fn))
    out = sums.withColumns({"support": tp + fn, "precision": p, "recall": r, "precision_undefined": tp + fp == 0})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def _flags(c: str) -> list[Column]:
    truth, seen = F.coalesce(F.col("truth") == c, F.lit(False)), F.coalesce(F.col("seen") == c, F.lit(False))
    return [(truth & seen).alias("tp"), (~truth & seen).alias("fp"), (truth & ~seen).alias("fn")]


def scores(rows: DataFrame, cell: list[str], classes: list[str], supported_from: int = 20) -> DataFrame:
    """Macro-F1 over all and over well-supported classes, accuracy, commit and no-prediction rates.

    Everything comes from the confusion table, so the rows are aggregated once.
    """
    matrix = confusion(rows, cell)
    tables = per_class(matrix, cell, classes).groupBy(*cell).agg(
        F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") >= supported_from, F.col("f1"))).alias("macro_f1_supported")
    )

    def share(of: Column) -> Column:
        return F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)) / F.sum("n")

    committed = F.col("seen").isin(classes)
    own = matrix.groupBy(*cell).agg(
        F.sum("n").alias("total"), share(F.col("seen") == F.col("truth")).alias("accuracy"), share(committed).alias("commit_rate"), share(~committed).alias("no_prediction_rate")
    )
    return own.withColumnRenamed("total", "n").join(tables, cell)


def unbalanced_cells(rows: DataFrame, cell: list[str], classes: list[str]) -> DataFrame:
    """Cells whose tp + fn over the classes is not the number of their rows, or whose outcomes do not add up to it."""
    matrix = confusion(rows, cell)
    sums = per_class(matrix, cell, classes).groupBy(*cell).agg(F.sum("support").alias("supported"))
    counts = outcome_counts(rows, cell).withColumn("counted", sum((F.col(o.lower()) for o in OUTCOMES), F.lit(0)))
    return counts.join(sums, cell).filter("supported <> n or counted <> n").select(*cell, "n", "supported", "counted")


def binary_scores(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Match metrics without false positives: precision is 1 or 0, F1 = 2r / (1 + r), and the counts' rates."""
    n = F.count("*")
    r = F.count_if(F.col("outcome") == "Match") / n
    counts = {o: F.count_if(F.col("outcome") == o) for o in COMPONENT_OUTCOMES}
    none = counts["Declined"] + counts["Malformed"]
    return rows.groupBy(*cell).agg(
        n.alias("n"), counts["Match"].alias("matched"), counts["Partial"].alias("partial"), counts["No Match"].alias("no_match"), counts["Declined"].alias("declined"), counts["Malformed"].alias("malformed"),
        F.when(counts["Match"] > 0, 1.0).otherwise(0.0).alias("precision"), r.alias("recall"), r.alias("accuracy"), (2 * r / (1 + r)).alias("f1"),
        (counts["Partial"] / n).alias("partial_rate"), (counts["No Match"] / n).alias("no_match_rate"), (none / n).alias("no_prediction_rate"),
    )


def across_cells(table: DataFrame, cell: list[str], cells: list[tuple]) -> DataFrame:
    """Per-class F1, one column f1_<cell> for each of the named cells."""
    here = [(F.max(F.when(F.array(*(F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(cell, own))) == F.array(*[F.lit(True)] * len(cell)), F.col("f1")))).alias("f1_" + "_".join(map(str, own))) for own in cells]
    return table.groupBy("class").agg(*here)
