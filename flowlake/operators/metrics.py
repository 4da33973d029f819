"""Quality metrics from predictions: confusion, F1 family, exact AUROC, recall per attack, protocol results.

All metrics start from counts per (group, truth, prediction) or per (group, score), taken with partial aggregation, so
the later steps see a few rows per group whatever the input size.  ``weight`` names a column of row counts, for input
that is counted already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.operators.ordered import range_buckets, running_totals
from flowlake.session import settle


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def tally(cond: Column, weight: str | None) -> Column:
    """Rows that meet ``cond``, each counted ``weight`` times."""
    return F.count_if(cond) if weight is None else F.coalesce(F.sum(F.when(cond, F.col(weight))), F.lit(0))


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Binary counts tp, tn, fp, fn per group."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    return df.groupBy(*by).agg(*[tally(c, weight).alias(n) for n, c in (
        ("tp", y & p), ("tn", ~y & ~p), ("fp", ~y & p), ("fn", y & ~p))])


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, FPR, specificity and F1 from confusion counts."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({
        "accuracy": share(tp + tn, tp + tn + fp + fn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn),
        "fpr": share(fp, fp + tn), "specificity": share(tn, tn + fp), "f1": share(2 * tp, 2 * tp + fp + fn)})


def class_metrics(df: DataFrame, truth: str, predicted: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Precision, recall, F1, support per class seen in truth or prediction."""
    pairs = df.groupBy(*by, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(
        tally(F.lit(True), weight).alias("n"))
    sides = pairs.select(*by, "n", F.explode(F.array(
        F.struct(F.col("t").alias("cls"), F.lit(True).alias("true"), (F.col("t") == F.col("p")).alias("hit")),
        F.struct(F.col("p").alias("cls"), F.lit(False).alias("true"), F.lit(False).alias("hit")))).alias("s"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    per = sides.groupBy(*by, F.col("s.cls").alias("cls")).agg(
        total(F.col("s.hit")).alias("hits"), total(F.col("s.true")).alias("support"),
        total(~F.col("s.true")).alias("predicted"))
    return per.withColumns({"precision": share(F.col("hits"), F.col("predicted")),
                            "recall": share(F.col("hits"), F.col("support")),
                            "f1": share(2 * F.col("hits"), F.col("support") + F.col("predicted"))})


def averaged_metrics(per_class: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted averages from per-class rows."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"{c}_weighted")
    return per_class.groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"), F.sum("support").alias("n"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c) for c in ("precision", "recall", "f1")])


def auroc(df: DataFrame, truth: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Exact area under the ROC curve per group, ties counted half; 0 when a group has one class only.

    Rows are first counted per distinct score.  Approximate quantiles of these scores cut long lists into ranges, so
    that no task has to walk all scores of a group, however many there are and however they are spread.
    """
    y = F.col(truth) == 1
    scores = settle(df.groupBy(*by, F.col(score).alias("score")).agg(
        tally(y, weight).alias("pos"), tally(~y, weight).alias("neg")), "scores")
    below = running_totals(range_buckets(scores, "score", "bucket"), by, "bucket", ["score"], {"neg_upto": F.col("neg")})
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2)
    return below.groupBy(*by).agg(share(F.sum(won), F.sum("pos") * F.sum("neg")).alias("auroc"),
                                  F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def auroc_one_vs_rest(df: DataFrame, truth: str, scores: list[str]) -> DataFrame:
    """Macro average of one-vs-rest AUROC; class k is scored by ``scores[k]``.

    0 for the whole if a class has no positive or no negative row, as the average isn't defined then.
    """
    each = df.select(F.col(truth).alias("t"), F.posexplode(F.array(*scores)).alias("cls", "score"))
    each = each.withColumn("is_cls", (F.col("t") == F.col("cls")).cast("int"))
    per = auroc(each, "is_cls", "score", ["cls"])
    whole = F.min(F.least("n_pos", "n_neg")) > 0
    return per.agg(F.when(whole, F.avg("auroc")).otherwise(0.0).alias("auroc_macro"), F.count("*").alias("classes"))


def recall_by(df: DataFrame, attack: str, truth: str, predicted: str) -> DataFrame:
    """Recall per attack name, largest groups first."""
    hit = F.count_if(F.col(predicted) == 1)
    return (df.filter(F.col(truth) == 1).groupBy(attack).agg(hit.alias("caught"), F.count("*").alias("n"))
            .withColumn("recall", F.col("caught") / F.col("n")).orderBy(F.desc("n"), attack))


def protocol_counts(df: DataFrame, test_split: Column, adapted: DataFrame, shots: list[int], keys: list[str]) -> DataFrame:
    """Rows per evaluation and ``keys`` as counts ``n``: a = test split of each dataset, b = whole held-out dataset, c =
    held-out rows not used for adaptation, per shot count.

    The rows are counted once; every protocol is a sum of these counts, in which the few rows of ``adapted`` (``dataset``, ``keys``
    and ``shots``, one row for each use) weigh -1.
    """
    parts = settle(df.groupBy("dataset", *keys, test_split.alias("__test")).agg(F.count("*").alias("n")), "protocol-parts")
    kind = lambda name, n: F.struct(F.lit(name).alias("protocol"), F.lit(n).alias("shots"))
    kinds = F.array_compact(F.array(F.when(F.col("__test"), kind("a", 0)), kind("b", 0), *[kind("c", n) for n in shots]))
    used = adapted.select("dataset", *keys, F.lit("c").alias("protocol"), "shots", F.lit(-1).cast("long").alias("n"))
    both = parts.select("dataset", *keys, F.explode(kinds).alias("k"), "n").select("dataset", *keys, "k.*", "n").unionByName(used)
    return both.groupBy("protocol", "dataset", "shots", *keys).agg(F.sum("n").alias("n")).where("n > 0")


def protocol_results(counts: DataFrame, truth: str, predicted: str, score: str) -> DataFrame:
    """Accuracy, macro F1, AUROC and FPR per (protocol, dataset, shots), all from one count of the rows per score."""
    by = ["protocol", "dataset", "shots"]
    counted = settle(counts, "counted")
    macro = averaged_metrics(class_metrics(counted, truth, predicted, by, "n"), by).select(*by, "n", "accuracy", "f1_macro")
    fpr = binary_metrics(confusion(counted, truth, predicted, by, "n")).select(*by, "fpr")
    return macro.join(fpr, by).join(auroc(counted, truth, score, by, "n").select(*by, "auroc"), by)


def comparison_table(results: DataFrame) -> DataFrame:
    """Printable rows per (phase, protocol, dataset, shots)."""
    four = lambda c: F.format_string("%.4f", F.col(c)).alias(c)
    return results.select(
        "phase", F.upper("protocol").alias("protocol"), "dataset",
        F.when(F.col("shots") > 0, F.col("shots").cast("string")).otherwise("-").alias("shots"),
        *[four(c) for c in ("accuracy", "f1_macro", "auroc", "fpr")]).orderBy("phase", "protocol", "dataset", "shots")


def mean_absolute_rank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Features by mean absolute attribution, largest first; one aggregation, then the single row is unpivoted."""
    one = df.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "importance").orderBy(F.desc("importance"), "feature")


def weighted_parameters(updates: DataFrame, params: str, weight: str) -> DataFrame:
    """Weighted average of parameter arrays by position: (idx, value)."""
    each = updates.select(weight, F.posexplode(params).alias("idx", "v"))
    return each.groupBy("idx").agg((F.sum(F.col("v") * F.col(weight)) / F.sum(weight)).alias("value"))
