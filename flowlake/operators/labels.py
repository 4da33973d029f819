"""Labels: truth values, class cascades, taxonomy, dense indices, outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.session import settle


def binary_label(attack: Column) -> Column:
    """0 for benign or missing text, else 1."""
    return F.when(F.lower(F.trim(F.coalesce(attack, F.lit("Benign")))) == "benign", 0).otherwise(1)


def ground_truth(attack: Column, label: Column) -> Column:
    """The attack text, else Benign / Attack from the 0/1 label."""
    return F.coalesce(attack, F.when(label == 0, "Benign").when(label.isNotNull(), "Attack"))


def cic_class(label: Column) -> Column:
    """Class number of a CIC label: exact text first, then the first rule whose words occur; -1 if none."""
    text = F.trim(label)
    upper = F.upper(text)
    exact = F.create_map(*[F.lit(x) for p in fv.CIC_EXACT_LABELS.items() for x in p])
    rules = F.lit(-1)
    for words, value in reversed(fv.CIC_LABEL_RULES):
        rules = F.when(reduce(Column.__or__, [upper.contains(w) for w in words]), value).otherwise(rules)
    return F.coalesce(exact[text], exact[upper], rules)


def taxonomy(attack: Column, default: str | None = None) -> Column:
    """Attack group of a spelling; otherwise ``default``, or the text itself."""
    pairs = [(s, g) for g, spellings in fv.ATTACK_GROUPS.items() for s in spellings]
    groups = F.create_map(*[F.lit(x) for p in pairs for x in p])
    text = F.trim(attack)
    return F.coalesce(groups[text], F.lit(default) if default else text)


def label_index(df: DataFrame, column: str, name: str = "label_idx") -> DataFrame:
    """Dense index by sorted distinct text, 0 for missing text; the index is written so its size is known."""
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    index = settle(distinct.withColumn(name, F.row_number().over(Window.orderBy(column)) - 1), "label-index")
    return df.join(index, column, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def outcome(truth: Column, predicted: Column) -> Column:
    """HIT, MISS, FALSE ALARM or OK from two booleans."""
    return (F.when(truth & predicted, "HIT").when(truth, "MISS").when(predicted, "FALSE ALARM").otherwise("OK"))
