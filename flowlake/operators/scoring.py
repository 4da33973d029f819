"""Scorers and decisions.

A scorer is a function DataFrame -> DataFrame that adds ``is_attack``, ``confidence`` and ``attack_type``.  Scorers are
registered by name; the decision step matches rules first, so only rows without a verdict reach the scorer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators.rules import match_rules

Scorer = Callable[[DataFrame], DataFrame]
_SCORERS: dict[str, Scorer] = {}
OUTPUT = ("is_attack", "confidence", "attack_type")
# Fixed value: probability above which the forest scorer reports an attack.
FOREST_THRESHOLD = 0.40


def register_scorer(name: str, scorer: Scorer) -> None:
    _SCORERS[name] = scorer


def scorer(name: str) -> Scorer:
    if name not in _SCORERS:
        raise KeyError(f"no scorer named {name!r}; registered: {sorted(_SCORERS)}")
    return _SCORERS[name]


def score(df: DataFrame, name: str) -> DataFrame:
    """Rows with the three output columns of scorer ``name``."""
    out = scorer(name)(df)
    missing = [c for c in OUTPUT if c not in out.columns]
    if missing:
        raise ValueError(f"scorer {name!r} did not add {missing}")
    return out


def placeholder(df: DataFrame) -> DataFrame:
    """Always benign: stands in until a model is loaded."""
    return df.withColumns({"is_attack": F.lit(False), "confidence": F.lit(0.0),
                           "attack_type": F.lit("ModelNotLoaded")})


register_scorer("placeholder", placeholder)


def decide(p_attack: Column, threshold: float) -> dict[str, Column]:
    """Attack when the probability is above the threshold."""
    hit = p_attack > threshold
    return {"is_attack": hit, "confidence": p_attack, "attack_type": F.when(hit, "Malicious").otherwise("Benign")}


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    weights = [F.exp(x - top) for x in logits]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def argmax(values: list[Column]) -> Column:
    """Index of the largest value, the first one on ties."""
    top = F.greatest(*values)
    return F.array_position(F.array(*values), top).cast("int") - 1


def decide_binary(benign: Column, attack: Column) -> dict[str, Column]:
    """Two logits: attack when its logit is larger; confidence is its softmax share."""
    hit = attack > benign
    return {"is_attack": hit, "confidence": softmax([benign, attack])[1],
            "attack_type": F.when(hit, "Malicious").otherwise("Benign")}


def decide_classes(logits: list[Column], names: list[str] = fv.CLASS_NAMES) -> dict[str, Column]:
    """Class logits: attack when the best class is not the first; confidence is one minus the benign share."""
    best = argmax(logits)
    listed = F.array(*[F.lit(n) for n in names])
    return {"is_attack": best != 0, "confidence": 1 - softmax(logits)[0],
            "attack_type": F.coalesce(F.get(listed, best), F.lit("Unknown"))}


def clean_features(features: Column) -> Column:
    """Map values that are NaN or infinite become 0."""
    return F.transform_values(features, lambda _, v: F.when(
        F.isnan(v) | v.isin(float("inf"), float("-inf")), 0.0).otherwise(v))


def source_ip(source: Column) -> Column:
    return F.trim(F.substring_index(source, "->", 1))


def raise_alerts(flows: DataFrame, rules: DataFrame, scorer_name: str) -> DataFrame:
    """Alerts for flows with ``source`` and a ``features`` map.

    Addresses on the allow list are benign with confidence 0, on the deny list attacks with confidence 1; for all
    other rows the scorer decides.  Rows are read, matched and scored in one pass.
    """
    cleaned = flows.withColumns({"features": clean_features(F.col("features")),
                                 "src_ip": source_ip(F.col("source"))})
    matched = match_rules(cleaned, "src_ip", rules)
    listed, deny = F.col("verdict").isNotNull(), F.col("verdict") == "blacklist"
    scored = score(matched, scorer_name)
    return scored.withColumns({
        "is_attack": F.when(listed, deny).otherwise(F.col("is_attack")),
        "confidence": F.when(deny, 1.0).when(listed, 0.0).otherwise(F.col("confidence")),
        "attack_type": F.when(deny, "Blacklisted").when(listed, "Whitelisted").otherwise(F.col("attack_type")),
    }).drop("src_ip", "verdict")
