"""Confidence, health and similarity arithmetic as column functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# fixed values: weights and thresholds
CONFIDENCE_WEIGHTS = {"agreement": 0.18, "faithfulness": 0.18, "validity": 0.13, "structural": 0.13, "description": 0.09, "provenance": 0.09, "property_agreement": 0.09, "evidence_count": 0.06, "evidence_age": 0.05}
HEALTH_WEIGHTS = {"completeness": 0.20, "connectivity": 0.20, "structure": 0.15, "confidence": 0.20, "properties": 0.15, "sources": 0.10}
ER_WEIGHTS = {"label": 0.4, "description": 0.3, "uri": 0.2, "topology": 0.1}
ER_THRESHOLD = 0.7
TOPOLOGY_WEIGHTS = (0.35, 0.30, 0.15, 0.20)
TOUCHPOINT_WEIGHTS = (0.30, 0.25, 0.15, 0.15, 0.15)
MATCH_WEIGHTS = {"label": 0.4, "description": 0.2, "structural": 0.4}
ANCHOR = 0.6
HALF_LIFE_DAYS, EVIDENCE_FULL, DECAY_FLOOR = 90.0, 5, 0.05
CYCLE_PENALTY = 0.3


def clamp(c: Column) -> Column:
    """c within 0..1; null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def structural_score(datatype_props: Column, object_props: Column, parent: Column, children: Column, lateral: Column) -> Column:
    """0.15 for datatype properties, 0.10 for each object property up to 0.30, and parts for hierarchy and other edges."""
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    total = flag(datatype_props > 0, 0.15) + F.least(object_props * 0.10, F.lit(0.30)) + flag(parent, 0.20) + flag(children, 0.15) + flag(lateral, 0.20)
    return F.least(F.lit(1.0), total)


def description_score(description: Column, copies: Column) -> Column:
    """copies: rows that have the same description."""
    n = F.length(F.coalesce(description, F.lit("")))
    return F.least(n / 100, F.lit(1.0)) * 0.7 + F.when((n >= 20) & (copies <= 1), 0.3).otherwise(0.0)


def provenance_score(n: Column) -> Column:
    return F.least(n / 3, F.lit(1.0))


def evidence_count_score(n: Column) -> Column:
    return F.coalesce(F.least(n / EVIDENCE_FULL, F.lit(1.0)), F.lit(1.0))


@pandas_udf(DoubleType())
def power_of_two(x: pd.Series) -> pd.Series:
    """2 to the x to the last bit as C gives it, which Spark's pow misses for some x."""
    return pd.Series([math.inf if v >= 1024 else math.pow(2.0, v) for v in x], dtype="float64")


def evidence_age_score(seconds: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """Halves every half life; 1 for null and negative ages."""
    return F.when(seconds >= 0, F.pow(F.lit(2.0), -seconds / (half_life_days * 86400))).otherwise(F.lit(1.0))


def evidence_growth(seconds: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """As evidence_age_score, but negative ages, of evidence dated ahead, double it every half life."""
    return F.when(seconds.isNotNull(), power_of_two(-seconds / (half_life_days * 86400))).otherwise(F.lit(1.0))


def class_confidence(signals: dict[str, Column]) -> Column:
    """Weighted sum of the nine signals, clamped; missing ones count as 0."""
    total = sum((F.coalesce(clamp(signals[k]), F.lit(0.0)) * w for k, w in CONFIDENCE_WEIGHTS.items() if k in signals), F.lit(0.0))
    return F.bround(clamp(total), 3)


def decayed(confidence: Column, age_seconds: Column, half_life_days: float = HALF_LIFE_DAYS, floor: float = DECAY_FLOOR) -> Column:
    down = confidence * F.pow(F.lit(2.0), -F.greatest(age_seconds, F.lit(0.0)) / (half_life_days * 86400))
    return F.least(confidence, F.greatest(F.lit(floor), down))


def edge_confidence(explicit: Column, evidence: Column) -> Column:
    """An explicit value of 0 or more, clamped; else the mean of clamped evidence; else null."""
    given = F.filter(evidence, lambda x: x.isNotNull())
    mean = F.aggregate(given, F.lit(0.0), lambda s, x: s + clamp(x)) / F.when(F.size(given) > 0, F.size(given))
    return F.when(explicit >= 0, clamp(explicit)).otherwise(mean)


def health_score(completeness: Column, connectivity: Column, has_cycles: Column, orphans: Column, classes: Column, confidence: Column, properties: Column, chunks: Column) -> Column:
    """0..100 of an ontology, halves rounded to even; three properties and one chunk for each class are full marks."""
    per_class = lambda n: F.coalesce(n / F.when(classes > 0, classes), F.lit(0.0))
    structure = F.greatest(F.lit(0.0), 1.0 - F.when(has_cycles, CYCLE_PENALTY).otherwise(0.0) - per_class(orphans))
    one = F.lit(1.0)
    w = HEALTH_WEIGHTS
    raw = F.least(completeness, one) * w["completeness"] + F.least(connectivity, one) * w["connectivity"] + structure * w["structure"]
    raw = raw + confidence * w["confidence"] + F.least(per_class(properties) / 3.0, one) * w["properties"] + F.least(per_class(chunks), one) * w["sources"]
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw * 100, 0).cast("int")))


def topology_similarity(props: Column, parents: Column, children: Column, everything: Column) -> Column:
    a, b, c, d = TOPOLOGY_WEIGHTS
    return props * a + parents * b + children * c + everything * d


def blend(signals: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean over the signals that aren't null, 0 without any."""
    total = sum((F.coalesce(s, F.lit(0.0)) * w for s, w in signals.values()), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in signals.values()), F.lit(0.0))
    return F.coalesce(total / F.when(weight > 0, weight), F.lit(0.0))


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def jaro_winkler_pair(a: str | None, b: str | None) -> float:
    """Jaro-Winkler of lower-cased strings: half transpositions count, the prefix bonus (up to 4 x 0.1) always."""
    a, b = (a or "").lower(), (b or "").lower()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, hit in zip(b, used) if hit]
    m, half = len(left), sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_pair(x, y) for x, y in zip(a, b)], dtype=float)


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two normalised labels; 0 if either is empty."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype=float)


def nearest_rank(sorted_values: Column, percent: float) -> Column:
    """Nearest-rank percentile of a sorted array."""
    n = F.size(sorted_values)
    at = F.greatest(F.lit(1), F.ceil(n * (percent / 100)).cast("int"))
    return F.when(n > 0, F.element_at(sorted_values, at))


def half_lives(seconds: float, days: float = HALF_LIFE_DAYS) -> float:
    return math.pow(2.0, -seconds / (days * 86400)) if seconds >= 0 else 1.0
