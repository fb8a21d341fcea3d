"""Numeric columns: Halstead suite, maintainability, severity, binary metrics (MET-7, MET-8, MET-9, RUL-3, RUL-4, ML-9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities in rank order, and the excess at which each begins.
SEVERITIES = ("none", "low", "medium", "high", "critical")
BANDS = {"low": 1.0, "medium": 1.5, "high": 2.5, "critical": 4.0}


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or empty where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def halstead(n1: Column, n2: Column, N1: Column, N2: Column) -> dict[str, Column]:
    """The eleven measures from distinct operators, distinct operands and their totals."""
    n1, n2, N1, N2 = (c.cast("double") for c in (n1, n2, N1, N2))
    vocabulary, length = n1 + n2, N1 + N2
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary)).otherwise(0.0)
    difficulty = F.when(n2 > 0, (n1 / 2) * (N2 / n2)).otherwise(0.0)
    effort = difficulty * volume
    named = {"distinct_operators": n1, "distinct_operands": n2, "total_operators": N1, "total_operands": N2, "vocabulary": vocabulary, "length": length, "volume": volume, "difficulty": difficulty, "effort": effort, "time": effort / 18, "bugs": volume / 3000}
    return {f"halstead_{k}": v for k, v in named.items()}


def maintainability(volume: Column, complexity: Column, sloc: Column) -> Column:
    raw = (171 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * complexity - 16.2 * F.log(F.greatest(sloc, F.lit(1.0)))) * 100 / 171
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def compare(op: Column, observed: Column, threshold: Column) -> Column:
    return F.when(op == ">", observed > threshold).when(op == ">=", observed >= threshold).when(op == "<", observed < threshold).when(op == "<=", observed <= threshold)


def excess(op: Column, observed: Column, threshold: Column) -> Column:
    """How far past a threshold a value is, 1 at the threshold; null stands for infinity."""
    over = F.when(threshold <= 0, 1.0 + observed).otherwise(observed / F.when(threshold > 0, threshold))
    under = F.when(observed > 0, F.greatest(F.lit(0.0), threshold / F.when(observed > 0, observed))).when(threshold > 0, F.lit(None).cast("double")).otherwise(1.0)
    return F.when(op.isin(">", ">="), over).otherwise(under)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def severity(value: Column, bands: dict[str, float] | None = None) -> Column:
    """The highest band a value reaches; below all bands it is low."""
    out = F.lit("low")
    for name, start in sorted((bands or BANDS).items(), key=lambda kv: kv[1]):
        out = F.when(value >= start, name).otherwise(out)
    return out


def binary_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Measures of a confusion matrix; 0 where precision, recall or f1 are undefined, null for one-class measures."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    n, pos, neg = tp + fp + fn + tn, tp + fn, fp + tn
    precision, recall = ratio(tp, tp + fp), ratio(tp, pos)
    specificity = ratio(tn, neg, None)
    root = F.sqrt((tp + fp) * pos * neg * (tn + fn))
    return {
        "accuracy": ratio(tp + tn, n, None),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": specificity,
        "balanced_accuracy": F.when((pos > 0) & (neg > 0), (recall + specificity) / 2),
        "mcc": ratio(tp * tn - fp * fn, root),
    }
