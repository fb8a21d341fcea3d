"""Why a model says so, and what to do: attributions, explanation rows, recommendations (XAI-1..6, PRJ-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import QuarryError, require
from quarry.operators import attribution as T
from quarry.operators import evaluation as E

TOP = 8
EVIDENCE = 5


def finite(x: Column) -> Column:
    """The number, or null where it is none (PRJ-12)."""
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def linear(x: Column, mean: list[float], sd: list[float], coef: list[float], intercept: float) -> dict[str, Column]:
    """Contributions of a scaled linear model, its base (the intercept) and its output (XAI-1); a constant feature scales to 0."""
    scaled = F.zip_with(x, F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, sd, strict=True)]), lambda a, p: F.when(p["s"] != 0, (a.cast("double") - p["m"]) / F.when(p["s"] != 0, p["s"])).otherwise(0.0))
    parts = F.zip_with(scaled, F.array(*[F.lit(float(c)) for c in coef]), lambda a, b: a * b)
    return {"contributions": parts, "base": F.lit(float(intercept)), "output": F.lit(float(intercept)) + F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)}


def ranked(names: list[str], x: Column, contributions: Column, k: int = TOP) -> Column:
    """The k largest contributions as structs: feature, raw_value, contribution, direction, importance, rank (XAI-4).

    Ties go by the order of the features; the array is sorted on its own, so nothing is shuffled.
    """
    one = lambda c, i: F.struct((-F.abs(c)).alias("o"), i.alias("i"), c.alias("c"))
    label = F.array(*map(F.lit, names))
    out = lambda s, r: F.struct(F.get(label, s["i"]).alias("feature"), finite(F.get(x, s["i"])).alias("raw_value"), finite(s["c"]).alias("contribution"), E.direction(s["c"]).alias("direction"), finite(F.abs(s["c"])).alias("importance"), (r + 1).alias("rank"))
    return F.transform(F.slice(F.array_sort(F.transform(contributions, one)), 1, k), out)


def _trees(model) -> T.Ensemble | None:
    """The model's trees, or None where it has none that Shapley values are defined for."""
    if not hasattr(model, "featureImportances"):
        return None
    try:
        return T.of_model(model)
    except QuarryError:
        return None


def explain(model, names: list[str], rows: DataFrame, k: int = TOP) -> DataFrame:
    """rows with method, base_value, output_value and top_features, by what the model is (XAI-6).

    A pipeline with a scaler and a linear model gives its terms; one of trees of two classes, or of a number, exact Shapley
    values (XAI-2, operators.attribution); other trees their importances times the distance from the row's median; any
    other model the values themselves (XAI-3).
    """
    require(k >= 1, "ml_error", "one feature at least")
    require(not [n for n in names if n not in rows.columns], "ml_error", "the rows lack features", missing=[n for n in names if n not in rows.columns])
    last = model.stages[-1] if hasattr(model, "stages") else model
    data = rows.withColumn("_x", F.array(*[F.col(n).cast("double") for n in names]))
    x = F.col("_x")
    if hasattr(last, "coefficients"):
        scaler = next(s for s in model.stages if hasattr(s, "mean"))
        got = linear(x, scaler.mean.toArray().tolist(), scaler.std.toArray().tolist(), last.coefficients.toArray().tolist(), last.intercept)
        method, parts, base, output = "linear_contribution", got["contributions"], got["base"], got["output"]
    elif (trees := _trees(last)) is not None:
        parts = T.contributions(x, trees, len(names))
        method, base = "tree_shapley", F.lit(trees.base)
        data = data.withColumn("_c", parts)
        parts, output = F.col("_c"), F.lit(trees.base) + F.aggregate("_c", F.lit(0.0), lambda s, v: s + v)
    elif hasattr(last, "featureImportances"):
        parts = E.tree_contributions(x, last.featureImportances.toArray().tolist())
        method, base, output = "tree_importance_fallback", F.lit(None).cast("double"), F.lit(None).cast("double")
    else:
        method, parts, base, output = "value_deviation_fallback", x, F.lit(None).cast("double"), F.lit(None).cast("double")
    made = data.withColumn("_c", parts).withColumn("method", F.lit(method)).withColumn("base_value", finite(base)).withColumn("output_value", finite(output))
    return made.withColumn("top_features", ranked(names, x, F.col("_c"), k)).drop("_x", "_c")


#: Title and steps of the advice on a smell.
ADVICE = {
    "god_class": ("Give the class one responsibility", ("Group its methods by the fields that they use.", "Move each group with its fields into a class of its own.", "Leave a thin class that delegates until callers have moved.")),
    "large_class": ("Split the class", ("List what the class is asked for, and by whom.", "Extract the parts that different callers use.", "Keep shared state in one small class.")),
    "data_class": ("Bring behaviour to the data", ("Find code elsewhere that reads and writes these fields.", "Move it into methods here.", "Hide the fields that nobody else needs then.")),
    "lazy_class": ("Fold the class into its users", ("Check that no plan needs the class.", "Move its few members to where they are used.", "Delete it with its tests adapted.")),
    "long_method": ("Cut the method into steps", ("Mark the steps that comments or blank lines set apart.", "Extract each into a method named for its result.", "Pass values instead of sharing locals.")),
    "complex_method": ("Make decisions simpler", ("Return early for the special cases.", "Name compound conditions.", "Replace chains of cases by a table or by classes.")),
    "long_parameter_list": ("Pass fewer things", ("Find parameters that always travel together.", "Put them into one object.", "Drop those that the method can find itself.")),
    "deep_nesting": ("Flatten the control flow", ("Turn conditions round and leave early.", "Extract the body of inner loops.", "Separate finding things from using them.")),
    "feature_envy": ("Move the method to its data", ("See which object the method asks most.", "Move the method, or the part that envies, there.", "Ask that object for results, not for fields.")),
    "message_chain": ("Hide the way to the object", ("Find the object at the end of the chain.", "Let the first object answer for it.", "Use the new method where the chain was repeated.")),
}
DEFAULT = ("Look at what weighs most", ("Read the features that contribute most.", "Refactor in small steps under tests.", "Analyse again after each step."))
CHECKS = ("Run the tests before and after.", "Analyse again and see that the probability and its features fall.", "Read the result: measures are no aim by themselves.")


def recommendations(explained: DataFrame, smell: str = "smell_type", probability: str = "probability") -> DataFrame:
    """Explained predictions with title, summary, priority, actions, evidence of the top features and validation steps (XAI-5)."""
    text = lambda xs: F.array(*map(F.lit, xs))
    advice = F.create_map(*[c for k, (title, steps) in ADVICE.items() for c in (F.lit(k), F.struct(F.lit(title).alias("title"), text(steps).alias("actions")))])
    general = F.struct(F.lit(DEFAULT[0]).alias("title"), text(DEFAULT[1]).alias("actions"))
    chosen = F.coalesce(F.try_element_at(advice, F.col(smell)), general)
    summary = F.concat(F.lit("The model for "), F.replace(F.col(smell), F.lit("_"), F.lit(" ")), F.lit(" gives "), F.format_string("%.1f%%", F.col(probability) * 100), F.lit("."))
    evidence = F.transform(F.slice("top_features", 1, EVIDENCE), lambda t: F.struct(F.regexp_replace(t["feature"], "^feature__", "").alias("metric"), t["raw_value"].alias("value"), t["direction"].alias("direction"), t["contribution"].alias("contribution")))
    return explained.withColumns({"title": chosen["title"], "summary": summary, "priority": E.priority(F.col(probability)), "actions": chosen["actions"], "evidence": evidence, "validation_steps": text(CHECKS)})
