"""Templates that may be one: pairs of frequent templates with common words, to be judged
by a provider. Pairs meet through a word they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape_words(text: Column) -> Column:
    """The set of words: lower case, letters, digits, _ < and >; not numbers alone."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_<>]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$")))


def candidate_pairs(templates: DataFrame, most: int = 60, top: int = 300, least: float = 0.1) -> DataFrame:
    """Of the `top` most frequent templates (template, n): the `most` pairs of different
    text with the largest share of common words; a comes before b by count, then text."""
    from pyspark.sql import Window

    best = templates.orderBy(F.desc("n"), "template").limit(top)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "template"))).withColumn("words", shape_words(F.col("template")))
    one = best.select(F.col("rank").alias("i"), F.col("template").alias("a"), F.size("words").alias("na"), F.explode("words").alias("w"))
    two = best.select(F.col("rank").alias("j"), F.col("template").alias("b"), F.size("words").alias("nb"), F.explode("words").alias("w"))
    both = one.join(two, "w").where("i < j and a <> b").groupBy("i", "j", "a", "b", "na", "nb").agg(F.count("*").alias("common"))
    scored = both.withColumn("jaccard", F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).where(F.col("jaccard") >= least)
    return scored.orderBy(F.desc("jaccard"), "i", "j").limit(most).select("i", "j", "a", "b", "jaccard")


def suggest(pairs: DataFrame, same: Callable[[str, str], float], least: float = 0.8) -> dict:
    """Asks the provider about each pair (at most `most` of them, on the driver). Three
    failures without a success end the pass."""
    rows = pairs.collect()
    checked = failed = 0
    found, error = [], None
    for n, r in enumerate(rows):
        try:
            p = same(r["a"], r["b"])
        except Exception as e:
            failed, error = failed + 1, error or str(e)
            if failed >= 3 and not checked:
                return {"checked": 0, "skipped": len(rows) - n - 1, "failed": failed, "error": error, "suggestions": []}
            continue
        checked += 1
        if p >= least:
            found.append({"a": r["a"], "b": r["b"], "p_same": round(p, 4)})
    found.sort(key=lambda s: -s["p_same"])
    return {"checked": checked, "skipped": 0, "failed": failed, "error": error, "suggestions": found}
