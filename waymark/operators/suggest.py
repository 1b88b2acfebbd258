"""Which categories a place's name suggests: a naive Bayes model on words and character n-grams.

Training is a count of features by category; scoring joins a name's features with
the counts. No model leaves the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import fold_text
from waymark.schemas import CATEGORIES

# Smoothing, the share of features that must be known, the spread of scores per feature, suggestions.
ALPHA, KNOWN, SPREAD, MOST = 0.35, 0.6, 0.2, 3
#: Categories that there may be; they are broadcast.
MOST_CATEGORIES = 1000


def features_of(folded: Column) -> Column:
    """array<string> of a folded name: words as w:..., 3- and 4-grams of the padded name as c:..."""
    clean = F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))
    padded = F.concat(F.lit(" "), clean, F.lit(" "))
    grams = lambda n: F.transform(F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("c:"), F.substring(padded, i, F.lit(n))))
    words = F.transform(F.split(clean, " "), lambda w: F.concat(F.lit("w:"), w))
    return F.when(clean != "", F.concat(words, grams(3), grams(4))).otherwise(F.array().cast("array<string>"))


def examples_of(places: DataFrame) -> DataFrame:
    """category, features: of each place (label, category) that has both."""
    p = places.where("category is not null and label is not null").select("category", fold_text("label").alias("folded"))
    return p.select("category", features_of(F.col("folded")).alias("features")).where(F.size("features") > 0)


def counts(places: DataFrame) -> DataFrame:
    """category, feature, n: of the places (label, category) that have a category."""
    p = examples_of(places).select("category", F.explode("features").alias("feature"))
    return p.groupBy("category", "feature").agg(F.count("*").alias("n"))


def suggestions(names: DataFrame, places: DataFrame, order: dict | list = CATEGORIES) -> DataFrame:
    """name, rank, category, score: up to three categories a name, best first; none where too little of it is known.

    names: name. Ties keep the order of categories.
    """
    n = counts(places)
    examples = examples_of(places).groupBy("category").agg(F.count("*").alias("examples"))
    vocabulary = n.select("feature").distinct()
    per = n.groupBy("category").agg(F.sum("n").alias("total")).join(examples, "category")
    every = per.agg(F.sum("examples").alias("all_examples"), F.count("*").alias("categories")).crossJoin(vocabulary.agg(F.count("*").alias("vocabulary")))  # one row
    # what is broadcast is one row, and below a list of categories whose size is checked
    per = per.crossJoin(F.broadcast(every)).withColumn("total", F.when(F.col("categories") <= MOST_CATEGORIES, F.col("total")).otherwise(F.raise_error(F.lit("too many categories")).cast("long")))
    per = per.withColumn("den", F.col("total") + ALPHA * F.col("vocabulary"))
    per = per.withColumn("prior", F.log(F.col("examples") / F.col("all_examples"))).select("category", "den", "prior")
    name = names.select("name").distinct().withColumn("folded", fold_text("name")).withColumn("features", features_of(F.col("folded"))).withColumn("k", F.size("features")).where("k > 0")
    f = name.select("name", "k", F.explode("features").alias("feature"))
    known = f.join(vocabulary, "feature", "left_semi").groupBy("name", "k").agg(F.count("*").alias("known")).where(F.col("known") / F.col("k") >= KNOWN)
    # a category's score is that of a name it knows nothing of, and more for each feature that it has seen
    seen = f.join(n, "feature").groupBy("name", "category").agg(F.sum(F.log((F.col("n") + ALPHA) / ALPHA)).alias("more"))
    pairs = known.select("name", "k").crossJoin(F.broadcast(per))
    s = pairs.join(seen, ["name", "category"], "left").withColumn("score", F.col("prior") + F.col("k") * F.log(F.lit(ALPHA) / F.col("den")) + F.coalesce("more", F.lit(0.0)))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("category")), F.lit(0)), F.lit(1 << 20))
    w = Window.partitionBy("name").orderBy(F.desc("score"), place, "category")
    s = s.withColumn("rank", F.row_number().over(w)).withColumn("best", F.max("score").over(Window.partitionBy("name")))
    return s.where((F.col("rank") <= MOST) & ((F.col("best") - F.col("score")) / F.col("k") <= SPREAD)).select("name", F.col("rank").cast("long").alias("rank"), "category", "score")
