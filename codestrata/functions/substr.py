"""Exact "contains" join between two sets of short strings, through an index of q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Characters of a gram. Patterns that are shorter are filed under themselves.
GRAM = 6


def _pieces(text: Column, n: Column) -> Column:
    """All pieces of ``n`` characters of ``text``; none where it is shorter."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def _filed(patterns: DataFrame, pattern: str) -> DataFrame:
    """(pattern, gram): every pattern under the one of its grams that the fewest patterns have."""
    each = patterns.select(F.col(pattern).alias("_p")).where(F.length("_p") > 0).distinct()
    size = F.least(F.length("_p"), F.lit(GRAM))
    grams = each.select("_p", F.explode(F.array_distinct(_pieces(F.col("_p"), size))).alias("_gram"))
    common = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    return grams.join(common, "_gram").groupBy("_p").agg(F.min(F.struct("_n", "_gram")).alias("_m")).select("_p", F.col("_m._gram").alias("_gram"))


def containing_pairs(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Pairs where ``text`` contains ``pattern``; both sides hold short strings (paths, locations).

    A pattern lies in the index under its rarest gram; a text asks for each of its grams once, and what comes
    back is compared in full. So a text makes about as many rows as it has characters, however many lengths
    the patterns have, and the join is hash partitioned. Null and empty patterns are contained in nothing.
    """
    short = patterns.where((F.length(pattern) > 0) & (F.length(pattern) < GRAM))
    lengths = short.agg(F.sort_array(F.collect_set(F.length(pattern))).alias("_lens")).scalar()  # less than GRAM of them
    rows = texts.withColumn("_lens", F.concat(lengths, F.array(F.lit(GRAM))))
    asked = F.array_distinct(F.flatten(F.transform("_lens", lambda n: _pieces(F.col(text), n))))
    asked = rows.select(*texts.columns, F.explode(asked).alias("_gram"))
    filed = _filed(patterns, pattern)
    index = patterns.join(filed, patterns[pattern] == filed["_p"]).drop("_p")
    return asked.join(index, "_gram").where(F.col(text).contains(F.col(pattern))).drop("_gram")
