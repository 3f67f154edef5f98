"""Confidence in an answer from the retrieved chunks' sections and scores, in decimals."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights, thresholds and limits.
WEIGHTS = ("0.30", "0.50", "0.20")
HIGH, MEDIUM, FLOOR, MAX_CHUNKS, LOW = "0.75", "0.45", "0.15", 5, "0.15"


#: Scores as decimals: exact, and the same in every engine. As doubles, sums near a tie round as binary numbers do.
DECIMAL, DOUBLE = "decimal(10,6)", "double"


def dec(value: str) -> Column:
    return F.lit(value).cast(DECIMAL)


#: Doubles that are written as ties between two hundredths, but lie below or above them as binary numbers.
TIES = [(2 * k + 1) / 200 for k in range(100)]
BELOW = [t for k, t in enumerate(TIES) if Fraction(t) < Fraction(2 * k + 1, 200)]
ABOVE = [t for k, t in enumerate(TIES) if Fraction(t) > Fraction(2 * k + 1, 200)]


def hundredths(c: Column, kind: str) -> Column:
    """Two places, half to even; a double by its binary value."""
    if kind == DECIMAL:
        return F.bround(c, 2)
    down = F.floor(F.round(c * 1000) / 10)
    return F.when(c.isin(BELOW), down / 100).when(c.isin(ABOVE), (down + 1) / 100).otherwise(F.bround(c, 2))


def sanitized(score: Column) -> Column:
    """AG14: a score between 0 and 1; null where it is below the floor."""
    clamped = F.greatest(dec("0"), F.least(dec("1"), score))
    return F.when(score.isNotNull() & (clamped >= dec(FLOOR)), clamped)


def count_score(n: Column) -> Column:
    """AG10."""
    return (F.least(n, F.lit(MAX_CHUNKS)).cast("decimal(10,6)") / dec("5")).cast("decimal(10,6)")


def similarity_strength(first: Column, second: Column) -> Column:
    """AG11: 0.7 of the best score and 0.3 of the next, rounded half to even; a single score is itself."""
    both = F.bround((dec("0.7") * first + dec("0.3") * second).cast("decimal(12,8)"), 2)
    return F.when(second.isNull(), first).otherwise(both).cast("decimal(10,6)")


def redundancy(unique: Column, total: Column) -> Column:
    """AG12: how concentrated the sections are."""
    steps = F.when(total == 0, "0.4").when(unique == 1, "0.3").when(unique * 10 <= total * 4, "1.0").when(unique * 10 <= total * 6, "0.8").when(unique * 10 <= total * 8, "0.6").otherwise("0.4")
    return steps.cast("decimal(10,6)")


def level(confidence: Column, sections: Column) -> Column:
    """AG13."""
    return F.when((confidence >= dec(HIGH)) & (sections >= 2), "high").when(confidence >= dec(MEDIUM), "medium").otherwise("low")


def signals(chunks: DataFrame) -> DataFrame:
    """Per query of (query_id, section, score): counts, the two best sanitised scores, and the three signals.

    The two best come from a window that streams over a query's rows, so a
    query with any number of chunks is never collected.
    """
    section = F.when(F.col("section") != "", F.col("section"))
    by_score = Window.partitionBy("query_id").orderBy(F.col("clean").desc_nulls_last())
    placed = chunks.select("query_id", section.alias("section"), sanitized(F.col("score")).alias("clean")).withColumn("place", F.row_number().over(by_score))
    g = placed.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("section").alias("n_sections"), F.countDistinct("section").alias("sections"), F.count("clean").cast("int").alias("n_scores"),
        F.max(F.when(F.col("place") == 1, F.col("clean"))).alias("best"), F.max(F.when(F.col("place") == 2, F.col("clean"))).alias("next"),
    )
    return g.select("*", count_score(F.col("n")).alias("count_score"), similarity_strength(F.col("best"), F.col("next")).alias("strength"), redundancy(F.col("sections"), F.col("n_sections")).alias("redundancy"))


def confidence(chunks: DataFrame, kind: str = DECIMAL) -> DataFrame:
    """AG09: value and level per query; low where no score is above the floor.

    `kind` is the type in which the three weighted signals are added up.
    """
    s = signals(chunks)
    weak = F.col("best").isNull() | (F.col("best") <= dec(FLOOR))
    terms = [F.lit(w).cast(kind) * F.col(c).cast(kind) for w, c in zip(WEIGHTS, ("count_score", "strength", "redundancy"), strict=True)]
    total = (terms[0] + terms[1] + terms[2]).cast("decimal(12,8)" if kind == DECIMAL else kind)
    value = F.when(weak, dec(LOW)).otherwise(hundredths(F.greatest(F.lit("0").cast(kind), F.least(F.lit("1").cast(kind), total)), kind).cast(DECIMAL))
    s = s.withColumn("confidence", value)
    return s.select("query_id", "confidence", F.when(weak, "low").otherwise(level(F.col("confidence"), F.col("sections"))).alias("level"))


def first_distinct(pairs: Column, most: int) -> Column:
    """AG06/AG07: distinct values of (rank, value) pairs in order of rank, the first `most`."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.array_sort(pairs), lambda p: p.v), lambda v: v.isNotNull() & (v != ""))), 1, most)


def statistics_of(few: DataFrame, *keys: str) -> DataFrame:
    """AG05–AG08: one row for each key of rows (chunk_type, section, n, rank, total, scored, max_score) that are one for each type and section."""
    pair = lambda c: F.collect_list(F.struct("rank", F.col(c).alias("v")))
    mean = (F.sum("total") / F.sum("scored")).cast("decimal(20,10)")
    return few.groupBy(*keys).agg(
        F.sum("n").cast("int").alias("chunk_count"), F.array_join(first_distinct(pair("chunk_type"), 5), ",").alias("chunk_types"), F.array_join(first_distinct(pair("section"), 10), ",").alias("sections"),
        F.bround(mean, 4).cast("decimal(10,4)").alias("avg_score"), F.bround(F.max("max_score"), 4).cast("decimal(10,4)").alias("max_score"),
    )


def retrieval_stats(chunks: DataFrame) -> DataFrame:
    """AG05–AG08: one statistics row per query of (query_id, rank, section, chunk_type, score).

    Rows are first brought down to one for each type and section of a query, so
    no list is longer than the distinct ones.
    """
    few = chunks.groupBy("query_id", "chunk_type", "section").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"), F.sum("score").alias("total"), F.count("score").alias("scored"), F.max("score").alias("max_score"))
    return statistics_of(few, "query_id")
