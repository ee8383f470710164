"""Mixing sources to target weights, by DataFrame functions alone.

Method.  Every document gets a hash-random key.  Within its source the documents stand in key order; the words before
each one are a distributed prefix sum (ranges of the key first, then rows inside a range), so a source that holds a
third of all rows is spread over many tasks.  A source's budget is its target rounded to whole words: it is taken in
whole passes over the source (epochs) and one last pass that is cut at exactly the words left.

Null text has no words.  A null source is a source of its own, last in order.  Rows alike in every column share their
places in any order, which changes no result row.  No documents: no rows.  Keys come from md5 of the seed and doc_id,
so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable, random_key, running_before, word_count

SEED = 11


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source, few against the documents.

    Sources in code point order, null last, take the weights in turn.  A source stops at most_epochs times its size;
    its excess goes to the others by weight.  That fills up the sources in order of size per weight, so those that
    stop come first in that order and one rate (words per weight) holds for all the rest.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("long"))
    weighed = weighed.withColumn("most", F.col("source_size") * most_epochs)
    before = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = before.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    filled = weighed.withColumns({
        "all_words": F.sum("source_size").over(everything),
        "all_weight": F.sum("weight").over(everything),
        "full_words": F.coalesce(F.sum("most").over(before), F.lit(0)),
        "full_weight": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    filled = filled.withColumn("stops", F.expr(
        "most * (all_weight - full_weight) <= weight * (all_words - full_words)"))
    filled = filled.withColumns({
        "words_left": F.col("all_words") - F.coalesce(F.sum(F.expr("IF(stops, most, 0)")).over(everything), F.lit(0)),
        "weight_left": F.col("all_weight") - F.coalesce(F.sum(F.expr("IF(stops, weight, 0)")).over(everything), F.lit(0)),
    })
    return filled.select("source", "source_size", F.expr(
        "IF(stops, CAST(most AS DOUBLE), weight * (CAST(words_left AS DOUBLE) / CAST(weight_left AS DOUBLE)))"
    ).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: int = SEED,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target (its source's) and taken: words the mix takes, repeats counted.

    carry: further columns of docs to keep.  They travel with the sort, so pass short ones.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                        random_key(F.col("doc_id"), seed=seed).alias("_key"), *carry)
    sized = durable(sized)
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs)
    targets = targets.withColumnRenamed("source", "_source")
    placed = running_before(sized, ["source"], "_key", ["doc_id", "size"], {"before": "size"})
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    last = budget - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("before")))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def oracle(weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: int = SEED) -> str:
    """The same rows in DuckDB's SQL, with one ordered sum per source and no ranges."""
    choices = ", ".join(map(str, weights))
    return rf"""
WITH sized AS (
    SELECT doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS k
    FROM documents),
named AS (
    SELECT source, sum(size)::HUGEINT AS s,
           ([{choices}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT] AS w
    FROM sized GROUP BY source),
totals AS (SELECT sum(s) AS all_s, sum(w) AS all_w FROM named),
ordered AS (
    SELECT *, coalesce(sum({most_epochs} * s) OVER u, 0) AS fs, coalesce(sum(w) OVER u, 0) AS fw
    FROM named, totals
    WINDOW u AS (ORDER BY ({most_epochs} * s)::DOUBLE / w, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, {most_epochs} * s * (all_w - fw) <= w * (all_s - fs) AS stops FROM ordered),
rate AS (
    SELECT (any_value(all_s) - coalesce(sum({most_epochs} * s) FILTER (stops), 0))::DOUBLE
           / nullif((any_value(all_w) - coalesce(sum(w) FILTER (stops), 0))::DOUBLE, 0) AS r
    FROM capped),
target AS (
    SELECT source, s, CASE WHEN stops THEN ({most_epochs} * s)::DOUBLE ELSE w * r END AS t FROM capped, rate),
placed AS (
    SELECT sized.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized)
SELECT doc_id, size, s::BIGINT AS source_size, t AS target,
       (CASE WHEN s > 0 THEN floor(t + 0.5)::BIGINT // s ELSE 0 END * size
        + greatest(0, least(size, CASE WHEN s > 0 THEN floor(t + 0.5)::BIGINT % s ELSE 0 END - before)))::BIGINT AS taken
FROM placed JOIN target ON placed.source IS NOT DISTINCT FROM target.source
"""
