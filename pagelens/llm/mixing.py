"""Mixing sources to target weights: hash-random order, distributed prefix sums and exact cuts (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, stored, unused, without

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    """Words of the corpus' rule; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(rows: DataFrame, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` and, under each name of ``values``, that value's sum over all rows that stand before in ``order``.

    Rows are range-sorted; running sums inside a partition go on from those of the partitions before, a row each.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    blocks = dealt.groupBy("part").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    starts = blocks.select("part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_start") for n in values])
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = [(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"{n}_start")).alias(n) for n, v in values.items()]
    return dealt.join(starts, "part").select(*rows.columns, *sums)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from one row ``(source, source_size)`` for each source.

    Sources by code point, null last, weigh ``weights`` in turn and share all sizes. A target stops at ``max_epochs``
    times its source; the excess goes to the others by weight until none is above. Sources fill up in the order of
    limit over weight, so the ones that stop are a prefix of that order and running sums find them. Sums over all
    sources come to the driver as one row; the sources themselves, which may be as many as domains, stay dealt out.
    """
    name = {"no_s": F.col("source").isNull(), "s": F.coalesce("source", F.lit(""))}
    t = prefix_sums(sizes.select("source", "source_size", *[c.alias(n) for n, c in name.items()]), ["no_s", "s"], {"rank": F.lit(1)})
    w = F.array(*[F.lit(float(w)) for w in weights])[(F.col("rank") % len(weights)).cast("int")]
    t = t.withColumns({"w": w, "cap": F.col("source_size").cast("double") * max_epochs}).withColumn("fill", F.col("cap") / F.col("w"))
    t = prefix_sums(t, ["fill", "no_s", "s"], {"cap_before": F.col("cap"), "w_before": F.col("w")})
    total, all_w = t.agg(F.sum("source_size").cast("double"), F.sum("w")).first()
    t = t.withColumn("full", (F.lit(total) - F.col("cap_before")) * F.col("w") >= F.col("cap") * (F.lit(all_w) - F.col("w_before")))
    full_cap, full_w = t.where("full").agg(F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    share = (F.lit(total) - full_cap) * F.col("w") / F.nullif(F.lit(all_w) - full_w, F.lit(0.0))
    return t.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(share).alias("target"))


def _place(rows: DataFrame, weights: Sequence[int], max_epochs: int, seed: str) -> DataFrame:
    """``rows(doc_id, source, size, tie)`` and ``source_size``, ``target`` and ``taken``; other columns are kept."""
    k = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    held = materialize(rows.withColumns({"k": k, "s": F.coalesce("source", F.lit("")), "no_s": F.col("source").isNull()}))
    dealt = materialize(held.repartitionByRange("no_s", "s", "k", "tie").withColumn("part", F.spark_partition_id()))
    blocks = materialize(dealt.groupBy("no_s", "s", "part").agg(F.sum("size").alias("block"), F.first("source").alias("source")))
    sizes = blocks.groupBy("no_s", "s").agg(F.first("source").alias("source"), F.sum("block").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs).select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_s"), "source_size", "target")
    earlier = F.sum("block").over(W.partitionBy("no_s", "s").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.select("no_s", "s", "part", F.coalesce(earlier, F.lit(0)).alias("start")).join(targets, ["no_s", "s"])
    inside = F.sum("size").over(W.partitionBy("no_s", "s", "part").orderBy("k", "tie", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    placed = dealt.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["no_s", "s", "part"])
    budget, size = F.floor("target").cast("long"), F.col("source_size")
    passes = F.when(size > 0, F.floor(budget / size)).otherwise(0).cast("long")
    rest = budget - passes * size
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start") - F.col("inside")))
    return placed.select(*rows.columns, "source_size", "target", (passes * F.col("size") + cut).alias("taken"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, text, source)``.

    In each source documents stand in the order of a hash of ``seed`` and doc_id (then of the text). The source's
    budget is its target rounded down; it takes whole passes over the source and, of the last pass, the words before
    the cut, so the document at the cut is taken in part. ``taken`` never exceeds ``max_epochs`` times ``size``.

    Null texts have size 0, a null source is a source of its own (last in order), a null doc_id hashes as the empty
    text. Rows that agree in everything are interchangeable. An empty table gives no rows; further columns are
    ignored. Rows are range-sorted by (source, hash), which deals a large source out over many partitions; running
    sums inside a partition and sums over partitions give every row's place.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    return _place(rows, weights, max_epochs, seed).select("doc_id", "size", "source_size", "target", "taken")


def take_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that mix_sources() takes anything of, with its ``size, source_size, target, taken``.

    A row stands for ``taken`` words: its text ``taken // size`` times whole and, once more, the first ``taken % size``
    words. All columns are kept; those of the results' names are replaced. Texts are written once, numbered, and move
    once, to meet what is taken of them; only sizes are sorted.
    """
    for name in ("size", "source_size", "target", "taken"):
        docs = without(docs, name)
    row = unused(docs, "row_")
    held = stored(docs.withColumn(row, F.monotonically_increasing_id()))  # numbered for good, as they are written
    rows = held.select(F.col(row).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    taken = _place(rows, weights, max_epochs, seed).where("taken > 0").select(F.col("row").alias(row), "size", "source_size", "target", "taken")
    return held.join(taken, row).drop(row)


#: The same in DuckDB. Ties of the hash would need equal doc_ids, which the tables don't have.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size::DOUBLE AS cap,
        (1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::DOUBLE AS w FROM s),
c AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS all_w,
        coalesce(sum(cap) OVER f, 0) AS cap_before, coalesce(sum(w) OVER f, 0) AS w_before FROM w
      WINDOW f AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - cap_before) * w >= cap * (all_w - w_before) AS full_up FROM c),
g AS (SELECT *, sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER () AS full_cap,
        sum(CASE WHEN full_up THEN w ELSE 0 END) OVER () AS full_w FROM f),
t AS (SELECT source, source_size, CASE WHEN full_up THEN cap ELSE (total - full_cap) * w / (all_w - full_w) END AS target FROM g),
p AS (SELECT doc_id, source, size,
        coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END * size
   + greatest(0, least(size, CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END - before)))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
