"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

The documents of a source, in hash order, are one stream that is cut into blocks of equal size. A source
of weight w out of W owes its k-th block (from 0) inside the window [floor(k W / w), ceil((k + 1) W / w)):
release and deadline. Every slot goes to the released block with the earliest deadline, which keeps all
windows, so that after any number of slots no source is a whole block away from its share.

The schedule repeats after W slots: a round. It is worked out once for each distinct round and carried to
all blocks by arithmetic. A source that runs out leaves the following rounds; in the round where it does,
what is left of it counts as its weight, so the bound holds to the last slot and no document is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import cells, merged, running, table

#: Target weights in blocks per round; every other source, or none, shares ``REST_WEIGHT``.
WEIGHTS = {"src0": 20, **{f"src{i}": 3 + i % 4 for i in range(1, 20)}}
REST_WEIGHT = 2
BLOCK_CHARS = 65_536

# Of one round (b: blocks per source, n: slots): who runs in each slot, as (source, its block, slot).
_EARLIEST = """
aggregate(sequence(0, n - 1),
  named_struct('done', transform(b, x -> 0), 'out', cast(array() as array<struct<g:int,k:int,t:int>>)),
  (s, t) -> transform(array(array_min(filter(
      transform(b, (x, i) -> if(s.done[i] < x and (s.done[i] * n) div x <= t, named_struct('d', ((s.done[i] + 1) * n + x - 1) div x, 'i', i), null)),
      y -> y is not null)).i), p -> named_struct(
    'done', transform(s.done, (c, i) -> if(i = p, c + 1, c)),
    'out', concat(s.out, array(named_struct('g', p, 'k', s.done[p], 't', t)))))[0],
  s -> s.out)
"""


def rounds(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """From (g, blocks) per source index: one row per (run of equal rounds, source, block in the round).

    Rows: at most (2 sources + 1) times the sum of the weights, whatever the documents are.
    """
    listed = F.array(*[F.lit(w).cast("int") for w in weights])
    one = sizes.agg(F.map_from_entries(F.collect_list(F.struct("g", "blocks"))).alias("m"))
    one = one.select(listed.alias("w"), F.expr(f"transform(sequence(0, {len(weights) - 1}), i -> coalesce(m[i], 0L))").alias("have"))
    one = one.withColumn("cuts", F.expr(
        "array_sort(array_distinct(flatten(transform(have, (x, i) -> array(0L, x div w[i], (x + w[i] - 1) div w[i])))))"))
    runs = one.where("size(cuts) > 1").select("w", "have", F.explode(F.expr(
        "transform(sequence(1, size(cuts) - 1), j -> named_struct('lo', cuts[j - 1], 'hi', cuts[j]))")).alias("run"))
    runs = runs.select("run.lo", "run.hi", F.expr("transform(have, (x, i) -> cast(least(w[i], greatest(0L, x - run.lo * w[i])) as int))").alias("b"))
    runs = runs.withColumn("n", F.expr("aggregate(b, 0, (s, x) -> s + x)"))
    before = W.orderBy("lo").rowsBetween(W.unboundedPreceding, -1)  # a row per run of rounds: bounded by the sources
    runs = runs.withColumn("base", F.coalesce(F.sum((F.col("hi") - F.col("lo")) * F.col("n")).over(before), F.lit(0)))
    return runs.select("lo", "hi", "n", "base", F.explode(F.expr(_EARLIEST)).alias("e")).select("lo", "hi", "n", "base", "e.g", "e.k", "e.t")


def mix(docs: DataFrame, weights: dict[str, int], rest_weight: int = REST_WEIGHT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Mixing order of all documents: doc_id, source, n_chars, block, offset, slot.

    Read by (slot, offset, doc_id): slots give the interleaved blocks, ``offset`` is the code points of the
    same source before the document. A document stands in the block where it starts, so a very long one
    uses up several slots of its source. Null text counts as empty; null and unlisted sources form one
    source of weight ``rest_weight``; equal rows get places beside each other; an empty table gives an
    empty result; other columns are not read. Weights are positive whole numbers.
    """
    if min([rest_weight, *weights.values()]) < 1 or block_chars < 1:
        raise ValueError("weights and block size must be positive")
    names, shares = [*weights], [*weights.values(), rest_weight]
    index = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))]) if names else F.lit(None).cast("map<string,int>")
    d = docs.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    d = d.withColumn("g", F.coalesce(F.try_element_at(index, F.coalesce("source", F.lit(""))), F.lit(len(names))))
    m = cells(docs.select("doc_id"))
    d = d.withColumn("h", F.xxhash64(F.lit("mix"), "doc_id")).withColumn("cell", F.pmod("h", F.lit(m)))
    d = running(d, ["g"], "cell", ["h", "doc_id", "n_chars", "source"], F.col("n_chars"), "offset")
    d = d.withColumn("block", F.expr(f"offset div {block_chars}"))
    sizes = d.groupBy("g").agg((F.max("block") + 1).alias("blocks"))
    plan = rounds(sizes, shares)
    weight = F.element_at(F.array(*[F.lit(w) for w in shares]), F.col("g") + 1)
    d = d.withColumn("round", F.floor(F.col("block") / weight)).withColumn("k", (F.col("block") % weight).cast("int"))
    d = d.join(F.broadcast(plan), ["g", "k"]).where("round >= lo and round < hi")
    return d.select("doc_id", "source", "n_chars", "block", "offset", (F.col("base") + (F.col("round") - F.col("lo")) * F.col("n") + F.col("t")).alias("slot"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in mixing order: files in order, rows in order inside each file; the columns stay."""
    place = mix(docs, WEIGHTS).groupBy("doc_id").agg(F.min(F.struct("slot", "offset")).alias("p"))
    place = place.select(F.col("doc_id").alias("_mix_id"), F.col("p.slot").alias("_mix_slot"), F.col("p.offset").alias("_mix_offset"))
    d = merged(docs, place, docs["doc_id"].eqNullSafe(place["_mix_id"]))
    key = ["_mix_slot", "_mix_offset", "_mix_id"]
    return d.repartitionByRange(*key).sortWithinPartitions(*key).select(*[docs[f"`{c}`"] for c in docs.columns])
