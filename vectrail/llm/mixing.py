"""Operator 8: mixing sources to target weights.

Words are summed per source, targets are set by weight, and a source's
repetition rate is its target over its size.  Each document is emitted
floor(rate) times, plus one hash-seeded Bernoulli copy whose probability is the
rate's fraction.

The Bernoulli draws of a source are coupled, not independent: its documents are
dealt by a hash of id and text into cells of about ``cell`` documents, ordered by
size within a cell, and drawn systematically from a start that the hash seeds.
Each draw still has the fraction as its probability, but a cell's taken words
stray from their expectation by about one document rather than by the square
root of their number.  Independent draws would leave a small source far from its
target (a third of it on the smallest tables, see the README).

Sources are a catalogue, whose targets the driver works out and broadcasts while
there are at most ``MOST_SOURCES`` of them; beyond that the same targets are found
by rounds over a table of sources, which then meets the documents in a join.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; sources of size 0 have target 0 and take nothing; an empty table
gives no rows; repeated rows are drawn one by one, and rows without an id, or of one
id, are dealt by their texts; ties of size go by hash, then by id; very long texts
are counted whole; extra columns, whatever their names, are ignored or carried in a
struct.
"""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, written

CELL = 4096
MOST_SOURCES = 100_000
MOST = 3.0


def targets(sizes: dict, weights: dict, most: float = MOST) -> dict:
    """Share all words by weight; no target exceeds ``most`` times its source, and the excess is shared again."""
    out, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while open_:
        per = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if per * weights[s] > most * sizes[s]]
        for s in over:
            out[s] = most * sizes[s]
            open_.remove(s)
        left -= sum(out[s] for s in over)
        if not over:
            return out | {s: per * weights[s] for s in open_}
    return out


def cyclic_weights(sources: list, steps: tuple = (1, 2, 3)) -> dict:
    """Sources in order of code points, null last, weigh 1, 2, 3, 1, 2, 3, ..."""
    return dict(zip(sorted(sources, key=lambda s: (s is None, s or "")), cycle(steps), strict=False))


def _unit(key, seed: int):
    """A number in [0, 1) from an MD5 of the seed and a string."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def plan_on_driver(per: DataFrame, weights, most: float) -> DataFrame:
    """source_, source_size, target of every source, to be broadcast."""
    rows = per.collect()  # at most MOST_SOURCES
    sizes = {r.source: r.words for r in rows}
    wanted = targets(sizes, weights(list(sizes)), most) if sizes else {}
    plan = [(r.source, r.words, r.n, round(wanted[r.source], 6)) for r in rows]
    return F.broadcast(per.sparkSession.createDataFrame(plan, "source_ string, source_size bigint, n bigint, target double"))


def plan_in_rounds(per: DataFrame, most: float, steps: tuple = (1, 2, 3)) -> DataFrame:
    """The same with cyclic weights, however many sources there are: none is collected.

    Sources are numbered within ranges of their names; each round closes those that the
    common level would fill beyond ``most`` times their size, until none is left to close.
    """
    ranged = written(per.repartitionByRange("source").select("*", F.spark_partition_id().alias("part")), "mixing-ranged")
    counts = ranged.where("source is not null").groupBy("part").agg(F.count("*").alias("c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = counts.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    named = ranged.where("source is not null").join(starts, "part").withColumn("place", F.col("start") + place)
    null = ranged.where("source is null").withColumn("place", F.lit(ranged.where("source is not null").count()).cast("bigint"))
    cycle_ = F.array(*(F.lit(float(x)) for x in steps))
    weighed = named.drop("start").unionByName(null).withColumn("w", F.element_at(cycle_, (F.col("place") % len(steps)).cast("int") + 1))
    table = written(weighed.select("source", "words", "n", "w", (most * F.col("words") / F.col("w")).alias("ratio")), "mixing-sources")
    total = float(table.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    level = 0.0
    while True:
        closed, open_ = table.where(F.col("ratio") < level), table.where(F.col("ratio") >= level)
        taken = closed.agg(F.coalesce(F.sum(most * F.col("words")), F.lit(0.0))).first()[0]
        weight = open_.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        now = (total - taken) / weight if weight else level
        if now <= level:
            break
        level = now
    discard(ranged)
    target = F.round(F.least(most * F.col("words").cast("double"), F.col("w") * F.lit(level)), 6)
    return table.select(F.col("source").alias("source_"), F.col("words").alias("source_size"), "n", target.alias("target"))


def mix(docs: DataFrame, weights=cyclic_weights, most: float = MOST, seed: int = 8, cell: int = CELL, carry: bool = False, most_sources: int = MOST_SOURCES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken; ``carry`` adds the row as the struct ``doc``.

    ``weights`` maps the list of sources to their weights; beyond ``most_sources`` sources they are cyclic.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    row = [F.struct(*docs.columns).alias("doc")] if carry else []
    slim = docs.select("doc_id", "source", size.alias("size"), _unit(name, seed).alias("u"), _unit(name, seed + 1).alias("v"), *row)
    if not carry:  # words are counted once; whole rows are not written for that
        slim = written(slim, "mixing-sizes")
    per = written(slim.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mixing-catalogue")
    if per.count() <= most_sources:
        plan = plan_on_driver(per, weights, most)
    elif weights is cyclic_weights:
        plan = plan_in_rounds(per, most)
    else:
        raise ValueError(f"more than {most_sources} sources take cyclic weights only")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select("source_", "source_size", "target", rate.alias("rate"), F.greatest(F.lit(1), F.floor(F.col("n") / cell)).alias("cells"))
    dealt = slim.join(plan, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumn("cell", F.floor(F.col("u") * F.col("cells")))
    order = Window.partitionBy("source", "cell").orderBy("size", "v", "doc_id")
    whole = F.floor("rate")
    fraction = F.col("rate") - whole
    start = _unit(F.concat_ws("|", F.coalesce("source", F.lit("\0")), F.col("cell").cast("string")), seed)
    before = F.floor(start + fraction * (F.col("nth") - 1))
    extra = F.floor(start + fraction * F.col("nth")) - before
    return (
        dealt.withColumn("nth", F.row_number().over(order))
        .withColumn("copies", (whole + extra).cast("bigint"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("nth", "cell", "cells", "u", "v")
    )


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns."""
    mixed = mix(docs, carry=True, **options).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
