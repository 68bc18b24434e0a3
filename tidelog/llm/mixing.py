"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue that serves its documents in a fixed shuffled order, up to ``epochs`` times over.
An item's virtual finish time is its source's token count up to and including it, divided by the source's
weight. The mix is the prefix of all items in order of finish time that fits the token budget. A source that runs out leaves its share to the
others in proportion to their weights, because they alone go on in virtual time.

Scale: tokens per unit of virtual time are even by construction, so equal ranges of virtual time are balanced range partitions.
Ranges before the one that holds the budget's end are taken whole and later ones not at all; only that
range has to be sorted row by row. Running sums within a source use hashed blocks of bounded size, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sheltered, unsheltered

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a hashed block, on average.
BLOCK_ROWS = 2048


def source_plan(sizes: DataFrame, weights: int = 3, epochs: int = 3) -> DataFrame:
    """``(source, n, source_size, rank, weight, target, level)`` from ``(source, n, source_size)``.

    Targets fill up like water: each is the least of ``epochs`` times its source's size and a common level
    times its weight, the level such that targets add up to all sizes. One row per source: this is the only
    step that sees all sources in one window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(order))
    s = s.withColumn("weight", ((F.col("rank") - 1) % weights + 1).cast("long")).withColumn("cap", F.col("source_size") * epochs)
    full = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = (
        s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("cap_before", F.sum("cap").over(full) - F.col("cap"))
        .withColumn("weight_after", F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(full) + F.col("weight"))
        .withColumn("lambda", (F.col("total") - F.col("cap_before")).cast("double") / F.col("weight_after"))
        # the first source, in order of cap per weight, that the level does not fill
        .withColumn("open", F.col("lambda") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("lambda").alias("l")))).over(Window.partitionBy())["l"])
    )
    target = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "n", "source_size", "rank", "weight", "total", F.col("level"), target.alias("target"))


def mix_plan(docs: DataFrame, epochs: int = 3, weights: int = 3) -> DataFrame:
    """How often the mix takes each document: one row per distinct ``(doc_id, source, size)``.

    Columns ``doc_id, source, size, rows, source_size, target, copies``: ``rows`` documents alike in id, source
    and size, which stand at one place of the queue, are taken ``copies`` times each.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    light = cut(docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")))
    words = F.col("rows") * F.col("size")
    plan = cut(source_plan(light.groupBy("source").agg(F.sum("rows").alias("n"), F.sum(words).alias("source_size")), weights, epochs))
    total, level, n = plan.agg(F.max("total"), F.max("level"), F.sum("n")).first()
    level, largest = level or 0.0, light.agg(F.max(words)).first()[0] or 0

    # cumulative words within a source: within hashed blocks, then over blocks
    plan = plan.withColumnRenamed("source", "_s").select("_s", "n", "source_size", "rank", "weight", "target")
    q = light.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    q = q.withColumn("block", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.ceil(F.col("n") / BLOCK_ROWS) / F.lit(2**32)))
    ahead = q.groupBy("rank", "block").agg(F.sum(words).alias("s"))
    ahead = ahead.select("rank", "block", (F.sum("s").over(Window.partitionBy("rank").orderBy("block")) - F.col("s")).alias("ahead"))
    place = Window.partitionBy("rank", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("within", F.sum(words).over(place)).join(ahead, ["rank", "block"]).withColumn("cum", F.col("within") + F.col("ahead"))
    q = cut(q.select("doc_id", "source", "size", "rows", "key", "rank", "weight", "cum", "source_size", "target"))

    # One item per document and epoch. Those that start by the level meet the budget and finish, as weights are 1 at
    # least, by the level plus the largest size: nothing that finishes later can be in the mix.
    items = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).withColumn("served", F.col("cum") + F.col("epoch") * F.col("source_size"))
    items = items.withColumn("vt", F.col("served").cast("double") / F.col("weight")).where(F.col("vt") <= level + largest)
    ranges = max(1, (n or 0) // BLOCK_ROWS)
    items = items.withColumn("range", F.floor(F.col("vt") * (ranges / level if level > 0 else 0.0)))
    sums = items.groupBy("range").agg(F.sum(words).alias("s")).withColumn("group", F.floor(F.col("range") / 1024))
    groups = sums.groupBy("group").agg(F.sum("s").alias("gs"))
    groups = groups.select("group", (F.sum("gs").over(Window.orderBy("group")) - F.col("gs")).alias("before"))
    sums = sums.join(groups, "group").withColumn("upto", F.sum("s").over(Window.partitionBy("group").orderBy("range")) + F.col("before"))
    end = sums.where(F.col("upto") > total).orderBy("range").first()
    order, stop = ["vt", "rank", "key", "doc_id", "size", "epoch"], None
    if end is not None:
        run = F.sum(words).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        last = items.where(F.col("range") == end["range"]).withColumn("run", run + F.lit(end["upto"] - end["s"]))
        stop = last.where(F.col("run") > total).orderBy(*order).select(*order).first()
    copies = F.lit(0)
    for e in range(epochs):
        mine = {"vt": (F.col("cum") + e * F.col("source_size")).cast("double") / F.col("weight"), "epoch": F.lit(e)}
        copies = copies + _before([mine.get(c, F.col(c)) for c in order], stop).cast("int")
    return q.select("doc_id", "source", "size", "rows", "source_size", "target", copies.alias("copies"))


def _before(row: list, stop) -> F.Column:
    """Whether ``row`` sorts before ``stop``, nulls first; always, if there is no stop."""
    if stop is None:
        return F.lit(True)
    before = F.lit(False)
    for x, y in list(zip(row, stop, strict=True))[::-1]:
        less = F.lit(False) if y is None else F.coalesce(x < F.lit(y), F.lit(True))
        before = less | (x.eqNullSafe(F.lit(y)) & before)
    return before


def mix(docs: DataFrame, epochs: int = 3, weights: int = 3) -> DataFrame:
    """``docs`` plus ``size, source_size, target, copies, taken``; a row of ``docs`` gives one row.

    ``copies`` (0 to ``epochs``) is how often the mix takes the document, ``taken`` the words that makes.

    Defined cases: null text has size 0; null source is a source of its own, last in order; a null ``doc_id``
    counts as the empty string for the shuffle; documents without words are taken as often as their place in the
    queue says and add nothing; rows alike in id, source and size share one place in the queue and are
    all taken equally often; an empty table gives an empty result; other columns pass through, except that
    columns named like the results are replaced. The order is an MD5 of ``doc_id``, so reruns agree.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs, kept = sheltered(docs.select(*[c for c in docs.columns if c not in new]), ("doc_id", "text", "source"))
    d = docs.withColumn("size", size)
    per = mix_plan(docs, epochs, weights).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "copies")
    on = d["doc_id"].eqNullSafe(per["_d"]) & d["source"].eqNullSafe(per["_s"]) & (d["size"] == per["_z"])
    return unsheltered(d.join(per, on).drop("_d", "_s", "_z").withColumn("taken", F.col("size") * F.col("copies")), kept)
