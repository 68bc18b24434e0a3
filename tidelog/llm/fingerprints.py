"""Document fingerprints by consistent weighted sampling, on DataFrame functions only.

A document is a set of weighted terms: its five-word shingles, weighted by how often they occur. For each slot of the signature and each
term a consistent sample is drawn from gamma variates that depend on the two alone: with r, c ~ Gamma(2, 1) and b uniform,
t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)), w being the term's whole weight in the document. The slot holds the least a of
all terms. Two documents have the same value in a slot with the probability of their generalised Jaccard similarity
(sum of least over sum of greatest weights).

Scale: texts are shuffled once by document, and those files are freed before the results are put together. Shingles are counted and sampled where their document lies; a text and its edited
form share the samples of what they have in common. All aggregates follow the documents' partitioning, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, tasks

SPACE = r"[\x20\x09-\x0D]+"
SLOTS = 48
WORDS = 5
BLANK = " \t\n\x0b\x0c\r"
#: Slots sampled in one row, which share c. Each slot still has its own r and b, so each collides at the rate it should.
TOGETHER = 8


def _uniform(h: Column, shift: int, bits: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)


def spread(term: Column, slot: Column) -> tuple[Column, Column]:
    """r and b of a term and slot, from the bits of a hash."""
    h = F.xxhash64(term, slot, F.lit(1))
    return -F.ln(_uniform(h, 0, 22) * _uniform(h, 22, 22)), _uniform(h, 44, 20)


def rank(term: Column, slot: Column) -> Column:
    """ln c of a term and the first of the slots that share it."""
    h = F.xxhash64(term, slot, F.lit(2))
    return F.ln(-F.ln(_uniform(h, 0, 32) * _uniform(h, 32, 32)))


def sample(r: Column, b: Column, ln_c: Column, ln_w: Column) -> Column:
    """ln a of the consistent sample of a term with weight w."""
    return ln_c - r * (F.floor(ln_w / r + b) - b + 1.0)


def terms(texts: DataFrame, keys: list[str], words: int = WORDS) -> DataFrame:
    """``keys, term, w0, w1``: each shingle of ``texts(keys..., text, edited, same)`` with its number in the text and in the edited text.

    The first ``same`` characters of both are equal: shingles of whole words there are looked at once. Fewer than ``words`` words are one shingle.
    One row for each place of a shingle, counted where it is: ``texts`` lie parted by ``keys``.
    """
    split = lambda text: F.when(F.btrim(text, F.lit(BLANK)) != "", F.split(F.btrim(text, F.lit(BLANK)), SPACE))
    whole = F.greatest(F.coalesce(F.size(split(F.expr("left(text, same)"))), F.lit(0)) - 1, F.lit(0))  # the last word there may go on
    t = texts.select(*keys, split(F.col("text")).alias("own"), split(F.col("edited")).alias("edited"), whole.alias("whole"))
    first = F.greatest(F.col("whole") - words + 1, F.lit(0))
    kinds = F.array(F.struct(F.lit(0).alias("which"), F.lit(0).alias("first"), F.col("own").alias("w")), F.struct(F.lit(1).alias("which"), first.alias("first"), F.col("edited").alias("w")))
    t = t.select(*keys, "whole", F.explode(kinds).alias("t")).select(*keys, "whole", "t.which", "t.first", "t.w")
    places = t.select(*keys, "whole", "which", "w", F.explode(F.sequence("first", F.greatest(F.size("w") - words, F.lit(0)))).alias("at"))
    both = F.when((F.col("which") == 1) | (F.col("at") + words <= F.col("whole")), 1).otherwise(0)
    one = places.select(*keys, (1 - F.col("which")).alias("in0"), both.alias("in1"), F.xxhash64(*[F.get("w", F.col("at") + k) for k in range(words)]).alias("term"))
    return one.groupBy(*keys, "term").agg(F.sum("in0").alias("w0"), F.sum("in1").alias("w1"))


def signatures(texts: DataFrame, keys: list[str], slots: int = SLOTS, words: int = WORDS) -> DataFrame:
    """``keys, own, edited``: for ``texts(keys..., text, edited, same)``, one row for each ``keys``, arrays of one value, or null, for each slot.

    A text without words has nothing but nulls, and keys without any words no row. ``slots`` is a multiple of ``TOGETHER``.
    """
    t = terms(texts, keys, words)
    ln = lambda w: F.when(F.col(w) > 0, F.ln(w))
    t = t.select(*keys, "term", ln("w0").alias("l0"), ln("w1").alias("l1"))
    t = t.select(*keys, "term", "l0", "l1", F.coalesce("l0", "l1").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(slots - TOGETHER), F.lit(TOGETHER))).alias("slot"))
    k = range(TOGETHER)
    drawn = [v.alias(f"{n}{i}") for i in k for n, v in zip("rb", spread(F.col("term"), F.col("slot") + i), strict=True)]
    t = t.select(*keys, "slot", "l0", "l1", "l", rank(F.col("term"), F.col("slot")).alias("c"), *drawn)
    of = lambda i, w: sample(F.col(f"r{i}"), F.col(f"b{i}"), F.col("c"), F.col(w))
    t = t.select("*", *[of(i, "l").alias(f"a{i}") for i in k])
    own = [F.min(F.when(F.col("l0").isNotNull(), F.col(f"a{i}"))).alias(f"own{i}") for i in k]
    edited = [F.min(F.when(F.col("l1") == F.col("l"), F.col(f"a{i}")).otherwise(of(i, "l1"))).alias(f"edited{i}") for i in k]
    got = t.groupBy(*keys, "slot").agg(*own, *edited)
    some = lambda name: F.array(*[F.when(F.col(f"{name}{i}").isNotNull(), F.hash(f"{name}{i}")) for i in k])
    part = got.select(*keys, F.struct("slot", some("own").alias("own"), some("edited").alias("edited")).alias("part"))
    all_parts = part.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return all_parts.select(*keys, F.flatten(F.col("parts.own")).alias("own"), F.flatten(F.col("parts.edited")).alias("edited"))


def shown(sig: Column) -> Column:
    """A signature as text: eight hex digits for each slot, dashes for an empty one."""
    digits = lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.array_join(F.transform(sig, lambda x: F.coalesce(digits(x), F.lit("--------"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots filled by either that hold the same value; 1 for two empty signatures."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))
    return F.when(either == 0, 1.0).otherwise(same / either)


def followers(ids: DataFrame) -> DataFrame:
    """``ids(id, key, ...)`` plus ``next_id, next_key``: the next row by descending ``id`` and ``key``; the first's after the last.

    Rows are distinct. They are cut into ranges; a range's last row takes the first of the next range, of which there is one
    small row for each. Where the ranges lie makes no difference to the result.
    """
    order = [F.col("id").desc(), F.col("key").desc()]
    r = cut(ids.repartitionByRange(tasks(ids.sparkSession), *order).withColumn("range", F.spark_partition_id()))
    here = F.struct("id", "key")
    r = r.withColumn("next", F.lead(here).over(Window.partitionBy("range").orderBy(*order)))
    heads = r.groupBy("range").agg(F.max(here).alias("head"))
    over = Window.orderBy("range")  # one row for each range: as many as there are shuffle partitions
    first = F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("range", F.coalesce(F.lead("head").over(over), first).alias("after"))
    r = r.join(F.broadcast(heads), "range").withColumn("next", F.coalesce("next", "after"))
    return r.select(*ids.columns, F.col("next.id").alias("next_id"), F.col("next.key").alias("next_key"))


def fingerprint(docs: DataFrame, slots: int = SLOTS, words: int = WORDS) -> DataFrame:
    """Fingerprints of every document and of its text with the last third replaced by the next document's beginning.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, a row for each row of ``docs``.

    Defined cases: null text counts as empty; texts without words have an empty fingerprint, alike to each other
    (likeness 1) and to no other; a null ``doc_id`` comes last, as the least of all; rows alike in id and text are one
    document and get its result each; of different texts with one id the one with the larger hash comes first; a single document
    is its own next; an empty table gives an empty result; other columns are left out.
    """
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    ids = d.groupBy("id", "key").agg(F.count("*").alias("rows"), F.max(F.length("text")).alias("n_chars"))
    nexts = cut(followers(ids))
    one = d.repartition(4 * tasks(docs.sparkSession), "id", "key").groupBy("id", "key").agg(F.first("text").alias("text"))
    ask = nexts.select(F.col("id").alias("for_id"), F.col("key").alias("for_key"), "next_id", "next_key", F.floor(F.col("n_chars") / 3).cast("int").alias("third"))
    heads = one.join(ask, (one["id"] == ask["next_id"]) & (one["key"] == ask["next_key"])).select("for_id", "for_key", "third", F.expr("left(text, third)").alias("head"))
    heads = heads.select(F.col("for_id").alias("id"), F.col("for_key").alias("key"), "third", "head")
    both = one.join(heads, ["id", "key"]).select("id", "key", "text", F.concat(F.expr("left(text, char_length(text) - third)"), "head").alias("edited"), F.expr("char_length(text) - third").alias("same"))
    sha = both.select("id", "key", F.sha2("edited", 256).alias("edited_sha256"))
    sigs = cut(sha.join(signatures(both, ["id", "key"], slots, words), ["id", "key"], "left"))  # one job, so that both use the same shuffles of texts
    release(docs.sparkSession)  # which nothing needs from here on
    empty = F.array_repeat(F.lit(None).cast("int"), slots)
    out = nexts.join(sigs, ["id", "key"])
    after = sigs.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("own").alias("next_sig"))
    out = out.join(after, ["next_id", "next_key"], "left")
    own, edited, coming = F.coalesce("own", empty), F.coalesce("edited", empty), F.coalesce("next_sig", empty)
    out = out.select(
        F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", shown(own).alias("fingerprint"),
        shown(edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"), likeness(own, coming).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"))
    return out.drop("row")
