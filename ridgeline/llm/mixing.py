"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm._store import columns, materialize, own_prefix, tidied

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all words that the mix takes, and the most epochs of any source.
SHARE, MOST = 1.5, 2.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: source, source_size. Adds target.

    Sources by code point, null last, get the weights in turn. Resharing what capped sources cannot take
    ends where every target is least(most * size, level * weight) for one level; sources sorted by
    most * size / weight are capped up to some place, and prefix sums in that order give the level.
    The windows go over one row for each source, never over documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "place").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / F.sum("weight").over(rest)
    out = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    common = F.min(F.when(~F.col("capped"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    return out.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * common)).select("source", "source_size", "target")


@tidied
def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per row of docs: its columns doc_id and source, size, source_size, target, taken, start (words before it in its source's order).

    A source takes whole epochs while its target holds them; in the last one, documents in the order of a
    hash of doc_id are taken until the target is used up, the document at the cut in part, so that a source's
    taken words sum to floor(target). Null texts and texts without words have size 0 and take nothing. A null
    source is a source of its own. Rows that repeat each take their part; ties of the hash go by doc_id and size.
    Range bounds come from the hash itself: bucket b of a source holds the hashes with prefix b, so that every pass and every
    retried task sees the same ranges; a hot source has as many buckets as any other and no bucket has a great share of it.
    """
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # read twice below, so texts are gone through once for it
    rows = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key")))
    rows = rows.withColumn("bucket", F.substring("key", 1, _digits(rows)))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = buckets.withColumn("before", before)
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    starts = starts.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    starts = starts.withColumnsRenamed({"source": "_source", "bucket": "_bucket"})
    order = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0)))
    out = ranked.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    start = F.col("before") + F.col("inner")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    last = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), last - start))
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long"), F.col("target").cast("double"), (epochs * F.col("size") + part).cast("long").alias("taken"), start.cast("long").alias("start"))


@tidied
def mix_texts(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: docs with its own columns, each row as often as its taken words hold it whole, and the row at a cut once more, cut after its share of words.

    n_chars, where there is such a column, follows the text. Rows join their part by doc_id, source and size, which moves the texts once. What shares
    all three stands side by side in the order, so its parts have three values at most (before, at and behind the cut); they are dealt to its rows in the order of their texts.
    """
    p = own_prefix(docs)
    id_, source, n, taken, whole, rest, cut = (F.col(f"{p}{c}") for c in ("id", "source", "n", "taken", "whole", "rest", "cut"))
    same = [F.col("doc_id").alias(f"{p}id"), F.col("source").alias(f"{p}source"), F.col("size").alias(f"{p}n")]
    values = mix(docs, seed).groupBy(*same, "taken").agg(F.count("*").alias(f"{p}rows"))
    parts = F.sort_array(F.collect_list(F.struct(F.col("taken").alias("taken"), F.col(f"{p}rows").alias("rows"))), asc=False)
    values = materialize(values.groupBy(id_, source, n).agg(parts.alias(f"{p}values"), F.sum(f"{p}rows").alias(f"{p}all")))
    sized = docs.withColumn(f"{p}size", n_words(F.col("text")))
    joined = lambda part: sized.join(part, F.col("doc_id").eqNullSafe(id_) & F.col("source").eqNullSafe(source) & (F.col(f"{p}size") == n))
    first, second, third = (F.get(f"{p}values", F.lit(i)) for i in range(3))
    alone = F.col(f"{p}all") == 1
    rows = joined(values.filter(alone & (first["taken"] > 0))).withColumn(f"{p}taken", first["taken"])
    shared = materialize(values.filter(~alone))
    if shared.limit(1).count():
        place = F.row_number().over(Window.partitionBy("doc_id", "source", f"{p}size").orderBy("text"))
        own = F.when(F.col(f"{p}place") <= first["rows"], first["taken"]).when(F.col(f"{p}place") <= first["rows"] + second["rows"], second["taken"]).otherwise(third["taken"])
        rows = rows.union(joined(shared).withColumn(f"{p}place", place).withColumn(f"{p}taken", own).drop(f"{p}place"))
    size = F.greatest(F.col(f"{p}size"), F.lit(1))
    rows = rows.filter(taken > 0).withColumn(f"{p}whole", F.floor(taken / size).cast("int")).withColumn(f"{p}rest", (taken % size).cast("int"))
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn(f"{p}cut", F.explode(copies))
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    rows = rows.withColumn("text", F.when(cut > 0, F.array_join(F.slice(pieces, F.lit(1), F.greatest(cut, F.lit(1))), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(columns(docs))


def _digits(rows: DataFrame) -> int:
    """Hexadecimal digits of the bucket: about as many buckets of a source as rows in each, so that neither
    the ranges nor their prefix sums grow long. Results do not depend on it."""
    number, digits = rows.count(), 1
    while 16 ** (2 * digits) < number and digits < 8:
        digits += 1
    return digits
