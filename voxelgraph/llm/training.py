"""Bounded, deterministic training samples, and the folds that models may learn from.

Samples are chosen by a hash of the id: the same rows on every run, whatever the order and number of partitions. Null ids and null
labels aren't sampled; of rows that repeat an id, one is; an empty table gives an empty sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def sample_ids(labelled: DataFrame, per_class: int) -> DataFrame:
    """doc_id, label: of each label per_class ids at most, the first by hash. All labels are sampled. One pass counts them, a second
    keeps about twice what is wanted by the id's hash, so what is ranked is bounded by the labels, not by the table. An id with
    several labels counts as the largest of those kept."""
    known = labelled.where("doc_id is not null and label is not null").select("doc_id", "label")
    share = known.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).select("label", (F.lit(2.0 * per_class + 100) / F.col("_n")).alias("_share"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    some = known.join(F.broadcast(share), "label").where(draw < F.col("_share")).groupBy("doc_id").agg(F.max("label").alias("label"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return some.withColumn("_rank", rank).where(F.col("_rank") <= per_class).select("doc_id", "label")


def sample_texts(docs: DataFrame, ids: DataFrame, most_chars: int = 60_000_000) -> pd.DataFrame:
    """doc_id, text, label of a sample, on the driver: whole texts, in order of the id's hash, up to most_chars in all; a text that
    doesn't fit is skipped, those after it aren't. Lengths come first, so no more than most_chars of text reaches the driver. The
    sample's ids are bounded (sample_ids), so they are broadcast; of rows that repeat an id the first by text counts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).toPandas()
    sizes = sizes.assign(order=sizes["doc_id"].map(lambda i: (i * 0x9E3779B97F4A7C15) % (1 << 64))).sort_values("order")
    left, fits = most_chars, []
    for n in sizes["n"]:
        fits.append(n <= left)
        left -= n if fits[-1] else 0
    chosen = sizes["doc_id"][pd.Series(fits, sizes.index, bool)].tolist()
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(int(i),) for i in chosen], "doc_id long").join(ids, "doc_id")
    got = rows.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas()
    at = {i: n for n, i in enumerate(chosen)}
    return got.assign(order=got["doc_id"].map(at)).sort_values("order")[["doc_id", "text", "label"]].reset_index(drop=True)


def quantile(values: DataFrame, q: float, bins: int = 4096, listed: int = 50_000) -> float | None:
    """np.quantile() of all values of the only column (no nulls), exactly; null without rows. Values are counted by bins, then those of the
    bin that holds the rank, until at most `listed` are left to be listed: nothing is sorted or gathered whole."""
    x = values.toDF("x")
    inside, low, high = x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not inside:
        return None
    at, below = (inside - 1) * q, 0
    first, last = int(at), min(int(at) + 1, inside - 1)
    while inside > listed and high > low:
        place = F.least(F.floor((F.col("x") - low) / ((high - low) / bins)), F.lit(bins - 1))
        each = x.where(F.col("x").between(low, high)).groupBy(place.alias("at")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()  # bins rows
        upto = below + np.cumsum([r.n for r in each])
        a, b = (int(np.searchsorted(upto, rank, side="right")) for rank in (first, last))
        if a != b:  # the last value of one bin, the first of the next
            return float(np.quantile([each[a].high, each[b].low], at - first))
        inside, low, high, below = each[a].n, each[a].low, each[a].high, int(upto[a]) - each[a].n
    if low == high:
        return float(low)
    got = np.sort(x.where(F.col("x").between(low, high)).toPandas()["x"].to_numpy())
    return float(np.quantile([got[first - below], got[last - below]], at - first))
