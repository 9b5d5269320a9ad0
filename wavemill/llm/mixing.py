"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most `most` times the
words it has; what is above is shared again by weight. Inside a source each
document should appear `most` times at most and in proportion to its odds: whole
copies are certain, and the fractional rest is a Pareto sample: documents are
ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)),
and the first ones are taken until the words left for the source are spent. The
sample's size is fixed in words, so a source meets its target to half a document.

The random number is 52 bits of the MD5 sum of seed, id and text: reruns, other
partitions and SQL agree. Ranking needs no sort of a source: ranks fall into `BINS` bins, words per
bin are summed before any shuffle; the bin in which the words run out falls into as
many again, and only the last of these, a millionth of a source, is ordered. A source's
figures meet its documents by a join that Spark may split; nothing is collected.

Defined results: null text counts no words, texts of any length all theirs; a null source is a source of its
own, last; a document of no words is taken 0 times its words; equal rows tie and
are interchangeable; an empty table gives no rows; all else passes by name, so
clashing extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BINS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def fill(df: DataFrame, by: list[str], words: str, weight: str, total: str, most: int) -> DataFrame:
    """Adds `level`: with it, sum(min(most * words, level * weight)) = total in
    each group of `by`. Groups are aggregates, a row per source or class."""
    order = Window.partitionBy(*by).orderBy("fill_r", F.col(weight).desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    df = df.withColumn("fill_r", F.when(F.col(weight) > 0, most * F.col(words) / F.col(weight)).otherwise(F.lit(0.0)))
    df = df.withColumn("fill_c", (F.col(total) - most * F.coalesce(F.sum(words).over(order), F.lit(0))) / F.greatest(F.sum(weight).over(every) - F.coalesce(F.sum(weight).over(order), F.lit(0.0)), F.lit(1e-12)))
    # In order of the ratio at which a row is full, the first level below it.
    at = F.min(F.when(F.col("fill_c") <= F.col("fill_r") * (1 + 1e-12), F.struct("fill_r", "fill_c"))).over(every)
    full = F.max("fill_r").over(every)
    return df.withColumn("level", F.coalesce(at["fill_c"], full)).drop("fill_r", "fill_c")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, odds: Column | None = None, seed: int = 9) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and the copies taken.

    weights: by source in order of code points, repeating. odds: a column of
    `size` for the relative odds of a document inside its source; by default
    texts under 32 words have half the odds of others. Its distinct values
    should be few: they are classes for which words are summed."""
    text = F.col(text_col).cast("string")
    none = F.lit("")
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), none), F.lit("|"), F.coalesce(text, none)))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) * F.lit(2.0**-52)
    odds = F.when(F.col("size") < 32, 0.5).otherwise(1.0) if odds is None else odds
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), u.alias("u"))
    rows = cut(rows.withColumn("odds", odds.cast("double")))

    # A row for each source and class, then one for each source.
    kinds = rows.groupBy("source", "odds").agg(F.sum("size").alias("words"))
    sources = kinds.groupBy("source").agg(F.sum("words").alias("source_size"))
    place = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))).withColumn("all", F.lit(0))
    sources = fill(sources.withColumn("total", F.sum("source_size").over(Window.partitionBy("all"))), ["all"], "source_size", "weight", "total", most)
    sources = sources.select("source", "source_size", F.least(most * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"))

    kinds = kinds.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    kinds = fill(kinds.withColumn("mass", F.col("words") * F.col("odds")), ["source"], "words", "mass", "target", most)
    ratio = F.least(F.lit(float(most)), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("odds"))
    # A ratio next to a whole number is that number, up to rounding.
    whole = F.floor(ratio + 1e-9)
    kinds = kinds.withColumn("whole", whole).withColumn("p", F.greatest(ratio - whole, F.lit(0.0)))
    kinds = kinds.withColumn("left", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source")))
    kinds = cut(kinds.select(F.col("source").alias("s"), F.col("odds").alias("o"), "source_size", "target", "whole", "p", "left"))

    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = rows.join(kinds, F.col("source").eqNullSafe(F.col("s")) & (F.col("odds") == F.col("o")))
    ranked = ranked.withColumn("rank", F.when((F.col("p") > 1e-12) & (F.col("size") > 0), rank))
    share = F.col("rank") / (1 + F.col("rank")) * BINS
    ranked = ranked.withColumn("bin", F.floor(share).cast("int")).withColumn("fine", F.floor((share - F.col("bin")) * BINS).cast("int")).select("doc_id", "source", "size", "source_size", "target", "whole", "left", "rank", "bin", "fine")

    bins = ranked.where("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("spent", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    last = bins.where((F.col("spent") < F.col("left")) & (F.col("spent") + F.col("words") >= F.col("left")))
    # Where the words suffice for all, every ranked document is taken.
    last = bins.groupBy("source").agg(F.max("bin").alias("top")).join(last.select(F.col("source").alias("ls"), F.col("bin").alias("cut_bin"), "spent"), F.col("source").eqNullSafe(F.col("ls")), "left")
    none = bins.groupBy("source").agg(F.max("left").alias("most_left")).withColumnRenamed("source", "ns")
    last = cut(last.join(none, F.col("source").eqNullSafe(F.col("ns"))).select(F.col("source").alias("s"), F.when(F.col("most_left") <= 0, F.lit(-1)).otherwise(F.coalesce("cut_bin", F.col("top") + 1)).alias("cut_bin"), F.coalesce("spent", F.lit(0)).alias("spent")))

    fines = ranked.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cut_bin"))).groupBy("source", "fine").agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first("spent").alias("spent"))
    before = Window.partitionBy("source").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    fines = fines.withColumn("spent", F.col("spent") + F.coalesce(F.sum("words").over(before), F.lit(0)))
    fines = fines.where((F.col("spent") < F.col("left")) & (F.col("spent") + F.col("words") >= F.col("left")))
    fines = fines.select(F.col("source").alias("fs"), F.col("fine").alias("cut_fine"), F.col("spent").alias("fine_spent"))
    last = cut(last.join(fines, F.col("s").eqNullSafe(F.col("fs")), "left").select("s", "cut_bin", "cut_fine", "fine_spent"))

    placed = ranked.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    at_cut = F.coalesce((F.col("bin") == F.col("cut_bin")) & (F.col("fine") == F.col("cut_fine")), F.lit(False))
    below = (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("fine") < F.col("cut_fine")))
    clear = placed.where(~at_cut).withColumn("extra", F.when(below, 1).otherwise(0))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    tight = placed.where(at_cut).withColumn("ahead", F.col("fine_spent") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    tight = tight.withColumn("extra", F.when(F.col("ahead") + F.col("size") / 2 <= F.col("left"), 1).otherwise(0)).drop("ahead")
    out = clear.unionByName(tight)  # each row is in one of both
    copies = (F.col("whole") + F.col("extra")).cast("int")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), "source")
