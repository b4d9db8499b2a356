"""Sources mixed to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.hashing import SPAN, position
from quirework.llm.tokens import FOLDER, token_counts
from quirework.plans.lineage import cut
from quirework.plans.prefix import running_sum

SIZE_CLASSES, SPREAD = 8, 16


def source_form(source: Column) -> Column:
    """A source's name trimmed, in lower case, with underscores for hyphens and spaces; null if nothing is left."""
    name = F.regexp_replace(F.lower(F.trim(source)), "[- ]+", "_")
    return F.when(name != "", name)


def source_rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """How often each source's documents are to be taken, (source, target_share, max_repeats, available, wanted, rate).

    sizes is (source, available); total is the wanted size of the mix, by default that of all sources with a target.
    Shares are taken in proportion to their sum over the sources that have both documents and a target. A source gives
    at most max_repeats times its size; what that lacks goes to the others in proportion to their shares, so long as
    they can give it: if all are at their limit, the mix is smaller than total. Targets that are null, NaN or not above
    0, or name a source twice (the larger share counts), are put right here; max_repeats below 1 or null counts as 1.
    There are as many rows as targets, a table of settings, so one task orders them.
    """
    clean = targets.select(source_form(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"))
    clean = clean.where("source IS NOT NULL AND share > 0 AND share < double('Infinity')").groupBy("source").agg(F.max(F.struct("share", "max_repeats")).alias("t")).select("source", "t.share", "t.max_repeats")
    both = clean.join(sizes.where("available > 0"), "source")
    everything = Window.partitionBy(F.lit(0))
    rows = both.withColumn("share", F.col("share") / F.sum("share").over(everything)).withColumn("cap", F.col("available") * F.col("max_repeats"))
    rows = rows.withColumn("total", F.lit(float(total)) if total is not None else F.sum("available").over(everything).cast("double"))
    # by rising limit per share, sources are at their limit as long as the level that the rest would need is above it
    order = everything.orderBy(F.col("cap") / F.col("share"), "source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("share").over(rest)
    rows = rows.withColumn("level", level).withColumn("full", level >= F.col("cap") / F.col("share"))
    reached = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("share")).alias("at"), "source", "level"))).over(everything)["level"]
    wanted = F.least(F.col("cap").cast("double"), F.coalesce(reached, F.lit(float("inf"))) * F.col("share"))
    return rows.select("source", F.col("share").alias("target_share"), "max_repeats", "available", wanted.alias("wanted"), (wanted / F.col("available")).alias("rate"))


def systematic_copies(rows: DataFrame, key: str, salt: str = "mix") -> DataFrame:
    """rows (key, source, tokens, rate) repeated: copy_no counts from 1.

    In each source the documents lie in a row, by size class, hash and key, each as long as its expected copies (rate);
    one random offset per source, from its name, sets a grid of whole numbers, and a document is emitted once for each
    that it crosses. A document is so taken floor(rate) or ceil(rate) times, and every stretch of sizes at the same rate. The
    row is cut into buckets by size class and hash, so a source of any size spreads over tasks.
    """
    size_class = F.floor(F.log2(F.col("tokens").cast("double") + 1) * SIZE_CLASSES).cast("int")
    spot = position(key, salt=salt)
    placed = rows.withColumn("__spot", spot).withColumn("__bucket", size_class * SPREAD + (F.col("__spot") / F.lit(SPAN // SPREAD)).cast("int")).withColumn("__one", F.lit(1))
    placed = running_sum(placed, "__one", "__place", "__bucket", ["__spot", key], ["source"])
    offset = position("source", salt=f"{salt}-offset") / F.lit(float(SPAN))
    copies = (F.floor(F.col("__place") * F.col("rate") + offset) - F.floor((F.col("__place") - 1) * F.col("rate") + offset)).cast("int")
    taken = placed.withColumn("__copies", copies).where("__copies > 0")
    return taken.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy_no"))


def sized(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, tokens) of the documents that name a source and hold a token."""
    rows = documents.where("doc_id IS NOT NULL").select("doc_id", source_form(F.col("source")).alias("source"))
    return cut(token_counts(documents.where("doc_id IS NOT NULL"), name, folder=folder).where("tokens > 0").join(rows.where("source IS NOT NULL"), "doc_id").select("doc_id", "source", "tokens"))


def mixed(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, copy_no) of sized documents, and the rates of its sources."""
    rates = cut(source_rates(sizes.groupBy("source").agg(F.sum("tokens").alias("available")), targets, total))
    return systematic_copies(sizes.join(rates.select("source", "rate"), "source"), "doc_id").select("doc_id", "source", "tokens", "copy_no"), rates


def mix_report(mix: DataFrame, rates: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source with a target: target_share as given, available and mixed tokens, copies, actual_share, most repeats of a document."""
    per = mix.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).groupBy("source").agg(F.sum("n").alias("copies"), F.sum("tokens").alias("mixed_tokens"), F.max("n").alias("most_repeats"))
    given = targets.select(source_form(F.col("source")).alias("source"), "target_share").where("source IS NOT NULL AND target_share IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = F.lit(0).cast("bigint")
    rows = given.join(rates.select("source", "available"), "source", "left").join(per, "source", "left")
    everything = Window.partitionBy(F.lit(0))  # as many rows as targets
    share = F.coalesce(F.col("mixed_tokens"), zero) / F.sum("mixed_tokens").over(everything)
    return rows.select(
        "source",
        "target_share",
        F.coalesce("available", zero).alias("available_tokens"),
        F.coalesce("copies", zero).alias("copies"),
        F.coalesce("mixed_tokens", zero).alias("mixed_tokens"),
        F.coalesce(F.round(share, 6), F.lit(0.0)).alias("actual_share"),
        F.coalesce("most_repeats", zero).alias("most_repeats"),
    )
