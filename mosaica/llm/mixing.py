"""Mixing sources to target weights by Sainte-Lague apportionment of equal word blocks.

1. Each source has a target: the whole corpus size shared out by weight, no
   source above ``repeat`` times its own size, the excess reshared (the level of
   this water filling has a closed form over sources ordered by cap / weight).
2. Blocks of ``block_words`` words are seats: sources get seats by highest
   quotients target / (2n + 1), and so do the shards of each source, with their
   sizes as weights. A source has shards of about ``shard_words`` words, so a
   source that holds a third of all rows is many shards, not one task.
3. A shard's documents stand in seeded order on a line that is cut into blocks;
   a quota of q blocks takes whole rounds of the line, then a run of blocks from
   a seeded block on (around the end), so few documents are taken in part.

All of it is DataFrame expressions; the text is read once, to count words.
Apportionment is exact without a heap: rounding to the divisor total / seats
misses the house size by at most half the number of parties, so each party's
final seats lie within a known distance of that, and only those few quotients
are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, broadcast_if_small, materialize_table


def sainte_lague(parties: DataFrame, group: list[str], party: str, weight: str, total: str, seats: str) -> DataFrame:
    """Add ``quota``: the seats of each party, by highest quotients weight / (2n + 1), ties to the smaller ``party``.

    ``total`` is the sum of the weights of a group and ``seats`` its number of
    seats. Parties of weight 0 and groups without seats get 0.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    depth = F.ceil(F.col("_n") / 2 * F.col(weight) / F.col(total)) + 2
    fair = F.floor(F.col(seats) * F.col(weight) / F.col(total) + 0.5)
    p = parties.where((F.col(weight) > 0) & (F.col(seats) > 0)).withColumn("_n", F.count("*").over(whole)).withColumn("_d", depth)
    p = p.withColumn("_low", F.greatest(F.lit(0).cast("long"), fair - F.col("_d")))
    p = p.withColumn("_rest", F.col(seats) - F.sum("_low").over(whole))
    seat = p.select(*group, party, weight, "_rest", "_low", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("_d"))).alias("_j"))
    seat = seat.withColumn("_q", F.col(weight) / (2 * (F.col("_low") + F.col("_j")) + 1))
    order = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc("_q"), party, "_j")
    won = seat.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_rest"))
    won = won.groupBy(*group, party).agg(F.count("*").alias("_won"))
    keys = [*group, party]
    low = p.select(*keys, "_low")
    quota = low.join(won, keys, "left").select(*keys, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))
    return parties.join(quota, keys, "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))


def seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("#", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(str(seed))).cast("binary"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mark_of(seed: int) -> Column:
    """What places a document: a digest of its id and its text, so that rows that share an id are spread like any others."""
    return seeded(seed, F.col("doc_id").cast("long"), F.md5(F.col("text").cast("string").cast("binary")))


def plan(docs: DataFrame, block_words: int = 16, shard_words: int = 1_000_000, repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 8) -> DataFrame:
    """One row per document: doc_id, mark (a digest of id and text), source, size, source_size, target, shard, full (whole copies),
    part_from and part (a run of words from that word on, around the document's end), taken = full * size + part.

    Null texts have size 0; a null source is a source of its own, the last; a
    null doc_id is a document like any other; repeated rows count each time; an
    empty table gives no row; texts of any length are counted whole; columns
    other than doc_id, text and source are not read. No document is taken more
    than ``repeat`` times. Steps over sources hold one row per source.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sizes = materialize_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), mark_of(seed).alias("mark")))
    # One row per source from here to `sources`.
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    all_ = Window.partitionBy(F.lit(0))
    per = per.withColumn("sid", F.row_number().over(all_.orderBy(F.asc_nulls_last("source"))).cast("long")).withColumn("total", F.sum("source_size").over(all_))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (1 + F.pmod(F.col("sid") - 1, F.lit(len(weights)))).cast("int")).cast("double"))
    cap = (F.col("source_size") * repeat).cast("double")
    by_ratio = all_.orderBy(cap / F.col("w"), "sid")
    capped = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("total") - capped) / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("target", F.least(cap, F.max("level").over(all_) * F.col("w")))
    per = per.withColumn("seats", F.floor(F.col("total") / block_words + 0.5)).withColumn("weighed", F.col("total").cast("double"))
    per = sainte_lague(per, [], "sid", "target", "weighed", "seats")
    sources = per.select("source", "sid", "source_size", "target", F.col("quota").alias("source_quota"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards"))
    sources, _ = broadcast_if_small(sources)
    placed = sizes.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("shard", F.pmod(_number(F.col("mark")), F.col("shards")))
    shards = placed.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("source_quota").alias("source_quota"))
    shards = sainte_lague(shards, ["sid"], "shard", "shard_size", "source_size", "source_quota")
    take = F.least(F.col("quota") * block_words, F.col("shard_size") * repeat)
    blocks = F.greatest(F.ceil(F.col("shard_size") / block_words), F.lit(1))
    shards = shards.select(
        "sid", "shard", "shard_size",
        F.when(F.col("shard_size") > 0, F.floor(take / F.col("shard_size"))).otherwise(0).cast("long").alias("full"),
        F.when(F.col("shard_size") > 0, take % F.col("shard_size")).otherwise(0).cast("long").alias("rest"),
        (F.pmod(_number(seeded(seed, F.col("sid"), F.col("shard"))), blocks) * block_words).cast("long").alias("off"),
    )
    line = Window.partitionBy("sid", "shard").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("stop", F.sum("size").over(line)).withColumn("start", F.col("stop") - F.col("size"))
    laid = laid.join(shards, ["sid", "shard"])
    zero = F.lit(0).cast("long")
    off_end = F.col("off") + F.col("rest")
    direct = F.greatest(zero, F.least(F.col("stop"), off_end) - F.greatest(F.col("start"), F.col("off")))
    around = F.greatest(zero, F.least(F.col("stop"), off_end - F.col("shard_size")) - F.col("start"))
    part_from = F.when(direct > 0, F.greatest(F.col("start"), F.col("off")) - F.col("start")).otherwise(zero)
    laid = laid.select("doc_id", "mark", "source", "size", "source_size", "target", "shard", "full", part_from.alias("part_from"), (direct + around).alias("part"))
    return laid.withColumn("taken", F.col("full") * F.col("size") + F.col("part"))


def numbered(df: DataFrame, keys: list[str], name: str, run: int = 1000) -> DataFrame:
    """Add ``name``: 1, 2, ... among the rows of each key, in runs of at most ``run`` rows, so that no task gets a whole hot key.

    Only one row for each run of a key is summed up by key.
    """
    rows = materialize_table(df.withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_run", F.floor(F.col("_row") / run))
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("_row"))
    runs = rows.groupBy(*keys, "_run").count()
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*keys, "_run", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.withColumn("_place", place).join(runs, [*keys, "_run"]).withColumn(name, F.col("_place") + F.col("_before")).drop("_row", "_run", "_place", "_before")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, all columns kept: whole copies as often as taken, and the taken run of words of a document
    that is taken in part (words joined by one space; ``n_chars``, where present, follows).

    Rows of equal id, text and source share the takes that the plan gives them, one each. Null texts and
    texts without a word are never taken; null ids and sources are like any other; an empty table gives no row.
    """
    keys = ["_mark", "_source"]
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_source")
    takes = materialize_table(plan(docs, **options).select(F.col("mark").alias("_mark"), source, F.struct("full", "part_from", "part", "size").alias("_take"), (F.col("taken") > 0).alias("_taken")))
    # The document as one struct: no name of its columns can clash.
    rows = docs.select(mark_of(options.get("seed", 8)).alias("_mark"), source, F.struct(*docs.columns).alias("_doc"))
    repeated, many = broadcast_if_small(takes.groupBy(*keys).count().where("count > 1").select(*keys))
    taken = takes.where("_taken").drop("_taken")
    if many:
        alone = rows.join(taken.join(repeated, keys, "left_anti"), keys)
        shared = numbered(rows.join(repeated, keys, "left_semi"), keys, "_nth").join(numbered(taken.join(repeated, keys, "left_semi"), keys, "_nth"), [*keys, "_nth"])
        once = alone.select("_doc", "_take").unionByName(shared.select("_doc", "_take"))
    else:
        once = rows.join(taken, keys).select("_doc", "_take")
    none = F.array().cast("array<bigint>")
    # 1..full: whole copies; -1: the run of words taken in part.
    copies = F.concat(F.when(F.col("_take.full") > 0, F.sequence(F.lit(1).cast("long"), F.col("_take.full"))).otherwise(none), F.when(F.col("_take.part") > 0, F.array(F.lit(-1).cast("long"))).otherwise(none))
    once = once.select("_doc", "_take", F.explode(copies).alias("_copy"))
    whole = F.col("_doc").getField("text")
    words = F.regexp_extract_all(whole, F.lit(WORD_PATTERN), F.lit(0))
    first = F.least(F.col("_take.part"), F.col("_take.size") - F.col("_take.part_from")).cast("int")
    run = F.concat(F.slice(words, (F.col("_take.part_from") + 1).cast("int"), first), F.slice(words, F.lit(1), (F.col("_take.part") - first).cast("int")))
    text = F.when((F.col("_copy") > 0) | (F.col("_take.part") == F.col("_take.size")), whole).otherwise(F.array_join(run, " "))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return once.select(*[out[c].alias(c) if c in out else F.col("_doc").getField(c).alias(c) for c in docs.columns])
