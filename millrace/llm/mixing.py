"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of words. Each source's target fixes an exact quota of blocks, some
of them drawn twice. The quotas of all sources are split among the output shards by a binary tree:
at each node the left half's share of every source is a multivariate hypergeometric draw, the right
half gets what is left. A shard then takes a run of its own of each source's permuted blocks and
shuffles them. Which block goes where follows from a seed and the ids alone, so reruns agree.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from millrace.session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS = 128
LEVELS = 4              # 2 ** LEVELS shards
BUCKET_BITS = 12        # a source's permuted order is cut into so many ranges for prefix sums
REACH = 9.0             # standard deviations around the mode that a draw can reach (1e-18 beyond)
SEED = 20240501


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that follows from the parts."""
    return ((F.shiftrightunsigned(F.xxhash64(*parts), 11) + 0.5) / float(1 << 53)).cast("double")


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, id, source, size) of every row; ``row`` only tells repeated rows apart."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of each source.

    Sources in code point order, null last, get ``weights`` in turn and share ``share`` times all
    words by weight; none gets more than ``most`` times its own, and what it would have got beyond
    that is reshared. With sources by falling need for their cap (cap / weight ascending), one is
    capped exactly if its share of what the ones before leave still reaches its cap, so one pass
    replaces the resharing rounds. The windows here hold one row per source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    rows = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    rows = (rows.withColumn("wanted", F.sum("source_size").over(everything) * share)
            .withColumn("gone", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            .withColumn("weights_left", F.sum("weight").over(onward)))
    capped = (F.col("wanted") - F.col("gone")) * F.col("weight") >= F.col("cap") * F.col("weights_left")
    rows = rows.withColumn("capped", capped)
    rows = (rows.withColumn("rest", F.col("wanted") - F.sum(
                F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything))
            .withColumn("open", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight")))
                        .over(everything)))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.col("rest") * F.col("weight") / F.col("open"))
    return rows.select("source", "source_size", target.alias("target"))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many good ones are among ``draws`` of ``total``: inversion outwards from the mode.

    Probabilities relative to the mode's follow by ratio upwards and downwards; a first walk sums
    them and a second stops where the running sum passes u times that sum.
    """
    low = F.greatest(F.lit(0), draws + good - total)
    high = F.least(draws, good)
    share = good / F.greatest(total, F.lit(1))
    deviation = F.sqrt(F.greatest(F.lit(0.0), draws * share * (1 - share) * (total - draws)
                                  / F.greatest(total - 1, F.lit(1))))
    reach = F.ceil(deviation * REACH).cast("long") + 10
    mode = F.least(high, F.greatest(low, F.floor(
        (draws + 1).cast("double") * (good + 1) / (total + 2)).cast("long")))
    steps = {+1: F.least(high - mode, reach), -1: F.least(mode - low, reach)}

    def ratio(k: Column, way: int) -> Column:
        """P(next) / P(k) one step on."""
        g, t, d = good.cast("double"), total.cast("double"), draws.cast("double")
        if way > 0:
            return (g - k) * (d - k) / ((k + 1) * (t - g - d + k + 1))
        return k * (t - g - d + k) / ((g - k + 1) * (d - k + 1))

    def walk(way: int, start, merge, finish) -> Column:
        some = F.when(steps[way] > 0, F.sequence(F.lit(0).cast("long"), steps[way] - 1)).otherwise(
            F.array().cast("array<long>"))
        return F.aggregate(some, start, lambda s, i: merge(s, mode + way * i), finish)

    def mass(way: int) -> Column:
        return walk(way, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")), lambda s, k: F.struct(
            (s["p"] * ratio(k, way)).alias("p"), (s["sum"] + s["p"] * ratio(k, way)).alias("sum")),
            lambda s: s["sum"])

    def seek(way: int, aim: Column) -> Column:
        """Steps needed until the sum from the mode on reaches the aim; null if it never does."""
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("at"))
        return walk(way, start, lambda s, k: F.struct(
            (s["p"] * ratio(k, way)).alias("p"), (s["sum"] + s["p"] * ratio(k, way)).alias("sum"),
            F.coalesce(s["at"], F.when(s["sum"] + s["p"] * ratio(k, way) >= aim, k + way)).alias("at")),
            lambda s: s["at"])

    def with_masses(masses: Column) -> Column:
        up, down = masses["up"], masses["down"]
        aim = u * (1.0 + up + down)
        return F.coalesce(F.when(aim <= 1.0, mode), F.when(aim <= 1.0 + up, seek(+1, aim - 1.0)),
                          seek(-1, aim - 1.0 - up), mode)

    return F.transform(F.array(F.struct(mass(+1).alias("up"), mass(-1).alias("down"))), with_masses)[0]


def split_quotas(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(source, shard, first): where each shard's run of a source's draws starts.

    ``quotas``: (source, quota). One row per tree node with an array of all sources' quotas; each
    level turns every node into two.
    """
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct(
        F.col("source").isNull().alias("last"), "source", "quota"))).alias("q"), F.lit(0).alias("node"))
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x["quota"])
        start = F.struct(F.floor(total / 2).alias("draws"), total.alias("total"),
                         F.array().cast("array<long>").alias("left"))

        def draw(state: Column, x: Column) -> Column:
            u = uniform(F.lit(seed), F.lit(level), F.col("node"), F.size(state["left"]))  # noqa: B023
            picked = hypergeometric(x["quota"], state["total"], state["draws"], u)
            return F.transform(F.array(picked), lambda k: F.struct(
                (state["draws"] - k).alias("draws"), (state["total"] - x["quota"]).alias("total"),
                F.concat(state["left"], F.array(k)).alias("left")))[0]

        nodes = nodes.withColumn("left", F.aggregate("q", start, draw, lambda s: s["left"]))
        half = lambda amount: F.zip_with("q", "left", lambda x, k: F.struct(
            x["last"].alias("last"), x["source"].alias("source"), amount(x["quota"], k).alias("quota")))
        nodes = nodes.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), half(lambda q, k: k).alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), half(lambda q, k: q - k).alias("q"))
        )).alias("n")).select("n.node", "n.q")
    leaves = nodes.select(F.col("node").alias("shard"), F.inline("q")).drop("last")
    run = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return leaves.select("source", "shard", F.coalesce(F.sum("quota").over(run), F.lit(0)).alias("first"))


def mix(sizes: DataFrame, aims: DataFrame, block_words: int = BLOCK_WORDS, levels: int = LEVELS,
        seed: int = SEED) -> DataFrame:
    """The mix as blocks: (row, id, source, block, first_word, n_words, epoch, shard, place).

    ``sizes`` and ``aims`` come from ``sizes_of`` and ``targets``; both are read more than once, so
    pass written tables. ``first_word`` counts from 1. ``epoch`` tells a block's draws apart.
    ``place`` orders a shard's blocks (the local shuffle). A source's words are its target within
    one block. No shuffle is keyed by source alone: a source's permuted order is cut into ranges,
    sums run over ranges, and only rows of one range are ranked together.
    """
    blocks = sizes.filter("size > 0").select(
        "row", "id", "source", "size",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block_words))).alias("block"))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "block"), 1)
    blocks = (blocks.withColumn("first_word", F.col("block") * block_words + 1)
              .withColumn("n_words", F.least(F.lit(block_words).cast("long"),
                                             F.col("size") - F.col("block") * block_words))
              .withColumn("key", key).withColumn("bucket", F.shiftright("key", 63 - BUCKET_BITS))
              .withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("size"))
    in_bucket = W.partitionBy("s", "bucket").orderBy("key", "row")
    ranked = (blocks.withColumn("rank", F.row_number().over(in_bucket) - 1)
              .withColumn("words", F.sum("n_words").over(in_bucket.rowsBetween(W.unboundedPreceding, -1))))
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    goal = aims.filter("source_size > 0").select(
        name.alias("s"), F.floor(F.col("target") / F.col("source_size")).alias("full"),
        (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
         ).alias("part"))
    before = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = (blocks.groupBy("s", "bucket").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
               .withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
               .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
               .withColumn("n_all", F.sum("n").over(W.partitionBy("s")))
               .join(goal, "s"))
    counted = ranked.join(buckets, ["s", "bucket"]).withColumn(
        "partial", F.col("w_before") + F.coalesce("words", F.lit(0)) + F.col("n_words") / 2 <= F.col("part"))
    folder = scratch_dir(sizes.sparkSession, "mix")
    (counted.withColumn("draws", F.col("full") + F.col("partial").cast("long")).filter("draws > 0")
     .select("row", "id", "source", "s", "block", "first_word", "n_words", "draws", "n_all",
             (F.col("n_before") + F.col("rank")).alias("rank"), "bucket")
     .write.parquet(f"{folder}/drawn"))
    drawn = sizes.sparkSession.read.parquet(f"{folder}/drawn")
    quotas = drawn.groupBy(F.col("s").alias("source")).agg(F.sum("draws").alias("quota"))
    split_quotas(quotas, levels, seed).write.parquet(f"{folder}/shards")
    firsts = (sizes.sparkSession.read.parquet(f"{folder}/shards").groupBy(F.col("source").alias("s"))
              .agg(F.sort_array(F.collect_list("first")).alias("firsts")))     # one entry per shard
    # the shard boundaries that a range of draws can meet go along with the range, not the source
    ranges = (drawn.select("s", "bucket", "n_all", "rank", F.explode(F.sequence(
                  F.lit(0).cast("long"), F.col("draws") - 1)).alias("epoch"))
              .groupBy("s", "bucket", "epoch")
              .agg(F.min(F.col("epoch") * F.col("n_all") + F.col("rank")).alias("from"),
                   F.max(F.col("epoch") * F.col("n_all") + F.col("rank")).alias("to"))
              .join(firsts, "s")
              .select("s", "bucket", "epoch",
                      F.size(F.filter("firsts", lambda f: f <= F.col("from"))).alias("base"),
                      F.filter("firsts", lambda f: (f > F.col("from")) & (f <= F.col("to"))).alias("near")))
    draws = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)))
    number = F.col("epoch") * F.col("n_all") + F.col("rank")
    return draws.join(ranges, ["s", "bucket", "epoch"]).select(
        "row", "id", "source", "block", "first_word", "n_words", "epoch",
        (F.col("base") - 1 + F.size(F.filter("near", lambda f: f <= number))).cast("int").alias("shard"),
        F.xxhash64(F.lit(seed + 1), "id", "block", "epoch").alias("place"))


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(sizes, targets), written and reread."""
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession, "sizes")
    sizes_of(docs, id_col, text_col, source_col).write.parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes")
    targets(sizes, weights, share, most).write.parquet(f"{folder}/targets")
    return sizes, spark.read.parquet(f"{folder}/targets")


def block_texts(blocks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``text`` to blocks: their words with the white space after each.

    Texts are looked up by id; rows that share an id must hold one text. A text is split into words
    once, whatever the number of its blocks (at most twice its words / block size).
    """
    fields = [c for c in blocks.columns if c != "id"]
    wanted = blocks.groupBy("id").agg(F.collect_list(F.struct(*fields)).alias("blocks"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropDuplicates(["id"])
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.transform(F.array(words), lambda w: F.transform("blocks", lambda b: F.struct(
        *(b[c].alias(c) for c in fields),
        F.array_join(F.slice(w, b["first_word"].cast("int"), b["n_words"].cast("int")), "").alias("text"))))[0]
    return wanted.join(texts, "id").select("id", F.inline(cut))


def write_shards(blocks: DataFrame, path: str) -> None:
    """One folder per shard, its blocks in shuffled order; a shard may span several files."""
    (blocks.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
     .write.partitionBy("shard").parquet(path))


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    sizes, aims = planned(spark.read.parquet(f"{folder}/documents.parquet"))
    taken = mix(sizes, aims).groupBy("row").agg(
        F.sum("n_words").alias("taken"), F.count("*").alias("n_blocks"),
        F.countDistinct("shard").alias("n_shards"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    goals = aims.select(name("source").alias("s"), "source_size", "target")
    return (sizes.withColumn("s", name("source")).join(goals, "s").join(taken, "row", "left")
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                    *(F.coalesce(c, F.lit(0)).alias(c) for c in ("taken", "n_blocks", "n_shards"))))
