"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Each source's records fall into blocks of about equal size by a hash. Whole passes over a source and a
permuted rest of blocks meet its target. The exact block quotas of all sources are halved level by level, each half
drawn as from an urn without putting back, until one output shard is left per node; shards
then take disjoint stretches of every source's permuted blocks and are shuffled on their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthomill.llm.tables import by_merge, stored

SOURCE_KEY = "_source"


def source_key(source: Column) -> Column:
    """A key that is never null and keeps null apart from every text; it sorts null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source_size`` and ``target`` of each source of ``sized`` (``source_file``, ``size``), one row per source.

    Sources in code point order, null last, weigh ``weights``, repeating, and share ``share`` times all sizes. No target
    exceeds ``most`` times its source's size; what is above is shared anew by weight until none is above. That
    fixed point is a common level: with sources in the order in which they reach their ceilings, running sums over
    the one row per source give it at once.
    """
    sources = sized.groupBy(source_key(F.col("source_file")).alias(SOURCE_KEY)).agg(F.sum("size").cast("long").alias("source_size"))
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (
        F.pmod(F.row_number().over(Window.orderBy(SOURCE_KEY)) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("ceiling", most * F.col("source_size")).withColumn("full_at", F.col("ceiling") / F.col("weight"))
    order = Window.orderBy("full_at", SOURCE_KEY)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    levelled = ranked.withColumn(
        "level", (total - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The level at the first source that stays below its ceiling holds for all from there on.
    common = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", SOURCE_KEY, "level"))).over(everything)["level"]
    return levelled.withColumn("target", F.least("ceiling", F.coalesce(common * F.col("weight"), F.col("ceiling")))).select(
        SOURCE_KEY, "source_size", "target")


def _log_factorial(x: str) -> str:
    """SQL for ln(x!), to about 1e-13: tabled by factorial() up to 20, Stirling's series beyond."""
    return (f"if({x} <= 20, ln(cast(factorial(cast(least({x}, 20) as int)) as double)), ({x} + 0.5D) * ln({x} + 1.0D) - ({x} + 1.0D) + 0.9189385332046727D"
            f" + 1 / (12.0D * ({x} + 1)) - 1 / (360.0D * pow({x} + 1, 3)) + 1 / (1260.0D * pow({x} + 1, 5)))")


def hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for how many of ``marked`` items are among ``drawn`` of ``total``, by inversion from the mode outwards.

    The walk alternates up and down and covers 40 standard deviations, beyond which no mass is left in a double.
    """
    lf = _log_factorial
    return f"""transform(array(named_struct('t', cast({total} as long), 'k', cast({marked} as long), 'n', cast({drawn} as long), 'u', {uniform})), q ->
      if(q.t = 0 or q.k = 0 or q.n = 0, 0L, transform(array(named_struct(
          'lo', greatest(0L, q.n - (q.t - q.k)), 'hi', least(q.n, q.k),
          'm', greatest(greatest(0L, q.n - (q.t - q.k)), least(least(q.n, q.k), cast(floor((q.n + 1.0D) * (q.k + 1.0D) / (q.t + 2.0D)) as long))))), b ->
        aggregate(
          sequence(1L, least(b.hi - b.lo + 1, cast(ceil(40 * sqrt(q.n * (q.k / q.t) * (1.0D - q.k / q.t) + 1)) as long) + 2)),
          transform(array(exp({lf('q.k')} - {lf('b.m')} - {lf('(q.k - b.m)')} + {lf('(q.t - q.k)')} - {lf('(q.n - b.m)')}
            - {lf('(q.t - q.k - q.n + b.m)')} - {lf('q.t')} + {lf('q.n')} + {lf('(q.t - q.n)')})), p ->
            named_struct('left', q.u - p, 'found', if(q.u < p, b.m, -1L), 'up', b.m, 'pu', p, 'dn', b.m, 'pd', p))[0],
          (a, i) -> if(a.found >= 0, a, transform(array(named_struct(
              'pu', if(a.up < b.hi, a.pu * ((q.k - a.up) * 1.0D) * (q.n - a.up) / ((a.up + 1.0D) * (q.t - q.k - q.n + a.up + 1)), 0.0D),
              'pd', if(a.dn > b.lo, a.pd * (a.dn * 1.0D) * (q.t - q.k - q.n + a.dn) / ((q.k - a.dn + 1.0D) * (q.n - a.dn + 1)), 0.0D))), s ->
            named_struct('left', a.left - s.pu - s.pd,
              'found', if(a.left < s.pu, a.up + 1, if(a.left < s.pu + s.pd, a.dn - 1, -1L)),
              'up', least(a.up + 1, b.hi), 'pu', s.pu, 'dn', greatest(a.dn - 1, b.lo), 'pd', s.pd))[0]),
          a -> if(a.found >= 0, a.found, b.m)))[0]))[0]"""


def split_quotas(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """Share exact block quotas ``(_source, quota)`` among ``2**levels`` shards: ``(_source, shard, quota)``, zeros left out.

    A node holds one number per source. Its left half gets half of its blocks, how many of which
    source is a multivariate hypergeometric draw, made source by source.
    """
    root = quotas.filter("quota > 0").agg(F.sort_array(F.collect_list(F.struct(F.col(SOURCE_KEY).alias("s"), F.col("quota").cast("long").alias("q")))).alias("quotas"))
    nodes = root.select(F.lit(0).cast("long").alias("node"), "quotas")
    spread = int(quotas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for level in range(levels):
        uniform = f"shiftrightunsigned(xxhash64({seed}, {level}, node, x.s), 11) * pow(2.0D, -53)"
        draw = hypergeometric("a.total", "x.q", "a.drawn", uniform)
        all_blocks = "aggregate(quotas, 0L, (a, x) -> a + x.q)"
        # An odd block goes left or right by a hash of the node.
        half = f"(({all_blocks}) + pmod(xxhash64({seed}, 'odd', {level}, node), 2)) div 2"
        left = f"""aggregate(quotas, named_struct('total', {all_blocks}, 'drawn', cast({half} as long), 'left', array_remove(array(0L), 0L)),
          (a, x) -> transform(array({draw}), d -> named_struct('total', a.total - x.q, 'drawn', a.drawn - d, 'left', concat(a.left, array(d))))[0],
          a -> a.left)"""
        nodes = nodes.withColumn("_left", F.expr(left)).select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.expr("transform(quotas, (x, i) -> named_struct('s', x.s, 'q', _left[i]))").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("transform(quotas, (x, i) -> named_struct('s', x.s, 'q', x.q - _left[i]))").alias("quotas")))).alias("n")).select(
            "n.node", F.expr("filter(n.quotas, x -> x.q > 0)").alias("quotas"))
        if level % 4 == 3:
            nodes = nodes.repartition(spread, "node")
    return nodes.select(F.col("node").alias("shard"), F.explode("quotas").alias("x")).select(
        F.col("x.s").alias(SOURCE_KEY), "shard", F.col("x.q").alias("quota"))


def _running(rows: DataFrame, group: Sequence[str], key: Column, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before it in ``group`` by ``key`` (a hash), in two steps.

    Sums of 4,096 hash ranges are accumulated first, so no window holds more than a range of a group or its 4,096 sums.
    """
    cut = rows.withColumn("_key", key).withColumn("_range", F.shiftrightunsigned("_key", 52))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy(*group, "_range").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group, "_range").orderBy(F.shiftleft("_key", 12), *[c for c in rows.columns if c not in group]).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(ranges, [*group, "_range"]).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_key", "_range", "_before")


def block_of(tile_id: Column, blocks: Column, seed: int = 0) -> Column:
    """The block of a record within its source."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), tile_id), blocks)


def record_key(tile_id: Column, seed: int = 0) -> Column:
    """A record's place within its block."""
    return F.xxhash64(F.lit(seed), F.lit("record"), tile_id)


def plan(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
         block_size: int = 65_536, shard_blocks: int = 16, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """What a mix takes: sources ``(_source, source_size, target, blocks)`` and draws ``(_source, block, picks)``.

    ``picks`` lists ``(copy, shard, upto)``: the pass over the source, the output shard, and the last record key
    taken (null: the whole block), which cuts one block per source where its target is met.
    """
    sized = sized.filter(F.col("size") > 0)
    sources = stored(source_targets(sized, weights, share, most).withColumn(
        "blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / block_size))), "mix-sources")
    placed = sized.select("tile_id", "size", source_key(F.col("source_file")).alias(SOURCE_KEY)).join(
        sources.select(SOURCE_KEY, "blocks"), SOURCE_KEY).select(SOURCE_KEY, block_of(F.col("tile_id"), F.col("blocks"), seed).alias("block"), "tile_id", "size")
    blocks = stored(placed.groupBy(SOURCE_KEY, "block").agg(F.sum("size").alias("words")), "mix-blocks")
    passes = blocks.join(sources, SOURCE_KEY).withColumn("full", F.floor(F.col("target") / F.col("source_size")))
    passes = passes.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    whole = passes.filter("full > 0").select(SOURCE_KEY, "block", F.explode(F.expr("sequence(0L, full - 1)")).alias("copy"), F.lit(None).cast("double").alias("only"))
    last = _running(passes.select(SOURCE_KEY, "block", "words", "full", "rest"), [SOURCE_KEY],
                    F.xxhash64(F.lit(seed), F.lit("rest"), F.col(SOURCE_KEY), F.col("block")), "words", "before").filter("before < rest").select(
        SOURCE_KEY, "block", F.col("full").alias("copy"), F.when(F.col("before") + F.col("words") > F.col("rest"), F.col("rest") - F.col("before")).alias("only"))
    draws = stored(whole.unionByName(last), "mix-draws")
    # Where only part of a block is due, records are taken by key while most of them lies before the cut.
    by_key = Window.partitionBy(SOURCE_KEY, "block").orderBy("_key", "tile_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = (placed.join(draws.filter(F.col("only").isNotNull()).select(SOURCE_KEY, "block", "only"), [SOURCE_KEY, "block"])
           .withColumn("_key", record_key(F.col("tile_id"), seed)).withColumn("_before", F.coalesce(F.sum("size").over(by_key), F.lit(0)))
           .groupBy(SOURCE_KEY, "block").agg(F.max(F.when(F.col("_before") + F.col("size") / 2 <= F.col("only"), F.col("_key"))).alias("upto")))
    known = draws.join(cut, [SOURCE_KEY, "block"], "left").filter(F.col("only").isNull() | F.col("upto").isNotNull()).select(
        SOURCE_KEY, "block", "copy", F.when(F.col("only").isNotNull(), F.col("upto")).alias("upto"), F.lit(1).cast("long").alias("one"))
    slots = _running(known, [SOURCE_KEY], F.xxhash64(F.lit(seed), F.lit("slot"), F.col(SOURCE_KEY), F.col("copy"), F.col("block")), "one", "slot")
    quotas = known.groupBy(SOURCE_KEY).agg(F.count(F.lit(1)).alias("quota"))
    n = quotas.agg(F.sum("quota")).first()[0] or 0
    levels = max(0, (-(-n // shard_blocks) - 1).bit_length())
    taken = Window.partitionBy(SOURCE_KEY).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = split_quotas(quotas, levels, seed).withColumn("start", F.coalesce(F.sum("quota").over(taken), F.lit(0))).select(
        SOURCE_KEY, "shard", F.explode(F.expr("sequence(start, start + quota - 1)")).alias("slot"))
    picks = slots.join(by_merge(shards), [SOURCE_KEY, "slot"]).groupBy(SOURCE_KEY, "block").agg(
        F.sort_array(F.collect_list(F.struct("copy", "shard", "upto"))).alias("picks"))
    return sources, stored(picks, "mix-picks")


def draw(records: DataFrame, sources: DataFrame, picks: DataFrame, seed: int = 0) -> DataFrame:
    """``records`` (``tile_id``, ``source_file``, ``size``, others) with ``source_size``, ``target`` and ``draws`` (copy, shard)."""
    placed = records.withColumn(SOURCE_KEY, source_key(F.col("source_file"))).join(sources, SOURCE_KEY, "left").withColumn(
        "block", F.when(F.col("size") > 0, block_of(F.col("tile_id"), F.col("blocks"), seed)))
    mine = F.filter("picks", lambda p: p.upto.isNull() | (record_key(F.col("tile_id"), seed) <= p.upto))
    drawn = F.coalesce(F.transform(mine, lambda p: F.struct(p["copy"].alias("copy"), p.shard.alias("shard"))), F.array().cast("array<struct<copy:bigint,shard:bigint>>"))
    return placed.join(picks, [SOURCE_KEY, "block"], "left").withColumn("draws", drawn).withColumns({
        "source_size": F.coalesce("source_size", F.lit(0).cast("long")), "target": F.coalesce("target", F.lit(0.0))}).drop(
        SOURCE_KEY, "block", "blocks", "picks")


def mix_records(sized: DataFrame, **options) -> DataFrame:
    """Take records of every ``source_file`` so that their sizes sum to the source's target; one row per record.

    ``sized``: ``tile_id``, ``source_file``, ``size`` (long >= 0). Returns these with ``source_size``, ``target``
    (see ``source_targets``), ``draws``, an array of ``(copy, shard)``, at most two per record, and ``taken``, the size times
    its draws. Records of size 0 or null are never drawn; a source without size has target 0. A null source is a source of its own, last in order. A
    null ``tile_id`` is an id like any other; repeated rows share their hash, so they are drawn together. The choice depends on
    ids, sources, sizes and ``seed`` alone: reruns agree, however the table is laid out. An empty table gives an empty table.
    Sums are within one record of the target. Options: those of ``plan``.
    """
    clean = stored(sized.select("tile_id", "source_file", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("size")), "mix-sized")
    sources, picks = plan(clean, **options)
    return draw(clean, sources, picks, options.get("seed", 0)).withColumn("taken", F.col("size") * F.size("draws"))


def mixed_notes(feedback: DataFrame, size: Column, **options) -> DataFrame:
    """The rows of ``feedback`` as a mix takes them, twice where drawn twice: shards in order, each shuffled on its own."""
    seed = options.get("seed", 0)
    clean = stored(feedback.select("tile_id", "source_file", size.cast("long").alias("size")), "mix-sized")
    sources, picks = plan(clean, **options)
    carried = feedback.select(F.struct(*[F.col(f"`{c}`") for c in feedback.columns]).alias("_row"), "tile_id", "source_file", size.cast("long").alias("size"))
    copies = draw(carried, sources, picks, seed).select("_row", "tile_id", F.explode("draws").alias("d"))
    spread = int(feedback.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (copies.repartition(spread, "d.shard")
            .sortWithinPartitions("d.shard", F.xxhash64(F.lit(seed), F.lit("order"), "d.shard", "tile_id", "d.copy"))
            .select("_row.*"))
