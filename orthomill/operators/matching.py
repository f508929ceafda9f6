"""Greedy one-to-one matching of predicted and true objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import geometry as geo
from orthomill.operators.ordering import global_row_number
from orthomill.operators.spatial_join import box_join, polygon_iou
from orthomill.session import cut_lineage

BOX = ["x1", "y1", "x2", "y2"]
#: Keys with up to this many object pairs are folded in one array; others go round by round.
FOLD_LIMIT = 2_000


def _shapes(objects: DataFrame, keys: list[str], shape: list[str]) -> DataFrame:
    """Distinct shapes with their counts, polygons also with box and area; written once, since the join reads them several times."""
    counted = objects.groupBy(*keys, *shape).agg(F.count(F.lit(1)).alias("n"))
    if shape == BOX:
        return cut_lineage(counted)
    rings = F.col(shape[0])
    boxed = counted.withColumns({"_b": geo.bounds(rings), "_area": geo.polygon_area(rings)})
    return cut_lineage(boxed.select("*", *[F.col("_b")[c].alias(c) for c in BOX]).drop("_b").filter(F.col("x1").isNotNull()))


def _candidates(pred: DataFrame, gt: DataFrame, keys: list[str], iou_min: float, cell: float, shape: list[str]) -> DataFrame:
    """Pairs of distinct shapes with enough overlap: copies of a shape are one row with a count."""
    pairs = box_join(_shapes(pred, keys, shape), _shapes(gt, keys, shape), cell, keys)
    if shape == BOX:
        iou = geo.box_iou({c: F.col(c) for c in BOX}, {c: F.col(f"r_{c}") for c in BOX})
    else:
        # What the shared box and the areas allow at most is tested first; few pairs need their exact overlap.
        a, b = F.col("_area"), F.col("r__area")
        box = (F.least("x2", "r_x2") - F.greatest("x1", "r_x1")) * (F.least("y2", "r_y2") - F.greatest("y1", "r_y1"))
        most = F.least(box, a, b)
        pairs = pairs.filter(most * (1 + iou_min) >= (a + b) * iou_min * (1 - 1e-9))
        iou = polygon_iou(F.col(shape[0]), F.col(f"r_{shape[0]}"), (a, b))
    return pairs.withColumn("iou", iou).filter(F.col("iou") >= iou_min).select(
        *keys, F.struct(*shape).alias("p"), F.struct(*[F.col(f"r_{c}").alias(c) for c in shape]).alias("g"), "iou",
        F.col("n").alias("n_p"), F.col("r_n").alias("n_g"))


def match(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = ("tile_id",), iou_min: float = fixed.MATCH_IOU_MIN,
          cell: float = 64.0, fold_limit: int = FOLD_LIMIT, rings: str | None = None) -> DataFrame:
    """Matched pairs per key as ``(*keys, iou, matches)``; ``pred``/``gt`` have ``keys, idx`` and a box.

    With ``rings`` the objects are polygons in that column and their exact overlap counts. The pairs are worked out once. Pairs are taken best IoU first; equal IoUs go to the lower prediction index,
    then to the lower truth index. Keys with many pairs are matched in rounds with
    the same result, see :func:`match_in_rounds`.
    """
    if iou_min <= 0:
        raise ValueError("iou_min must be positive")
    keys = list(keys)
    shape = [rings] if rings else BOX
    pairs = cut_lineage(_candidates(pred, gt, keys, iou_min, cell, shape))
    large = pairs.groupBy(*keys).agg(F.sum(F.col("n_p") * F.col("n_g")).alias("_n")) \
        .filter(F.col("_n") > fold_limit).select(*keys)
    if large.isEmpty():
        return _fold(pairs, pred, gt, keys, shape)
    small = _fold(pairs.join(large, keys, "left_anti"), pred, gt, keys, shape)
    return small.unionByName(match_in_rounds(pairs.join(large, keys, "left_semi"), pred.join(large, keys, "left_semi"),
                                             gt.join(large, keys, "left_semi"), keys, shape=shape))


def _fold(pairs: DataFrame, pred: DataFrame, gt: DataFrame, keys: list[str], shape: list[str]) -> DataFrame:
    p = pred.select(*keys, F.struct(*shape).alias("p"), F.col("idx").alias("i"))
    g = gt.select(*keys, F.struct(*shape).alias("g"), F.col("idx").alias("j"))
    listed = pairs.select(*keys, "p", "g", "iou").join(p, [*keys, "p"]).join(g, [*keys, "g"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("minus"), "i", "j"))).alias("_pairs"))
    chosen = F.aggregate(
        "_pairs", F.slice("_pairs", 1, 0),
        lambda acc, e: F.when(F.exists(acc, lambda a: (a["i"] == e["i"]) | (a["j"] == e["j"])), acc)
        .otherwise(F.concat(acc, F.array(e))))
    return listed.select(*keys, F.explode(chosen).alias("m")).select(
        *keys, (-F.col("m.minus")).alias("iou"), F.lit(1).cast("long").alias("matches"))


def _queue(objects: DataFrame, keys: list[str], name: str, shape: list[str]) -> DataFrame:
    """Copies of each shape in index order: ``(*keys, shape, k, idx)``."""
    numbered = global_row_number(objects.select(*keys, *shape, "idx"), [*keys, *shape, "idx"], "_pos")
    first = numbered.groupBy(*keys, *shape).agg(F.min("_pos").alias("_first"))
    return cut_lineage(numbered.join(first, [*keys, *shape]).select(
        *keys, F.struct(*shape).alias(name), (F.col("_pos") - F.col("_first")).alias("k"), "idx"))


def match_in_rounds(pairs: DataFrame, pred: DataFrame, gt: DataFrame, keys: Sequence[str],
                    max_rounds: int = 1_000_000, shape: Sequence[str] = tuple(BOX)) -> DataFrame:
    """Greedy matching by joins, for keys with any number of objects.

    Copies of a box form a queue in index order. In each round a pair of boxes
    that is the best choice of both sides (by IoU, then the indices at the heads
    of the queues) is matched. If neither side has another partner with the same
    IoU, whole queues are matched at once; otherwise only the two heads.
    """
    keys = list(keys)
    queue_p, queue_g = _queue(pred, keys, "p", list(shape)), _queue(gt, keys, "g", list(shape))
    edges = cut_lineage(pairs.select(*keys, "p", "g", "iou"))

    def fresh(side: str, count: str, queue: DataFrame) -> DataFrame:
        left = pairs.select(*keys, side, F.col(count).alias("left")).distinct().withColumn("used", F.lit(0).cast("long"))
        return with_head(left, side, queue)

    def with_head(state: DataFrame, side: str, queue: DataFrame) -> DataFrame:
        heads = queue.select(*keys, side, F.col("k").alias("used"), F.col("idx").alias("head"))
        return cut_lineage(state.join(heads, [*keys, side, "used"]))

    def best(e: DataFrame, side: str) -> DataFrame:
        ties = e.groupBy(*keys, side, "iou").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("c"))
        return ties.groupBy(*keys, side).agg(F.max(F.struct("iou", "c", "o")).alias("b")).select(
            *keys, side, F.col("b.o").alias("o"), F.col("b.c").alias(f"ties_{side}"))

    state_p, state_g = fresh("p", "n_p", queue_p), fresh("g", "n_g", queue_g)
    done: list[DataFrame] = []
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        e = edges.join(state_p.select(*keys, "p", F.col("left").alias("left_p"), F.col("head").alias("i")), [*keys, "p"]) \
            .join(state_g.select(*keys, "g", F.col("left").alias("left_g"), F.col("head").alias("j")), [*keys, "g"]) \
            .withColumn("o", F.struct((-F.col("iou")).alias("minus"), "i", "j"))
        alone = (F.col("ties_p") == 1) & (F.col("ties_g") == 1)
        won = cut_lineage(
            e.join(best(e, "p"), [*keys, "p", "o"]).join(best(e, "g"), [*keys, "g", "o"])
            .withColumn("m", F.when(alone, F.least("left_p", "left_g")).otherwise(F.lit(1)).cast("long"))
            .select(*keys, "p", "g", "iou", "m"))
        done.append(won.select(*keys, "iou", F.col("m").alias("matches")))
        if len(done) >= 16:
            done = [cut_lineage(_union(done))]

        def consume(state: DataFrame, side: str, queue: DataFrame, won: DataFrame = won) -> DataFrame:
            taken = state.join(won.select(*keys, side, "m"), [*keys, side], "left") \
                .withColumn("m", F.coalesce("m", F.lit(0))) \
                .select(*keys, side, (F.col("left") - F.col("m")).alias("left"), (F.col("used") + F.col("m")).alias("used"))
            return with_head(taken.filter("left > 0"), side, queue)

        state_p, state_g = consume(state_p, "p", queue_p), consume(state_g, "g", queue_g)
        edges = cut_lineage(edges.join(state_p.select(*keys, "p"), [*keys, "p"], "left_semi")
                            .join(state_g.select(*keys, "g"), [*keys, "g"], "left_semi"))
    return _union(done) if done else pairs.select(*keys, "iou", F.lit(1).cast("long").alias("matches")).limit(0)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def match_metrics(spine: DataFrame, pred: DataFrame, gt: DataFrame, matches: DataFrame,
                  keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Precision, recall, F1, mean IoU and counts for every key of the spine.

    Nothing predicted and nothing true is a perfect score; only one side empty is 0.
    """
    keys = list(keys)
    joined = (
        spine.select(*keys).distinct()
        .join(pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("_p")), keys, "left")
        .join(gt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_g")), keys, "left")
        .join(matches.groupBy(*keys).agg(F.sum("matches").alias("_m"),
                                         F.sum(F.col("iou") * F.col("matches")).alias("_iou")), keys, "left")
        .select(*keys, *[F.coalesce(c, F.lit(0)).alias(n) for c, n in
                         (("_m", "matched"), ("_p", "total_pred"), ("_g", "total_gt"))],
                F.coalesce("_iou", F.lit(0.0)).alias("_iou"))
    )
    empty = (F.col("total_pred") == 0) & (F.col("total_gt") == 0)

    def ratio(a: str, b: str):
        return F.when(empty, F.lit(1.0)).when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    out = joined.withColumn("precision", ratio("matched", "total_pred")) \
        .withColumn("recall", ratio("matched", "total_gt")).withColumn("mean_iou", ratio("_iou", "matched"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))) \
        .drop("_iou")
