"""Merkle manifest of feedback rows: node rows linked to what is above them, climbed by a recursive query.

Every source's rows, in order of ``tile_id``, are the leaves of a tree in which three neighbours become their digest until one is left, the
source's root; the sources' roots are the leaves of the top tree. Built levels are stored as node rows. A row stands for a
node six levels below the node it links to and holds the siblings of those six steps, so a climb of millions of rows needs four
joins. What is compared per row is folded along the way by Spark's own recursive query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill.llm.tables import let, stored
from orthomill.operators.ordering import global_row_number

#: Neighbours that become one digest, and levels that one node row spans.
RUN, LEVELS = 3, 6
BLOCK = RUN ** LEVELS
#: Climbing rows that one copy of a node serves; a node above more leaves is repeated.
CLIMBERS = 50_000
#: The group number of the tree over the sources.
TOP = -1

_NODE = ["grp", "tier", "at", "leaves", "steps", "up_grp", "up_tier", "up_at", "up_shares", "top"]


@dataclass(frozen=True)
class Manifest:
    """``leaves`` and ``nodes`` are stored tables, ``root`` is the digest over all (None without rows)."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 (lower-case hex) of the fields one after another."""
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _above(level: Column, ends: Column) -> Column:
    """The next level of an array of hex digests; the same where one is left and the tree ends."""
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / RUN).cast("int") - 1),
                       lambda i: F.sha2(F.array_join(F.slice(level, i * RUN + 1, RUN), ""), 256))
    return F.when(ends & (F.size(level) == 1), level).otherwise(runs)


def _siblings(level: Column, place: Column, ends: Column) -> Column:
    """What stands left and right of ``place`` in its run, as bytes; null where no step is taken."""
    first = F.floor(place / RUN).cast("int") * RUN
    left = F.unhex(F.array_join(F.slice(level, first + 1, place - first), ""))
    right = F.unhex(F.array_join(F.slice(level, place + 2, first + RUN - 1 - place), ""))
    return F.when(~(ends & (F.size(level) == 1)), F.struct(left.alias("left"), right.alias("right")))


def _tier(nodes: DataFrame, tier: int, payload: Sequence[str], name: str) -> DataFrame:
    """Node rows of one tier from ``(grp, at, digest, leaves, n)`` and ``payload``, where ``n`` counts the group's nodes in the tier.

    At most ``BLOCK`` neighbours come together. ``up_at`` is the block, ``top`` the group's last digest where the tree ends here,
    ``above`` the digest that the block becomes.
    """
    member = F.struct("at", "digest", "leaves", *payload)
    block = nodes.groupBy("grp", F.floor(F.col("at") / BLOCK).alias("block"), "n").agg(F.sort_array(F.collect_list(member)).alias("members"))
    ends = F.col("n") <= BLOCK

    def read(levels: Column) -> Column:
        def row(m: Column, k: Column) -> Column:
            steps = F.array_compact(F.transform(F.slice(levels, 1, LEVELS), lambda level, i: _siblings(level, F.floor(k / F.pow(F.lit(RUN), i)).cast("int"), ends)))
            return F.struct(*[m[c].alias(c) for c in ("at", "leaves", "digest", *payload)], steps.alias("steps"))
        return F.struct(F.transform("members", row).alias("rows"), F.unhex(F.get(F.get(levels, LEVELS), 0)).alias("above"))

    # All levels of a block are made once and read inside the block, so they are not copied to each of its rows.
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(F.transform("members", lambda m: _hex(m["digest"]))),
                         lambda made, i: F.concat(made, F.array(_above(F.get(made, i - 1), ends))))
    served = F.aggregate("members", F.lit(0).cast("long"), lambda s, m: s + m["leaves"])
    rows = block.select("grp", "block", "n", served.alias("served"), let(levels, read).alias("x"))
    return stored(rows.select("grp", "block", "n", "served", F.col("x.above").alias("above"), F.explode("x.rows").alias("m")).select(
        "grp", F.lit(tier).alias("tier"), *[F.col(f"m.{c}").alias(c) for c in ("at", "leaves", "digest", *payload, "steps")],
        ends.alias("ends"), F.col("block").alias("up_at"), "served", "n", "above"), name)


def _tree(nodes: DataFrame, largest: int, payload: Sequence[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """All tiers of the groups' trees, and ``(grp, digest, leaves)`` of each group's last digest."""
    tiers, tops, tier = [], None, 0
    while True:
        built = _tier(nodes, tier, payload if tier == 0 else (), f"{name}-{tier}")
        tiers.append(built)
        done = built.filter("ends and at = 0").select("grp", F.col("above").alias("digest"), F.col("served").alias("leaves"))
        tops = done if tops is None else tops.unionByName(done)
        if largest <= BLOCK ** (tier + 1):
            return tiers, tops
        nodes = built.filter(f"not ends and at % {BLOCK} = 0").select(
            "grp", F.col("up_at").alias("at"), F.col("above").alias("digest"), F.col("served").alias("leaves"), F.ceil(F.col("n") / BLOCK).alias("n"))
        tier += 1


def _linked(tier: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """A tier's rows with links: to their block, or from a source's last tier to the top tree, or nowhere."""
    ends, is_top = F.col("ends"), F.col("grp") == TOP
    shares = F.ceil(F.col("served") / CLIMBERS).cast("int")
    return tier.withColumns({
        "up_grp": F.when(~ends, F.col("grp")).when(~is_top, F.lit(TOP).cast("long")),
        "up_tier": F.when(ends, F.lit(0)).otherwise(F.col("tier") + 1),
        "up_at": F.when(ends, F.col("grp")).otherwise(F.col("up_at")),
        "up_shares": shares, "top": F.when(ends & ~is_top, F.col("above"))}).select(*_NODE, *extra)


def build(feedback: DataFrame, fields: Sequence[str] = ("tile_id", "source_file", "notes"), found: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of ``feedback`` rows; needs ``tile_id``, ``source_file`` and the ``fields`` that a leaf covers, in their order.

    A leaf is the digest of the fields (``leaf_digest``). ``found`` names fields that are seen otherwise when the rows are checked
    later, as columns over ``feedback``; ``audit`` folds those. Leaves of a ``source_file`` ascend by ``tile_id``, null first, then by
    digest, so repeated rows are leaves of their own; sources ascend by UTF-8 bytes, null first. No rows give no root. Other columns
    are not read. The order comes from range partitions, so a source with a third of all rows is cut over many tasks.
    """
    found = found or {}
    leaf = leaf_digest([F.col(f) for f in fields])
    seen = leaf_digest([found.get(f, F.col(f)) for f in fields])
    digests = feedback.select("tile_id", F.col("source_file").alias("source"), F.unhex(leaf).alias("digest"), F.unhex(seen).alias("seen"))
    placed = stored(global_row_number(digests, [F.asc_nulls_first("source"), F.asc_nulls_first("tile_id"), "digest"], "place"), "manifest-order")
    sources = placed.groupBy("source").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    sources = stored(global_row_number(sources, [F.asc_nulls_first("source")], "grp"), "manifest-sources")
    sizes = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("largest")).first()
    known = sources.select(F.col("source").alias("_s"), "first", "n", "grp")
    nodes = placed.join(known, F.col("source").eqNullSafe(F.col("_s"))).select(
        "grp", (F.col("place") - F.col("first")).alias("at"), "digest", F.lit(1).cast("long").alias("leaves"), "n", "tile_id", "seen")
    tiers, tops = _tree(nodes, sizes.largest or 0, ("tile_id", "seen"), "manifest-tier")
    top_nodes = tops.select(F.lit(TOP).cast("long").alias("grp"), F.col("grp").alias("at"), "digest", "leaves", F.lit(sizes.sources).cast("long").alias("n"))
    top_tiers, root = _tree(top_nodes, sizes.sources, (), "manifest-top")
    above = [_linked(t) for t in [*tiers[1:], *top_tiers]]
    all_above = above[0]
    for t in above[1:]:
        all_above = all_above.unionByName(t)
    shares = F.sequence(F.lit(0), F.ceil(F.col("leaves") / CLIMBERS).cast("int") - 1)
    final = root.first()
    return Manifest(
        leaves=_linked(tiers[0], ("tile_id", "digest", "seen")),
        nodes=stored(all_above.withColumn("share", F.explode(shares)), "manifest-nodes"),
        root=final.digest.hex() if final else None)


_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tile_id, digest, up_grp, up_tier, up_at, up_shares, folded, proof, subroot FROM {start}
  UNION ALL
  SELECT c.tile_id, c.digest, n.up_grp, n.up_tier, n.up_at, n.up_shares,
         aggregate(n.steps, c.folded, (h, s) -> unhex(sha2(concat(lower(hex(s.left)), lower(hex(h)), lower(hex(s.right))), 256))),
         aggregate(n.steps, c.proof, (p, s) -> concat(p, s.left, s.right)),
         coalesce(c.subroot, n.top)
  FROM climb c JOIN {nodes} n
    ON c.up_grp = n.grp AND c.up_tier = n.tier AND c.up_at = n.at AND pmod(xxhash64(c.digest), c.up_shares) = n.share)
SELECT tile_id, digest, folded, proof, subroot FROM climb WHERE up_grp IS NULL LIMIT ALL"""


def audit(manifest: Manifest) -> DataFrame:
    """Every leaf's way up: ``tile_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    The recursive query ascends from every leaf at once, appends the siblings it passes (left to right, level by level, through the source's root to
    the root) and folds what was found in the leaf's place over them. ``proof_sha256`` is the digest of the siblings' hex,
    ``folded_root`` what the row as found comes to and ``verified`` whether that is the root. One row per leaf; none without rows.
    """
    start = manifest.leaves.select(
        "tile_id", "digest", "up_grp", "up_tier", "up_at", "up_shares",
        F.aggregate("steps", F.col("seen"), lambda h, s: F.unhex(F.sha2(F.concat(_hex(s["left"]), _hex(h), _hex(s["right"])), 256))).alias("folded"),
        F.aggregate("steps", F.lit(b""), lambda p, s: F.concat(p, s["left"], s["right"])).alias("proof"), F.col("top").alias("subroot"))
    climbed = stored(manifest.leaves.sparkSession.sql(_CLIMB, start=start, nodes=manifest.nodes), "manifest-climbed")
    root = F.lit(manifest.root).cast("string")
    return climbed.select(
        "tile_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2(_hex(F.col("proof")), 256).alias("proof_sha256"),
        _hex(F.col("folded")).alias("folded_root"), (_hex(F.col("folded")) == root).alias("verified"))
