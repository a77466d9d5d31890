"""A Merkle manifest of a table: leaves by group, subroots of the groups, one root, and a proof for each leaf by pointer jumping.

A node stands for a run of FAN consecutive nodes of the level below; the last run of a level may be shorter, down to one. Where a
single node is left, the groups' subroots form a tree of the same kind, which gives the root.

A proof is a list of segments, leaf first: the run that a node on the way to the root lies in, and its place there. Every inner node
starts with the segment towards its parent. In each round a node takes the segments of the ancestor that it has reached and that node's ancestor, so
the distance doubles; leaves then take the segments of the node of their own run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, discard, ranked, stored

FAN, DIGEST = 16, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENTS = "array<struct<run:binary,at:int>>"
#: Ancestors that are broadcast at most, with their segments (about 530 bytes for each level above them).
BROADCAST_NODES = BROADCAST_IDS >> 9


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 (lower-case hex) of the fields: each \"-\" if null, else its UTF-8 length in bytes, \":\" and its text."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told), 256)


def _hex(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def _others(s: Column) -> tuple[Column, Column]:
    """The hex digests of a segment's run before and after the node itself."""
    run = _hex(s["run"])
    return F.substr(run, F.lit(1), s["at"] * 2 * DIGEST), F.substr(run, s["at"] * 2 * DIGEST + 2 * DIGEST + 1)


def siblings(proof: Column) -> Column:
    """All siblings of a proof as hex, level by level from the leaf on, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(*_others(s))), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and the siblings of its proof give."""

    def up(at: Column, s: Column) -> Column:
        left, right = _others(s)
        return F.sha2(F.concat(left, at, right), 256)

    return F.aggregate(proof, leaf, up)


def _height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _node(tree: Column, level: Column | int, index: Column) -> Column:
    return F.concat_ws("/", tree.cast("string"), (F.lit(level) if isinstance(level, int) else level).cast("string"), index.cast("string"))


def _runs(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """tree, place, n, run, digest of the level above nodes (tree, place, n, digest); members too, with the kept columns, where there are any."""
    members = F.sort_array(F.collect_list(F.struct(F.col("place").alias("at"), "digest", *kept)))
    up = nodes.groupBy("tree", F.floor(F.col("place") / FAN).alias("up")).agg(F.first("n").alias("n"), members.alias("members"))
    text = F.array_join(F.transform("members", lambda m: F.lower(F.hex(m["digest"]))), "")
    up = up.select("tree", F.col("up").alias("place"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.unhex(text).alias("run"), F.unhex(F.sha2(text, 256)).alias("digest"), "members")
    return up if kept else up.drop("members")


def _upwards(first: DataFrame, most: int) -> list[DataFrame]:
    """The levels above and including first, which is level 1 of trees with at most most nodes there; each is written."""
    levels = [first.withColumn("level", F.lit(1))]
    while most > 1:
        most = -(-most // FAN)
        up, _ = stored(_runs(levels[-1].where("n > 1").select("tree", "place", "n", "digest"), []), "merkle-level")
        levels.append(up.withColumn("level", F.lit(len(levels) + 1)))
    return levels


def _reached(nodes: DataFrame, depth: int) -> DataFrame:
    """node, run and the segments towards the root, by pointer jumping over nodes (node, above, at, run); only the root has a null above."""
    spark = nodes.sparkSession
    parents = nodes.select(F.col("node").alias("above"), F.col("run").alias("over"))
    segment = F.array(F.struct(F.col("over").alias("run"), "at"))
    none = F.array().cast(SEGMENTS)
    begun = nodes.join(parents, "above", "left").select("node", "run", F.col("above").alias("ancestor"), F.when(F.col("above").isNull(), none).otherwise(segment).alias("segments"))
    reached, path = stored(begun, "merkle-jump")
    distance = 1
    while distance < depth:
        wanted = reached.select(F.col("ancestor").alias("node")).where("node is not null").distinct()
        known = reached.join(wanted, "node", "left_semi").select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("segments").alias("more"))
        known, known_path = stored(known, "merkle-ancestors")
        few = known.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        jumped = reached.join(F.broadcast(known) if few else known, "ancestor", "left")
        jumped = jumped.select("node", "run", F.col("next").alias("ancestor"), F.concat("segments", F.coalesce("more", none)).alias("segments"))
        before, (reached, path) = path, stored(jumped, "merkle-jump")
        discard(spark, before, known_path)
        distance *= 2
    return reached.select("node", "run", "segments")


def proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", tampered: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, other, subroot, root (hex) and proof (array of run and at, leaf first): one row for each row of docs.

    Leaves of a group ascend by order, then by their hash; groups ascend bytewise; nulls come first in both, so a null group is a group and a
    null id a leaf. Rows that are equal in all fields are leaves each, with a proof for each place. other is the leaf with the columns in
    tampered in place of its own (the leaf itself if none are given). Texts of any length are hashed whole where they are read and never
    shuffled. An empty table gives no rows; a single leaf is its own subroot and root, with an empty proof. Only fields, group and order are
    read, so other columns may have any name.
    """
    spark = docs.sparkSession
    changed = tampered or {}
    leaf, other = leaf_hash([F.col(f) for f in fields]), leaf_hash([changed.get(f, F.col(f)) for f in fields])
    rows = docs.select(F.col(group).cast("string").alias("group_key"), F.col(order).cast("long").alias("id"), F.unhex(leaf).alias("digest"), (F.unhex(other) if changed else F.lit(None).cast("binary")).alias("other"))
    rows, _ = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "merkle-hashes")
    placed = ranked(rows, ["group_key"], ["id", "digest", "uid"])
    leaves, _ = stored(placed.select(F.col("group").alias("tree"), F.col("rank").alias("place"), F.col("total").alias("n"), "id", "digest", "other"), "merkle-leaves")
    trees, most = leaves.agg(F.max("tree") + 1, F.max("n")).first()
    if trees is None:
        return spark.createDataFrame([], f"id long, leaf string, other string, subroot string, root string, proof {SEGMENTS}")

    # runs of leaves carry them along: they are dealt out once
    low, _ = stored(_runs(leaves.where("n > 1"), ["id", "other"]), "merkle-runs")
    lone = leaves.where("n = 1")
    levels = _upwards(low.drop("members"), -(-most // FAN)) if most > 1 else []
    subroots = lone.select("tree", "digest")
    for level in levels:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "digest"))
    subroots, _ = stored(subroots, "merkle-subroots")
    top_tree, tops = F.lit(-1).cast("long"), []
    if trees > 1:
        first, _ = stored(_runs(subroots.select(top_tree.alias("tree"), F.col("tree").alias("place"), F.lit(trees).alias("n"), "digest"), []), "merkle-top")
        tops = _upwards(first, -(-trees // FAN))
    root = (tops[-1] if tops else subroots).select("digest").first()[0].hex()

    # where a tree ends, its subroot goes on as a node of the top tree
    over = _node(top_tree, 1, F.floor(F.col("tree") / FAN)) if trees > 1 else F.lit(None).cast("string")
    place_over = (F.col("tree") % FAN).cast("int")
    held = None
    for level in [*levels, *tops]:
        inner = F.col("n") > 1
        above = F.when(inner, _node(F.col("tree"), F.col("level") + 1, F.floor(F.col("place") / FAN))).when(F.col("tree") >= 0, over)
        at = F.when(inner, (F.col("place") % FAN).cast("int")).when(F.col("tree") >= 0, place_over)
        part = level.select(_node(F.col("tree"), F.col("level"), F.col("place")).alias("node"), above.alias("above"), at.alias("at"), "run")
        held = part if held is None else held.unionByName(part)
    if held is not None:
        held, _ = stored(held, "merkle-nodes")
        held = _reached(held, _height(most) + _height(trees))

    # leaves take the segments of the node of their run; the subroot stands in the run of the first segment in the top tree
    def told(found: DataFrame, at: Column) -> DataFrame:
        proof = F.concat(F.array(F.struct("run", at.cast("int").alias("at"))), "segments")
        found = found.select("id", "digest", "other", "height", proof.alias("proof")).withColumn("s", F.get("proof", F.col("height")))
        subroot = F.lower(F.hex(F.substr("s.run", F.col("s.at") * DIGEST + 1, F.lit(DIGEST)))) if trees > 1 else F.lit(root)
        return found.select("id", _hex("digest").alias("leaf"), _hex(F.coalesce("other", "digest")).alias("other"), subroot.alias("subroot"), F.lit(root).alias("root"), "proof")

    if held is None:
        return lone.select("id", _hex("digest").alias("leaf"), _hex(F.coalesce("other", "digest")).alias("other"), _hex("digest").alias("subroot"), F.lit(root).alias("root"), F.array().cast(SEGMENTS).alias("proof"))
    height, bound = F.lit(1), 1
    for _ in range(_height(-(-most // FAN))):
        height, bound = height + (F.col("n") > bound).cast("int"), bound * FAN
    runs = low.select(_node(F.col("tree"), 1, F.col("place")).alias("node"), height.alias("height"), "members").join(held, "node")
    under = told(runs.withColumn("m", F.explode("members")).select("m.*", "height", "run", "segments"), F.col("at") % FAN)
    if trees == 1:
        return under
    apart = lone.withColumn("node", over).withColumn("height", F.lit(0)).join(held, "node")
    return under.unionByName(told(apart, place_over))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """proofs of docs with their digests: id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf where there is one), verified."""
    found = proofs(docs, tampered=tampered).withColumn("folded_root", fold(F.col("other"), F.col("proof")))
    return found.select("id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
