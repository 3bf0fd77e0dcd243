"""The trie of conversation prefixes, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Every turn at its depth gives four 32-bit hashes;
their running sums along a conversation, taken in chunks, name all its prefixes by 128 bits, so no
conversation has to fit a task. A node is known by its smallest member and its depth.

Totals over subtrees come from contracting the tree. Rake: childless nodes give their total to the
parent and go. Compress: a node with one remaining child goes when its coin shows heads and its
parent's tails; what it held moves onto the edge above the child. Both are joins on node ids, in
rounds that remove a constant share of the nodes, so the rounds grow with the logarithm of the
tree. Before them, unary runs owned by one conversation are compressed at once in spans of depths.
Then the rounds are gone through backwards: a compressed node's total is what it held, the edge
below it and the total of its child.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import prefix
from ..operators.materialize import materialize

GROUP, HEADS = 100, 6
# Depths of a conversation that are worked on together; ids joined to one piece of text.
SPAN, IDS = 1024, 4096
_LOW = (1 << 32) - 1


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): turns numbered from 1 along a conversation, null turns first.

    Turns that tie, or repeat, are put in the order of the SHA-256 of length of role, role and
    text. Null roles and texts are empty. Rows without a conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    order = ["turn", "digest"]
    numbered = prefix.running_sum(
        prefix.ranged(turns, "conv_id", *order), ["conv_id"], F.col("_range"), order, {"pos": F.lit(1).cast("long")})
    return numbered.select("conv_id", "pos", "digest", "chars")


def whole(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, chars, ends) of conversations as they are, with a row of depth 0 each."""
    return _with_roots(
        turns := materialize(placed(conversations), "turns"),
        turns.groupBy("conv_id").agg(F.max("pos").alias("last")), F.col("pos"))


def _with_roots(turns: DataFrame, convs: DataFrame, depth: Column) -> DataFrame:
    rows = turns.join(convs, "conv_id").select(
        "conv_id", depth.alias("depth"), "digest", "chars", (depth == F.col("last")).alias("ends"))
    return rows.union(convs.select(
        "conv_id", F.lit(0).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long"), F.col("last") == 0))


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Like ``whole``, with every conversation's head taken from the first of its group.

    Conversation c begins with the first h turns of conversation c - c % ``group`` (all if fewer,
    none if absent) and goes on with its own turns after its first h; h = crc32(c) % ``heads``.
    """
    turns = materialize(placed(conversations), "turns")
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % heads)
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select(
        "conv_id", "own", h.alias("h"), (c - c % group).alias("first"))
    sizes = convs.where("conv_id = first").select("first", F.col("own").alias("there"))
    convs = materialize(convs.join(sizes, "first", "left").select(
        "conv_id", "first", "h", "own", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")).withColumn(
        "last", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "convs")
    # At most ``heads - 1`` rows for each of at most ``group`` conversations.
    lent = turns.where((c % group == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "first")
    head = convs.where("taken > 0").join(lent, "first").where("pos <= taken").select(
        "conv_id", F.col("pos").alias("depth"), "digest", "chars", (F.col("pos") == F.col("last")).alias("ends"))
    tail = _with_roots(
        turns.where(F.col("pos") > h), convs.select("conv_id", "h", "taken", "last"),
        F.col("pos") - F.col("h") + F.col("taken"))
    return head.union(tail)


def _named(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, ka, kb, pa, pb, chars, ends): names of the prefix and of the one before it."""
    x, y = (F.xxhash64(F.lit(i), "depth", "digest") for i in (1, 2))
    below = F.col("depth") > 0
    parts = {f"s{i}": F.when(below, v).otherwise(F.lit(0)) for i, v in enumerate(
        (x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32), y.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(y, 32)))}
    held = turns.select("*", *[v.alias(f"x{n[1]}") for n, v in parts.items()])
    summed = prefix.running_sum(
        held, ["conv_id"], F.floor(F.col("depth") / SPAN), ["depth"], {n: F.col(f"x{n[1]}") for n in parts})

    def name(a: Column, b: Column) -> Column:
        return F.shiftleft(a.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(b.bitwiseAND(F.lit(_LOW)))

    s, p = [F.col(f"s{i}") for i in range(4)], [F.col(f"s{i}") - F.col(f"x{i}") for i in range(4)]
    return summed.select(
        "conv_id", "depth", name(s[0], s[1]).alias("ka"), name(s[2], s[3]).alias("kb"),
        name(p[0], p[1]).alias("pa"), name(p[2], p[3]).alias("pb"), "chars", "ends")


def ordered_digests(members: DataFrame, by: list[str], member: str) -> DataFrame:
    """(by..., digest): SHA-256 of each group's decimal members, ascending and joined by commas.

    Ranges of the sorted rows are first joined to pieces of bounded length; the pieces of a group
    then stream through one hash in order, so a group of any size needs no memory.
    """
    schema = members.select(*by, member).schema
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)

    def keys(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*[c.to_pylist() for c in batch.columns[:len(by)]])

    def table(out: list[tuple], like: pa.Schema, last: str) -> pa.RecordBatch:
        own = [*list(like)[:len(out[0]) - 1], pa.field(last, pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), own)], schema=pa.schema(own))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, like = None, [], None
        for batch in batches:
            out, like = [], batch.schema
            for k, m in zip(keys(batch), batch.column(len(by)).to_pylist()):
                if held and (k != key or len(held) == IDS):
                    out.append((*key, held[0], ",".join(map(str, held))))
                    held = []
                key = k
                held.append(m)
            if out:
                yield table(out, like, "piece")
        if held:
            yield table([(*key, held[0], ",".join(map(str, held)))], like, "piece")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, like = None, None, None
        for batch in batches:
            out, like = [], batch.schema
            for k, text in zip(keys(batch), batch.column(len(by) + 1).to_pylist()):
                if digest is not None and k == key:
                    digest.update(b",")
                else:
                    if digest is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                digest.update(text.encode())
            if out:
                yield table(out, like, "digest")
        if digest is not None:
            yield table([(*key, digest.hexdigest())], like, "digest")

    order = [*by, member]
    joined = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pieces, f"{kinds}, piece string")
    return joined.repartition(*by).sortWithinPartitions(*order).mapInArrow(
        hashed, ", ".join([*[k for k in kinds.split(", ")[:len(by)]], "digest string"]))


def _coin(round_no: int, *node: str) -> Column:
    """Heads (1) or tails (0) of a node in a round; the root always has tails."""
    return F.when(F.col(node[1]) == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(round_no), *node), F.lit(2)))


def subtree_totals(nodes: DataFrame, weights: list[str], span: int = SPAN, limit: int = 400) -> DataFrame:
    """(conv_id, depth, total_<weight>...): sums of ``weights`` over the subtree of every node.

    ``nodes`` has conv_id and depth (together unique), parent_conv_id, n_children and the weights.
    Parents lie one depth above, the root has depth 0; the nodes of a conv_id are a path downwards.
    """
    own, edge = [f"own_{w}" for w in weights], [f"edge_{w}" for w in weights]
    # Runs of a path inside a span of depths: (u, w, held) for every node u that goes.
    path = Window.partitionBy("conv_id", "_span").orderBy(F.desc("depth"))
    run = Window.partitionBy("conv_id", "_span", "_stop").orderBy(F.desc("depth"))
    goes = (F.col("n_children") == 1) & (F.col("depth") > 0) & F.lag("depth").over(path).isNotNull()
    runs = materialize(
        nodes.select(
            "conv_id", "depth", F.col("parent_conv_id").alias("up_conv_id"), "n_children",
            *[F.col(w).cast("long").alias(o) for w, o in zip(weights, own)],
            F.floor(F.col("depth") / span).alias("_span"))
        .withColumn("_goes", goes)
        .withColumn("_stop", F.last(F.when(~F.col("_goes"), F.col("depth")), True).over(prefix.so_far(path)))
        .withColumns({f"held_{o}": F.sum(F.when(F.col("_goes"), F.col(o)).otherwise(F.lit(0))).over(
            prefix.so_far(run)) for o in own}), "runs")
    state = materialize(
        runs.groupBy("conv_id", "_span", F.col("_stop").alias("depth")).agg(
            F.min_by("up_conv_id", "depth").alias("up_conv_id"), (F.min("depth") - 1).alias("up_depth"),
            F.max_by("n_children", "depth").cast("long").alias("kids"),
            *[F.max_by(o, "depth").alias(o) for o in own],
            *[F.max(f"held_{o}").alias(e) for o, e in zip(own, edge)]).drop("_span"), "tree")
    ids, up = ["conv_id", "depth"], ["up_conv_id", "up_depth"]
    gone = [runs.where("_goes").select(
        *ids, F.col("conv_id").alias("at_conv_id"), F.col("_stop").alias("at_depth"),
        *[F.col(f"held_{o}").alias(o) for o in own])]
    raked = []
    for number in range(limit):
        leaves = state.where("kids = 0")
        raked.append(leaves.select(*ids, *own))
        if not state.where("kids > 0").limit(1).count():
            break
        given = leaves.where("depth > 0").groupBy(*up).agg(
            F.count("*").alias("_n"), *[F.sum(F.col(o) + F.col(e)).alias(f"_{o}") for o, e in zip(own, edge)]
        ).toDF(*ids, "_n", *[f"_{o}" for o in own])
        left = state.where("kids > 0").join(given, ids, "left").select(
            *ids, *up, (F.col("kids") - F.coalesce("_n", F.lit(0))).alias("kids"),
            *[(F.col(o) + F.coalesce(f"_{o}", F.lit(0))).alias(o) for o in own], *edge)
        left = materialize(left, "raked")
        heads = (F.col("kids") == 1) & (_coin(number, *ids) == 1) & (_coin(number, *up) == 0)
        chosen = left.where(heads).select(*[F.col(c).alias(f"_{c}") for c in [*ids, *up, *own, *edge]])
        rest = left.where(~heads)
        # Children of tails, the root's among them, need not be looked up.
        under = _coin(number, *up) == 1
        asks = rest.where(under)
        met = (asks["up_conv_id"] == chosen["_conv_id"]) & (asks["up_depth"] == chosen["_depth"])
        joined = materialize(asks.join(chosen, met, "left").unionByName(
            rest.where(~under), allowMissingColumns=True), "compressed")
        there = F.col("_conv_id").isNotNull()
        state = joined.select(
            *ids, *[F.when(there, F.col(f"_{u}")).otherwise(F.col(u)).alias(u) for u in up], "kids", *own,
            *[F.when(there, F.col(e) + F.col(f"_{o}") + F.col(f"_{e}")).otherwise(F.col(e)).alias(e)
              for o, e in zip(own, edge)])
        gone.append(joined.where(there).select(
            F.col("_conv_id").alias("conv_id"), F.col("_depth").alias("depth"),
            F.col("conv_id").alias("at_conv_id"), F.col("depth").alias("at_depth"),
            *[(F.col(f"_{o}") + F.col(e)).alias(o) for o, e in zip(own, edge)]))
    else:
        raise RuntimeError(f"the tree was not contracted in {limit} rounds")
    # Backwards: what is known after a round tells the nodes that the round compressed.
    known = raked.pop()
    for events in reversed(gone):
        below = known.select(*[F.col(c).alias(f"at_{c}") for c in ids], *[F.col(o).alias(f"_{o}") for o in own])
        told = events.join(below, ["at_conv_id", "at_depth"]).select(
            *ids, *[(F.col(o) + F.col(f"_{o}")).alias(o) for o in own])
        known = known.union(told)
        known = materialize(known.union(raked.pop()) if raked else known, "totals")
    return known.toDF(*ids, *[f"total_{w}" for w in weights])


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of ``turns`` (see ``whole``).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the
    smallest member, the node's depth, the parent's smallest member (null for the root), members,
    children, childless nodes of the subtree, (n_convs - 1) x characters of the last text summed
    over the subtree, and the digest of the members that end here. No conversations: no rows.
    """
    key = ["depth", "ka", "kb"]
    steps = materialize(_named(turns), "steps")
    nodes = materialize(steps.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb")), "nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    ended = ordered_digests(steps.where("ends"), key, "conv_id")
    # The root's many children are told their parent without a join.
    root = nodes.where("depth = 0").select("conv_id").first()
    parents = nodes.select("depth", "ka", "kb", F.col("conv_id").alias("parent_conv_id"))
    full = (
        nodes.join(children, key, "left").join(ended, key, "left")
        .select("conv_id", F.col("depth").alias("own_depth"), "n_convs", "chars",
                F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"), *above))
    full = full.where("own_depth > 1").join(parents, key).unionByName(full.where("own_depth <= 1").withColumn(
        "parent_conv_id", F.when(F.col("own_depth") == 1, F.lit(root["conv_id"] if root else None)).cast("long")))
    tree = materialize(full.select(
        "conv_id", F.col("own_depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "ends_sha256",
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "tree")
    totals = subtree_totals(tree, ["leaf", "saved"])
    return tree.join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("total_leaf").alias("n_leaves"), F.col("total_saved").alias("saved_tokens"), "ends_sha256")
