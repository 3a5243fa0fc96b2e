"""Trie of conversation prefixes, by smallest-member ownership.

A conversation is a path from the root, one node for each of its first d turns; equal
prefixes are one node. Nodes are found by key: the exclusive or of 128-bit hashes of (place,
role, text) over the prefix, so that a running window gives all keys of a path and a node's
key gives its parent's. Long conversations are cut into blocks of BLOCK turns, whose totals
are carried on, so no window holds more than a block.

A node is owned by its smallest member. Along a path the smallest member can only grow, so
what a conversation owns is a suffix of its path, and one number (the depth from which on it
owns) marks it. All that a node sums over its subtree is then a sum over its members, each
with what stands in its own row: a conversation adds its tokens from the node on, less those
of the nodes that it owns itself; it adds one leaf if it owns the node that it ends in and
nobody goes on there; it adds one child if it owns its next node. So one group-by of prefixes,
which sums on the map side, gives members, children, leaves and saved tokens, and a prefix
that all conversations share is never gathered.

Defined results: a null role or text is empty; turns are ordered by turn (null first), then
by role and by the hash of the text; equal rows are turns of their own; rows with a null
conversation id belong to no conversation; conversations without turns are members of the
root only; an empty table has no nodes. Other columns play no part.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked
from .workspace import Workspace

BLOCK = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def turns_in_order(conversations: DataFrame, work: Workspace) -> DataFrame:
    """conv_id, place (from 0), role and the text's hash and words, of each turn with a conversation."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(text).alias("digest"), word_count(text).cast("long").alias("words"))
    return work.keep(ranked(work.keep(rows), "conv_id", ["turn", "role", "digest"], work, "place").drop("turn"))


def rebuilt(turns: DataFrame, base: Column, heads: Column, most: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first heads turns are those of conversation base (of conv_id; most at most), followed by their own after as many: (conv_id, n_turns) and (conv_id, depth from 1, role, digest, words)."""
    sizes = turns.groupBy("conv_id").agg((F.max("place") + 1).alias("n"))
    each = work.keep(sizes.select("conv_id", "n", base.cast("long").alias("base"), heads.cast("long").alias("h")))
    donors = each.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    each = work.keep(each.join(donors, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("g"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own")))
    given = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "base").join(each, "base").where("place < g").select("conv_id", (F.col("place") + 1).alias("depth"), "role", "digest", "words")
    own = turns.join(each, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("g") + 1).alias("depth"), "role", "digest", "words")
    return each.select("conv_id", (F.col("g") + F.col("own")).alias("n_turns")), given.unionByName(own)


def occurrences(lengths: DataFrame, turns: DataFrame, work: Workspace, block: int = BLOCK) -> DataFrame:
    """Each conversation's nodes: conv_id, n_turns, depth, key (k1, k2) and parent's key (p1, p2), tokens of its last turn, before (tokens of the turns above)."""
    last = F.concat_ws("/", F.col("depth").cast("string"), F.length("role").cast("string"), F.col("role"), F.col("digest"))
    rows = turns.select("conv_id", "depth", "words", F.floor((F.col("depth") - 1) / block).alias("block"), F.xxhash64(F.lit(1), last).alias("h1"), F.xxhash64(F.md5(last), F.lit(2)).alias("h2"))
    run = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = work.keep(rows.select("conv_id", "depth", "block", "words", "h1", "h2", F.bit_xor("h1").over(run).alias("r1"), F.bit_xor("h2").over(run).alias("r2"), F.sum("words").over(run).alias("upto")))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.sum("words").alias("b"))
    nothing = F.lit(0).cast("long")
    carry = totals.select("conv_id", "block", F.coalesce(F.bit_xor("b1").over(earlier), nothing).alias("c1"), F.coalesce(F.bit_xor("b2").over(earlier), nothing).alias("c2"), F.coalesce(F.sum("b").over(earlier), nothing).alias("c"))
    whole = rows.join(carry, ["conv_id", "block"]).join(lengths, "conv_id")
    k1, k2 = F.col("r1").bitwiseXOR(F.col("c1")), F.col("r2").bitwiseXOR(F.col("c2"))
    below = whole.select("conv_id", "n_turns", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("h1")).alias("p1"), k2.bitwiseXOR(F.col("h2")).alias("p2"), F.col("words").alias("tokens"), (F.col("upto") - F.col("words") + F.col("c")).alias("before"))
    root = lengths.select("conv_id", "n_turns", nothing.alias("depth"), *[nothing.alias(c) for c in ("k1", "k2")], *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], nothing.alias("tokens"), nothing.alias("before"))
    return work.keep(root.unionByName(below))


def _streamed_hash(batches):
    """SHA-256 of the ids of each key, from rows sorted by key and id; nothing but the running hash is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for *now, member in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            if now != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(str(member).encode())
            else:
                state.update(b",%d" % member)
        if out:
            yield _hash_rows(out)
    if key is not None:
        yield _hash_rows([(*key, state.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], names=["depth", "k1", "k2", "ends_sha256"])


def trie(lengths: DataFrame, turns: DataFrame, work: Workspace, block: int = BLOCK) -> DataFrame:
    """The nodes of conversations given as (conv_id, n_turns) and (conv_id, depth, role, digest, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    seen = occurrences(lengths, turns, work, block)
    key = ["depth", "k1", "k2"]
    owners = work.keep(seen.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("deepest"), F.min("p1").alias("p1"), F.min("p2").alias("p2")))
    # What a conversation owns: from which depth on, and whether that ends in a leaf.
    owned = owners.groupBy("conv_id").agg(F.min("depth").alias("from"), F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"))
    marked = seen.join(owned, "conv_id", "left").withColumns({"from": F.coalesce("from", F.col("n_turns") + 1), "leaf": F.coalesce("leaf", F.lit(0).cast("long"))})
    not_owned = marked.where(F.col("depth") < F.col("from")).groupBy("conv_id").agg(F.max(F.col("before") + F.col("tokens")).alias("shared"))
    marked = marked.join(not_owned, "conv_id", "left")
    child = (F.col("depth") < F.col("n_turns")) & (F.col("depth") + 1 >= F.col("from"))
    nodes = marked.groupBy(*key).agg(
        F.count("*").alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.coalesce("shared", F.lit(0)) - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    ends = seen.where("depth = n_turns").select(*key, "conv_id")
    hashes = ends.repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(_streamed_hash, "depth long, k1 long, k2 long, ends_sha256 string")
    parents = owners.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = owners.select(*key, "conv_id", "p1", "p2").join(parents, ["depth", "p1", "p2"], "left")
    return named.join(nodes, key).join(hashes, key, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
