"""The prefix trie of conversations, by a van Emde Boas recursion.

Conversations are cut at half of the greatest depth. The prefixes at the cut are named: conversations with equal prefixes get
the least of their ids. That leaves an upper trie and a forest of lower ones, each of half the depth, which all recur at once:
a round cuts every piece of one size in half, and a prefix is named by its piece's root and its half of turns alone, so that no
round looks at more than each turn once, and rounds grow with the logarithm of the depth. On the way back, totals of
the lower tries are grafted onto the nodes of the upper ones. No conversation and no node is ever one row or one group:
a prefix that all conversations share costs one row for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm._ranks import ranked
from foldline.llm._shared import shuffle_partitions, written

ENDS_CHUNK = 8192
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def turn_rows(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns as (conv_id, pos, digest, n_bytes), conversations as (conv_id, n)).

    ``digest`` is 128 bits of the SHA-256 of role and text, null ones as empty; texts travel no further. Turns are in the order of their
    number, null first, those of one number by digest. Rows without an id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("_turn"),
        F.substring(F.unhex(F.sha2(F.concat(_bytes(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("digest"), _bytes(text).alias("n_bytes"),
    )
    placed, sizes = ranked(rows, "conv_id", [F.col("_turn").asc_nulls_first(), "digest"], "turns")
    return placed.drop("_turn"), written(sizes, "conversations")


def rebuilt(turns: DataFrame, convs: DataFrame, *, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversation c as the first h turns of c - c % ``every`` and its own turns after its first h; h is crc32(c) % ``most``.

    Returns turns and sizes like ``turn_rows``; a conversation without turns has a size of 0.
    """
    h = lambda c: F.crc32(c.cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    sized = convs.withColumn("_base", base).join(convs.select(F.col("conv_id").alias("_base"), F.col("n").alias("_given")), "_base", "left")
    plan = written(sized.select("conv_id", "n", h(F.col("conv_id")).alias("h"), F.coalesce("_given", F.lit(0).cast("long")).alias("given")).withColumn("given", F.least("h", "given")), "plan")
    own = turns.join(plan, "conv_id").where("pos >= h").select("conv_id", (F.col("given") + F.col("pos") - F.col("h")).alias("pos"), "digest", "n_bytes")
    to = F.filter(F.transform(F.sequence(F.lit(1 - every), F.lit(every - 1)), lambda k: F.col("conv_id") + k), lambda c: c - c % every == F.col("conv_id"))
    given = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).select(F.explode(to).alias("_to"), "pos", "digest", "n_bytes")
    given = given.where(F.col("pos") < h(F.col("_to"))).withColumnRenamed("_to", "conv_id").join(plan.select("conv_id"), "conv_id")
    sizes = plan.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return own.unionByName(given.select("conv_id", "pos", "digest", "n_bytes")), sizes


def _named(turns: DataFrame, root: int, span: int) -> tuple[DataFrame, DataFrame]:
    """(prefixes as (conv_id, depth, name), nodes as (conv_id, depth, n_convs, last_bytes)) below the root; ``span`` is a power of two over all depths."""
    turns = written(turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_bytes", F.xxhash64("pos", "digest").alias("g"), F.xxhash64(F.lit(1), "pos", "digest").alias("h")), "rebuilt")
    roots, nodes, size = [], [], span
    while size > 1:
        half = size // 2
        piece = F.floor((F.col("depth") - 1) / size).cast("long")
        upper = turns.where((F.col("depth") - 1) % size < half).groupBy("conv_id", piece.alias("piece"))
        # digests are hashed with their places, so the sum without carry of a half's hashes tells the sequences of a half apart
        halves = upper.agg(F.bit_xor("g").alias("g"), F.bit_xor("h").alias("h"), F.count(F.lit(1)).alias("held"), F.max_by("n_bytes", "depth").alias("last_bytes"))
        halves = halves.where(F.col("held") == half).select("conv_id", (F.col("piece") * size).alias("_from"), "g", "h", "last_bytes")
        first = halves.where("_from = 0").withColumn("root", F.lit(root).cast("long"))
        if roots:
            above = _union(roots).select("conv_id", F.col("depth").alias("_from"), F.col("name").alias("root")).where(F.col("_from") % size == 0)
            first = first.unionByName(halves.where("_from > 0").join(above, ["conv_id", "_from"]))
        cut = written(first.withColumn("depth", F.col("_from") + half).drop("_from"), f"cut_{half}")
        key = ["depth", "root", "g", "h"]
        groups = written(cut.groupBy(*key).agg(F.min("conv_id").alias("name"), F.count(F.lit(1)).alias("n_convs"), F.max("last_bytes").alias("last_bytes")), f"names_{half}")
        shared = groups.where("n_convs > 1").select(*key, "name")
        roots.append(written(cut.join(shared, key, "left").select("conv_id", "depth", F.coalesce("name", "conv_id").alias("name")), f"prefixes_{half}"))
        nodes.append(groups.select(F.col("name").alias("conv_id"), "depth", "n_convs", "last_bytes"))
        size = half
    return _union(roots), _union(nodes)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _grafted(own: DataFrame, prefixes: DataFrame, root: int, span: int) -> DataFrame:
    """``own`` as (conv_id, depth, n_leaves, saved) summed over subtrees: pieces double, and each round grafts the totals of lower pieces onto the upper nodes above them."""
    size = 2
    while size <= span:
        half = size // 2
        piece = F.floor(F.col("depth") / size).cast("long").alias("piece")
        lower = own.where(F.col("depth") % size == half).select("conv_id", piece, "n_leaves", "saved")
        above = prefixes.where(F.col("depth") % size < half).select("conv_id", piece, "depth", "name").join(lower, ["conv_id", "piece"])
        top = lower.where("piece = 0").select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "n_leaves", "saved")
        more = above.select(F.col("name").alias("conv_id"), "depth", "n_leaves", "saved").unionByName(top)
        own = written(own.unionByName(more).groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")), f"totals_{size}")
        size *= 2
    return own


def _ends(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (conv_id, depth, end): the digest of the joined ids of each node's ends, ascending.

    Ids are dealt by range, so that a node's ends fill many tasks, each of which joins them to chunks; one task then reads a node's chunks as a stream, holding one
    at a time. (SHA-256 has to see its input in order.)
    """
    spark = members.sparkSession
    parts = shuffle_partitions(spark)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, end = (batch.column(k).to_numpy() for k in range(3))
            cut = np.flatnonzero((np.diff(conv, prepend=conv[:1] - 1) != 0) | (np.diff(depth, prepend=depth[:1] - 1) != 0) | (np.arange(len(conv)) % ENDS_CHUNK == 0))
            joined = [",".join(map(str, x.tolist())) for x in np.split(end, cut[1:])] if len(conv) else []
            yield pa.RecordBatch.from_arrays([pa.array(x[cut], pa.int64()) for x in (conv, depth, end)] + [pa.array(joined, pa.string())], names=["conv_id", "depth", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            out = []
            for key, ids in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(3).to_pylist(), strict=True):
                if key == at:
                    sha.update(b",")
                else:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            yield _row(out)
        if at is not None:
            yield _row([(*at, sha.hexdigest())])

    def _row(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])

    dealt = members.repartitionByRange(parts, "conv_id", "depth", "end").sortWithinPartitions("conv_id", "depth", "end")
    joined = written(dealt.mapInArrow(chunks, "conv_id long, depth long, first long, ids string"), "ends")
    return joined.repartition(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns (``turns`` and ``convs`` as from ``turn_rows``), from the empty one on: conv_id (least member), depth, parent_conv_id,
    n_convs (members), n_children, n_leaves and saved_tokens of the subtree, and ends_sha256 of the members that end there.

    Turns are equal where 128 bits of SHA-256 are; sequences are compared by 128 bits of hashes. Conversations without turns are members of
    the root alone. Without conversations there are no nodes. Rounds grow with the logarithm of the longest conversation.
    """
    spark = convs.sparkSession
    convs = written(convs, "sizes")
    root, longest, total = convs.agg(F.min("conv_id"), F.max("n"), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], NODE)
    span = 1 << int(longest).bit_length()
    top = spark.range(1).select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(total).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("last_bytes"))
    if longest == 0:
        prefixes, nodes = spark.createDataFrame([], "conv_id long, depth long, name long"), top
    else:
        prefixes, below = _named(turns, root, span)
        nodes = below.unionByName(top)
    above = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent_conv_id"))
    first = F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("parent_conv_id"))
    linked = written(nodes.join(above, ["conv_id", "depth"], "left").withColumn("parent_conv_id", first), "nodes")
    children = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    linked = written(linked.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"]), "linked")
    own = linked.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("last_bytes")).alias("saved"))
    totals = _grafted(own, prefixes, root, span)
    ended = convs.where("n > 0").select("conv_id", F.col("n").alias("depth")).join(prefixes, ["conv_id", "depth"]).select(F.col("name"), "depth", F.col("conv_id").alias("end"))
    ended = ended.unionByName(convs.where("n = 0").select(F.lit(root).cast("long").alias("name"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("end")))
    out = linked.join(totals, ["conv_id", "depth"]).join(_ends(ended.withColumnRenamed("name", "conv_id")), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, *, every: int = 5, most: int = 9, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The prefix trie of the rebuilt conversations (see ``rebuilt`` and ``prefix_trie``).

    Null roles and texts are empty; rows without an id belong to no conversation; a null turn comes first; rows that repeat a turn
    are turns each, in the order of their digests. Very long texts are hashed where they are read. Other columns are not looked at. An empty table
    gives no nodes.
    """
    turns, convs = turn_rows(conversations, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    return prefix_trie(*rebuilt(turns, convs, every=every, most=most))
