"""A Merkle manifest of a dataset, and inclusion proofs by Octopus multiproofs.

Rows are leaves of one tree for each key, ordered by id; nodes of ``FAN`` children are digests of their children's digests.
Leaves are dealt in partitions of ``BLOCK`` consecutive places, whole subtrees. Each leaf partition works out the least
union of coordinates of nodes that its proofs miss and that its own leaves do not give; the nodes are fetched once for the partition, by one
join; shared interiors are derived there, and each leaf's own proof is expanded from them. The roots of the trees are leaves of one more tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm._ranks import ranked
from foldline.llm._shared import written

FAN, LEVELS = 8, 4
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = ""  # the key of the tree over the trees' roots; keys of trees begin with 0 (null) or 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def row_digest(*values: Column) -> Column:
    """SHA-256 in hex of the values, each as its length in bytes, a colon and itself, or ``-`` where null."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*(one(v.cast("string")) for v in values)), 256)


def tree_key(key: Column) -> Column:
    """A string that is never null and sorts like ``key``, null first."""
    return F.coalesce(F.concat(F.lit("1"), key.cast("string")), F.lit("0"))


def _digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _width(n: int, level: int) -> int:
    """Nodes of a level of a tree with ``n`` leaves."""
    return -(-n // FAN**level)


def missing(places: Iterable[int], n: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes that proofs of the leaves at ``places`` need and that these leaves do not give: the least such set."""
    known, level, out = sorted(set(places)), 0, []
    while _width(n, level) > 1:
        width, parents, have = _width(n, level), sorted({p // FAN for p in known}), set(known)
        out += [(level, c) for p in parents for c in range(p * FAN, min((p + 1) * FAN, width)) if c not in have]
        known, level = parents, level + 1
    return out


def climb(nodes: dict[int, str], level: int, n: int, most: int, fetched: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """Levels of nodes above (and with) ``nodes`` of ``level``, up to ``most`` levels or the root; siblings come from ``fetched``."""
    out = [nodes]
    while most and _width(n, level) > 1:
        width, up = _width(n, level), {}
        for parent in sorted({p // FAN for p in nodes}):
            run = range(parent * FAN, min((parent + 1) * FAN, width))
            for c in run:
                if c not in nodes:
                    nodes[c] = fetched[level, c]
            up[parent] = _digest(nodes[c] for c in run)
        nodes, level, most = up, level + 1, most - 1
        out.append(nodes)
    return out


def _up(level: int):
    """The function that gives a block of nodes of ``level`` the next ``LEVELS`` levels."""

    def up(table: pa.Table) -> pa.Table:
        n, tree = table["n"][0].as_py(), table["tree"][0].as_py()
        found = climb(dict(zip(table["place"].to_pylist(), table["digest"].to_pylist(), strict=True)), level, n, LEVELS, {})
        rows = [(k, p, d) for k, nodes in enumerate(found, level) for p, d in nodes.items() if k > level or _width(n, k) == 1]
        return pa.table({
            "tree": pa.array([tree] * len(rows), pa.string()), "n": pa.array([n] * len(rows), pa.int64()), "level": pa.array([r[0] for r in rows], pa.int32()),
            "place": pa.array([r[1] for r in rows], pa.int64()), "digest": pa.array([r[2] for r in rows], pa.string()), "is_root": pa.array([_width(n, r[0]) == 1 for r in rows], pa.bool_()),
        })

    return up


def tree_nodes(leaves: DataFrame, name: str) -> DataFrame:
    """(tree, level, place, digest, is_root) of all nodes above the leaves, and of leaves that are roots; ``leaves`` has tree, pos, n, leaf.

    A round takes ``LEVELS`` levels, block by block; the rounds after the first look at a ``BLOCK``-th of the nodes each. No group has over ``BLOCK`` rows.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    done, level = [], 0
    base = leaves.select("tree", "n", F.col("pos").alias("place"), F.col("leaf").alias("digest"))
    while True:
        made = base.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("_block")).applyInArrow(_up(level), "tree string, n long, level int, place long, digest string, is_root boolean")
        done.append(written(made, f"{name}_{level}"))
        level += LEVELS
        if _width(most, level) <= 1:
            break
        base = done[-1].where((F.col("level") == level) & ~F.col("is_root")).select("tree", "n", "place", "digest")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("n")


_PROOF = "proof array<struct<before: string, after: string>>"


def expanded(leaves: DataFrame, nodes: DataFrame, *, whole: bool = False) -> DataFrame:
    """``leaves`` (tree, pos, n, leaf, and more) with ``proof``: for each level, the siblings' digests before and after the one on the path, joined.

    The leaves may be any of a tree's. ``nodes`` then has its leaves too, as level 0, unless ``whole`` says that all leaves of the trees are here. A pos that
    repeats gets its proof each time.
    """
    keyed = leaves.withColumn("_block", F.floor(F.col("pos") / BLOCK))

    def ask(table: pa.Table) -> pa.Table:
        need = missing(table["pos"].to_pylist(), table["n"][0].as_py()) or [(None, None)]
        tree, block = table["tree"][0].as_py(), table["_block"][0].as_py()
        return pa.table({
            "tree": pa.array([tree] * len(need), pa.string()), "_block": pa.array([block] * len(need), pa.int64()),
            "level": pa.array([x[0] for x in need], pa.int32()), "place": pa.array([x[1] for x in need], pa.int64()),
        })

    asked = keyed.select("tree", "_block", "pos", "n").groupBy("tree", "_block").applyInArrow(ask, "tree string, _block long, level int, place long")
    there = nodes.where(F.col("level") >= LEVELS) if whole else nodes  # whole blocks give all below
    fetched = written(asked, "asked").join(there.select("tree", "level", "place", "digest"), ["tree", "level", "place"])
    columns = keyed.columns

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], f.type) for f in left.schema] + [pa.array([], _TYPE)], names=[*columns, "proof"])
        n, at = left["n"][0].as_py(), left["pos"].to_pylist()
        have = {(k, p): d for k, p, d in zip(right["level"].to_pylist(), right["place"].to_pylist(), right["digest"].to_pylist(), strict=True)}
        levels = climb(dict(zip(at, left["leaf"].to_pylist(), strict=True)), 0, n, 64, have)
        joined: dict[tuple[int, int], tuple[str, str]] = {}
        before, after, ends = [], [], [0]
        for p in at:
            for level, found in enumerate(levels[:-1]):
                if (level, p) not in joined:
                    run = range(p - p % FAN, min(p - p % FAN + FAN, _width(n, level)))
                    joined[level, p] = "".join(found[c] for c in run if c < p), "".join(found[c] for c in run if c > p)
                x, y = joined[level, p]
                before.append(x)
                after.append(y)
                p //= FAN
            ends.append(len(before))
        pairs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        return left.append_column("proof", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)).select([*columns, "proof"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    return keyed.groupBy("tree", "_block").cogroup(fetched.groupBy("tree", "_block")).applyInArrow(expand, f"{schema}, {_PROOF}").drop("_block")


_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def manifest(docs: DataFrame, *, id_col: str = "doc_id", tree_col: str = "lang", columns: tuple[str, ...] = COLUMNS, also: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, nodes, trees) of a table.

    leaves: doc_id, tree, pos (place in its tree), n (leaves of the tree), leaf, and the columns of ``also``. nodes: tree, level (1 and up), place, digest, is_root. trees: tree,
    subroot, root, and top, the proof from subroot to root. Texts are hashed where they are read; only digests are dealt.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tree_key(F.col(tree_col)).alias("tree"), row_digest(*(F.col(c) for c in columns)).alias("leaf"), *[v.alias(k) for k, v in (also or {}).items()])
    placed, sizes = ranked(rows, "tree", [F.col("doc_id").asc_nulls_first(), "leaf"], "leaves")
    leaves = written(placed.join(sizes, "tree"), "manifest")
    nodes = tree_nodes(leaves, "nodes")
    subroots = nodes.where("is_root").select(F.lit(_TOP).alias("tree"), F.col("tree").alias("of"), F.col("digest").alias("leaf"))
    ordered, n = ranked(subroots, "tree", ["of"], "subroots")
    top = written(ordered.join(n, "tree"), "top")
    upper = tree_nodes(top, "upper")
    root = upper.where("is_root").select("tree", F.col("digest").alias("root"))
    trees = expanded(top, upper, whole=True).join(root, "tree").select(F.col("of").alias("tree"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("top"))
    return leaves, nodes, written(trees, "trees")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]), 256))


def prove(leaves: DataFrame, nodes: DataFrame, trees: DataFrame, *, wanted: DataFrame | None = None) -> DataFrame:
    """Inclusion proofs of the leaves of a manifest, or of those whose doc_id is in ``wanted``: the leaves' columns, subroot, root and proof (leaf to root).

    Proofs of any leaves take what they miss from nodes and leaves; those of all leaves need no leaf of another partition.
    """
    some = leaves if wanted is None else leaves.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select(*leaves.columns)
    ground = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("place"), F.col("leaf").alias("digest"))
    store = nodes.drop("is_root") if wanted is None else nodes.where("level > 0").drop("is_root").unionByName(ground)
    out = expanded(some, store, whole=wanted is None)
    return out.join(trees, "tree").withColumn("proof", F.concat("proof", "top")).drop("top")


def merkle_manifest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tree_col: str = "lang", tampered: Column | None = None) -> DataFrame:
    """Each row's leaf, subroot, root, proof, and folded_root and verified for the row as it is now.

    ``tampered`` is true for rows whose text has since become lower-case (A-Z); their folded_root comes from that row's digest and the original proof. One
    row for each row of ``docs``; null values are ``-`` in a leaf. Rows that repeat an id are leaves each, in the order of their digests; null ids come first. Null ``tree_col`` is a tree of its own.
    Very long texts are hashed where they are read. An empty table gives no rows. Other columns are not looked at.
    """
    now = [lower_ascii(F.col(c)) if c == text_col else F.col(c) for c in COLUMNS]
    changed = F.when(F.coalesce(tampered, F.lit(False)), row_digest(*now)) if tampered is not None else F.lit(None).cast("string")
    leaves, nodes, trees = manifest(docs, id_col=id_col, tree_col=tree_col, also={"changed": changed})
    out = prove(leaves, nodes, trees).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
