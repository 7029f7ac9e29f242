"""MinHash near-dedup with fast similarity sketches.

A sketch has ``bands * rows`` coordinates. In round i each shingle is hashed to one bin with a value in
[i, i + 1); after as many rounds as bins, further rounds give every shingle to one fixed bin, so each
bin is filled within twice that number of rounds, and the share of equal bins keeps the concentration bounds of
independent hashing. Equal texts and sets are one class before banding. Documents that share a band are
first compared with one hub of the band, the member that meets the most others in all its bands. What is still apart in
a band is then searched exactly, without pairs of all members: each set is written as its difference from a
centre, the shingles that most members of the group hold. Pages of one template differ from it in what is their own, which nobody else has; two
that are similar share some of their differences, and a prefix filter, rarest shingles first, finds them. Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldline.llm import _packs as P
from foldline.llm._shared import in_files, small_batches, written

#: Elements before one that are kept beside it, to report a pair at the first that it shares; a pair reported twice is only work.
_BEFORE = 8
#: Members of a group, about, whose elements make its centre.
_PICKED = 128
_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after the other, and their number; case of A-Z is ignored."""
    words = P.Words(texts, lower=True)
    h, valid = words.windows(k)
    doc = words.doc[: len(h)][valid]
    h = h[valid]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        mult = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(1, k + 1)], np.uint64)
        at = np.flatnonzero(np.isin(words.doc, short))
        whole = np.zeros(len(texts), np.uint64)
        np.add.at(whole, words.doc[at], words.hash[at] * mult[words.pos[at]])
        h, doc = np.concatenate([h, P.mix(whole[short] ^ words.count[short].astype(np.uint64))]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts))


def sketches(h: np.ndarray, count: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketches: for each set with elements, ``bins`` values (round << 48 | hash); empty sets keep the maximum."""
    top = np.uint64((1 << 64) - 1)
    out = np.full(len(count) * bins, top, np.uint64)
    doc = np.repeat(np.arange(len(count)), count)
    open_ = np.ones(len(doc), bool)
    for i in range(2 * bins):
        x, d = h[open_], doc[open_]
        if not len(x):
            break
        v = P.mix(x ^ P.mix(np.array([i + 1], np.uint64)))
        b = (v % np.uint64(bins)).astype(np.int64) if i < bins else np.full(len(x), i - bins)
        np.minimum.at(out, d * bins + b, np.uint64(i << 48) | (v >> np.uint64(16)))
        full = (out.reshape(-1, bins) != top).all(axis=1)
        open_ = ~full[doc]
    return out.reshape(-1, bins)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each input row: set size, 128-bit signature of the set, band hashes, and a byte for each sketch coordinate."""
    small_batches(docs.sparkSession)
    bins = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, at = P.as_bytes(batch.column("text")), batch.column("doc_id"), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
                    size, to = size + len(texts[to]), to + 1
                h, count = shingle_sets(texts[at:to], shingle)
                first = np.concatenate([[0], np.cumsum(count)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(P.mix(h ^ np.uint64(salt)))]) for salt in (1, 2)]
                a, b = (s[first[1:]] - s[first[:-1]] for s in sums)
                sk = sketches(h, count, bins)
                step = P.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
                band = P.mix((sk.reshape(-1, bands, rows) * step).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                byte = (P.mix(sk.ravel()) >> np.uint64(56)).astype(np.uint8).reshape(-1, bins)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(at, to - at), "n_shingles": pa.array(count, pa.int64()), "set_a": pa.array(a.view(np.int64)), "set_b": pa.array(b.view(np.int64)),
                    "bands": pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1) * bands, pa.int32()), pa.array(band.ravel().view(np.int64))),
                    "sketch": pa.array([x.tobytes() for x in byte], pa.binary()),
                })
                at = to

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def _full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, set): the sorted shingle hashes of each row of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = P.as_bytes(batch.column("text")), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
                    size, to = size + len(texts[to]), to + 1
                h, count = shingle_sets(texts[at:to], shingle)
                sets = np.split(h, np.cumsum(count)[:-1])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, to - at), "set": pa.array([x.tobytes() for x in sets], pa.binary())})
                at = to

    return docs.mapInArrow(run, "doc_id long, set binary")


def _similar(pairs: DataFrame, percent: int, column: str, exact: bool) -> DataFrame:
    """Pairs (a, b) whose sets (``exact``) reach the similarity, or whose sketches are not clearly below it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(f"{column}_a").to_pylist(), batch.column(f"{column}_b").to_pylist(), strict=True):
                if exact:
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(100 * both >= percent * (len(p) + len(q) - both))
                else:
                    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                    s = percent / 100
                    ok.append((p == q).mean() >= s - 6 * (s * (1 - s) / len(p)) ** 0.5)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _table(df: DataFrame, name: str, files: int) -> DataFrame:
    return written(in_files(df, files), name)


def components(nodes: DataFrame, edges: DataFrame, files: int) -> DataFrame:
    """(node, label): the smallest node that each of ``nodes`` (node, label) reaches over ``edges`` (a, b) between labels.

    Rounds of taking the least label of neighbours and of labels, each written to the shared folder.
    """
    links = _table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", files)
    while True:
        by = nodes.select(F.col("node").alias("a"), F.col("label").alias("la"))
        far = nodes.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        low = links.join(by, "a").join(far, "b").where("lb < la").groupBy(F.col("la").alias("label")).agg(F.min("lb").alias("low"))
        low = _table(low, "labels", files)
        if low.isEmpty():
            return nodes
        for _ in range(8):
            up = low.select(F.col("label").alias("low"), F.col("low").alias("next"))
            jumped = _table(low.join(up, "low", "left").select("label", F.coalesce("next", "low").alias("low"), F.col("next").isNotNull().alias("moved")), "labels", files)
            low = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        nodes = _table(nodes.join(low, "label", "left").select("node", F.coalesce("low", "label").alias("label")), "components", files)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 85, bands: int = 20, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected components of documents with 100 * |intersection| >= ``percent`` * |union| of shingle sets; one row for each input row.

    Returns doc_id, n_shingles and component_id (smallest id reachable). Texts with fewer words than ``shingle`` have
    one shingle, the whole; null texts and texts without words have none and are linked with nothing.
    A pair of that similarity shares no band with probability (1 - (percent / 100) ** rows) ** bands, below
    0.00001 as preset; found links are confirmed on full sets. A row with a null id gets the component of the rows with
    ids that have the same set, else null. Rows that repeat an id are one node, with the links of all its texts. An empty table
    gives no rows. A very long text costs its shingles once for each stage; only ids, sketches and sets are shuffled, never
    texts. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    files = P.table_files(docs)
    sig = written(signatures(docs, shingle, bands, rows, "doc_id", "text"), "signatures")
    some = sig.where("n_shingles > 0")
    named = some.where("doc_id IS NOT NULL")
    reps = _table(named.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("set_a", "set_b", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands")), "reps", files)
    members = _members(reps, files)
    nodes = _table(members.select(F.col("rep").alias("node"), F.col("rep").alias("label")).distinct(), "components", files)
    known = _table(_of(named, nodes).select("doc_id", "sketch"), "sketches", files)
    sets = written(_full_sets(_of(docs, nodes), shingle), "sets")
    for step in (_hub_pairs(members, files), None):
        pairs = _table(step if step is not None else _prefix_pairs(members, nodes, sets, percent, files), "pairs", files)
        close = _table(_similar(_with_sides(pairs, known, "sketch"), percent, "sketch", False), "close", files)
        nodes = components(nodes, _table(_similar(_with_sides(close, sets, "set"), percent, "set", True), "links", files), files)
    classes = reps.join(nodes, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("label", "rep").alias("component_id"))
    found = some.select("doc_id", "n_shingles", "set_a", "set_b").join(_table(classes, "classes", files), ["set_a", "set_b"], "left").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose doc_id is a node."""
    return rows.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")


def _with_sides(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    left = values.select(F.col("doc_id").alias("a"), F.col(column).alias(f"{column}_a"))
    right = values.select(F.col("doc_id").alias("b"), F.col(column).alias(f"{column}_b"))
    return pairs.join(left, "a").join(right, "b")


def _members(reps: DataFrame, files: int) -> DataFrame:
    """(band, rep, n, meets) of every band with two members or more: its size, and the sum of the sizes of all bands of the member."""
    rows = reps.select("rep", F.posexplode("bands").alias("k", "h"))
    buckets = _table(rows.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets", files)
    found = rows.join(buckets, ["k", "h"]).select(F.xxhash64("k", "h").alias("band"), "rep", "n").distinct()
    return _table(found.withColumn("meets", F.sum("n").over(Window.partitionBy("rep"))), "members", files)


def _hub_pairs(members: DataFrame, files: int) -> DataFrame:
    """Pairs (a, b) of each member with the hub of each of its bands, each pair once."""
    top = F.max(F.struct("meets", F.negative("rep").alias("rep")))
    hubs = _table(members.groupBy("band").agg(top.alias("top")).select("band", F.negative("top.rep").alias("hub")), "hubs", files)
    return members.join(hubs, "band").where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def _around(members: DataFrame, nodes: DataFrame, files: int) -> DataFrame:
    """(c, rep, label): the members of each band that still has several labels, with the centre of its most common one.

    Bands of two need nothing more: their members were compared.
    """
    at = _table(members.join(nodes, F.col("rep") == F.col("node")).select("band", "rep", "label", "meets"), "labelled", files)
    sizes = at.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", F.negative("label").alias("label")))
    open_ = sizes.groupBy("band").agg(most.alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1 AND n > 2")
    centre = at.groupBy("label").agg(F.max(F.struct("meets", F.negative("rep").alias("rep"))).alias("top"))
    centre = centre.select(F.col("label").alias("main"), F.negative("top.rep").alias("c"))
    open_ = _table(open_.select("band", F.negative("most.label").alias("main")).join(centre, "main"), "open", files)
    return at.join(open_, "band").select("c", "rep", "label").distinct()


def _elements(rows: DataFrame) -> DataFrame:
    """(c, rep, element) of rows (c, rep, set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, rep, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                e = np.frombuffer(x.as_py(), np.int64)
                yield pa.RecordBatch.from_pydict({"c": pa.array(np.full(len(e), c)), "rep": pa.array(np.full(len(e), rep)), "element": pa.array(e)})

    return rows.select("c", "rep", "set").mapInArrow(run, "c long, rep long, element long")


def _centres(around: DataFrame, sets: DataFrame, files: int) -> DataFrame:
    """(c, centre): for each group the set of elements that most of some ``_PICKED`` of its members hold. Any set would do for right results; this one leaves small differences."""
    size = around.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / _PICKED).alias("share"))
    picked = _table(around.join(size, "c").where(F.pmod(F.xxhash64("rep"), "share") == 0).select("c", "rep"), "picked", files)
    held = _elements(picked.join(sets, F.col("rep") == F.col("doc_id"))).groupBy("c", "element").agg(F.count(F.lit(1)).alias("n"))
    most = held.join(picked.groupBy("c").agg(F.count(F.lit(1)).alias("k")), "c").where("2 * n > k")
    return _table(most.groupBy("c").agg(F.array_sort(F.collect_list("element")).alias("centre")), "centres", files)


def _differences(around: DataFrame, sets: DataFrame, files: int) -> DataFrame:
    """(c, rep, part, label, size, n, difference): the symmetric difference of each set of a member and the centre of its group, n elements; part tells the sets of a repeated id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for x, c in zip(batch.column("set"), batch.column("centre"), strict=True):
                members = np.frombuffer(x.as_py(), np.int64)
                sizes.append(len(members))
                found.append(np.setxor1d(members, c.values.to_numpy() if c.is_valid else np.zeros(0, np.int64), assume_unique=True))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("c", "rep", "part", "label")), pa.array(sizes, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["c", "rep", "part", "label", "size", "n", "difference"],
            )

    rows = around.select("c", "rep", "label").join(sets, F.col("rep") == F.col("doc_id")).join(_centres(around, sets, files), "c", "left")
    return rows.select("c", "rep", F.xxhash64("set").alias("part"), "label", "set", "centre").mapInArrow(run, "c long, rep long, part long, label long, size long, n long, difference array<long>")


def _prefix_pairs(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, files: int) -> DataFrame:
    """Pairs (a, b) of one group with different labels; every similar pair is among them, or both are linked by way of a third.

    With D the difference of a set x from the centre, h = (1 - t) / (1 + t) and u(x) = |Dx| - h |x|: x and y are similar just if |Dx - Dy| + |Dy - Dx| <= h (|x| + |y|), so
    similar ones share at least (u(x) + u(y)) / 2 elements of their differences, and at least u(x) - h |x| / t. Where u(x) + u(y) <= 0 the two are similar whatever they share; all such are
    similar to the member of least u too, so a star around it stands for them. All others share an element. Elements are ordered rarest first by the differences
    of the group that hold them, those of one member alone before all others: they lead to nobody and are never dealt. Only elements
    before the last ones that could make up what must be shared are looked up.
    """
    t = percent / 100
    h = (1 - t) / (1 + t)
    found = _table(_differences(_table(_around(members, nodes, files), "around", files), sets, files), "differences", files).withColumn("u", F.col("n") - F.lit(h) * F.col("size"))
    low = found.groupBy("c").agg(F.min(F.struct("u", "rep", "label")).alias("x"))
    near = found.join(_table(low, "least", files), "c").where((F.col("u") + F.col("x.u") <= 1e-6) & (F.col("label") != F.col("x.label"))).select(F.col("rep").alias("a"), F.col("x.rep").alias("b"))
    elements = found.select("c", "rep", "part", F.explode("difference").alias("element"))
    shared = _table(elements.groupBy("c", "element").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "shared", files)
    ordered = elements.join(shared, ["c", "element"]).groupBy("c", "rep", "part").agg(F.array_sort(F.collect_set(F.struct("held", "element"))).alias("e"))
    must = F.greatest(F.lit(1), F.ceil(F.col("u") - F.lit(h / t) * F.col("size") - 1e-6))
    seen = F.greatest(F.col("n") - must + 1 - (F.col("n") - F.size("e")), F.lit(0)).cast("int")  # elements of the member alone take the first places
    facts = found.select("c", "rep", "part", "label", "size", "n", "u").join(ordered, ["c", "rep", "part"]).withColumn("seen", seen).where("seen > 0")
    keys = _table(facts.select("c", "rep", "label", "size", "u", F.size("e").alias("of"), F.transform(F.slice("e", F.lit(1), F.col("seen")), lambda x: x["element"]).alias("e")), "prefixes", files)
    keys = keys.select("c", "rep", "label", "size", "u", "of", F.posexplode("e").alias("at", "element"), "e")
    keys = keys.select("c", "element", "rep", "label", "size", "u", (F.col("of") - F.col("at")).alias("left"), F.slice("e", F.greatest(F.col("at") - _BEFORE + 1, F.lit(1)), F.least(F.col("at"), F.lit(_BEFORE))).alias("before"))
    side = lambda name: keys.select("c", "element", *[F.col(x).alias(f"{x}_{name}") for x in ("rep", "label", "size", "u", "left", "before")])
    total = F.col("u_x") + F.col("u_y")
    enough = (total > 1e-6) & (2 * F.least("left_x", "left_y") >= total - 1e-6)
    sized = 100 * F.least("size_x", "size_y") >= percent * F.greatest("size_x", "size_y")
    fresh = ~F.arrays_overlap("before_x", "before_y")  # else the two have met at an element before this one
    both = side("x").join(side("y"), ["c", "element"]).where((F.col("rep_x") < F.col("rep_y")) & (F.col("label_x") != F.col("label_y")) & sized & enough & fresh)
    return both.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).union(near.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
