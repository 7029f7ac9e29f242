"""Packs: a few megabytes of documents as one compressed row.

Looking up a value for every word or window of a corpus by a plain join would shuffle a row per
occurrence. Here a scan task packs its documents; a pack asks about each *distinct* key once, the
questions are dealt out by key range ("buckets"), and the answers return in the order of the keys,
so neither positions nor documents travel with them. The packs are shuffled once and meet their
answers in a cogroup. Both sides of that cogroup derive from the same shuffled packs. Input must be
a scan of files or a written table: then a lost task rebuilds the same packs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foldline.llm._shared import shuffle_partitions, small_batches

PACK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = np.asarray(x, np.uint64).copy()
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(256, dtype=np.uint64))
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_STEP = mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            f = np.full(max(n, 1 << 20), base, np.uint64)
            f[0] = 1
            _POWERS[k] = np.cumprod(f, dtype=np.uint64)
    return _POWERS


class Words:
    """The words of some texts: ``hash`` of each, ``doc`` (index of its text), ``first`` (word index at which each text begins)."""

    def __init__(self, texts: list[bytes], lower: bool = False, piece: int = 1 << 20):
        hashes, counts, at = [], [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < piece):
                size += len(texts[to]) + 1
                to += 1
            h, c = self._piece(texts[at:to], lower)
            hashes.append(h)
            counts.append(c)
            at = to
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.pos = np.arange(len(self.hash)) - self.first[self.doc]

    @staticmethod
    def _piece(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
        buf = (_LOWER if lower else _SAME)[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        power, inverse = _powers(len(buf) + 1)
        space = _SPACE[buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edge[0::2], edge[1::2]
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
        h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return h, np.diff(np.searchsorted(start, ends), prepend=0)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words from each word on, and whether they lie in one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += self.hash[j : n - k + 1 + j] * _STEP[j]
        return mix(h + np.uint64(k)), self.doc[: n - k + 1] == self.doc[k - 1 :]


def to_planes(x: np.ndarray, width: int = 8) -> bytes:
    """Byte planes of 64-bit values: sorted keys and small numbers then compress well."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(b: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel().astype(np.uint64)


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _freeze(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_batches(rows).combine_chunks())
    return sink.getvalue().to_pybytes()


def thaw(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def packed(docs: DataFrame, columns: list[str], by: str = "text", size: int = PACK_BYTES, shuffled: bool = True) -> DataFrame:
    """``docs`` as rows (pack, blob), dealt out by pack if ``shuffled``; ``by`` is the column whose bytes fill a pack."""
    spark = docs.sparkSession
    small_batches(spark)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            at = 0
            for i, n in enumerate(pc.binary_length(batch.column(by)).to_pylist()):
                held += (n or 0) + 16
                if held >= size:
                    rows.append(batch.slice(at, i + 1 - at))
                    yield _row(part, k, rows)
                    k, rows, held, at = k + 1, [], 0, i + 1
            if at < batch.num_rows:
                rows.append(batch.slice(at))
        if rows:
            yield _row(part, k, rows)

    def _row(part: int, k: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"pack": pa.array([part << 24 | k], pa.int64()), "blob": pa.array([_freeze(rows)], pa.binary())})

    packs = docs.select(*columns).mapInArrow(fill, "pack long, blob binary")
    return packs.repartition(shuffle_partitions(spark), "pack") if shuffled else packs


def key_buckets(docs: DataFrame, least: int) -> int:
    """Equal ranges of keys to deal questions by: as many as keep a range's share of the input, by its size on disk, near 16 MB, ``least`` at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 24, max(least, size // BUCKET_BYTES))


def table_files(docs: DataFrame) -> int:
    """Files for a table of numbers about each document: as many as the session has cores, or one for each 16 MB of the input's size on disk."""
    return key_buckets(docs, docs.sparkSession.sparkContext.defaultParallelism)


def questions(pack: int, keys: np.ndarray, buckets: int, parts: dict[str, Callable[[slice], bytes]]) -> pa.RecordBatch:
    """One row for each bucket with keys, which are sorted; ``parts`` gives its binary columns. Buckets are equal ranges of the 64-bit keys."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(of.astype(np.int64), prepend=-1))
    ends = [*first[1:].tolist(), len(keys)][: len(first)]
    data = {"pack": pa.array([pack] * len(first), pa.int64()), "bucket": pa.array(of[first].astype(np.int32), pa.int32())}
    for name, f in parts.items():
        data[name] = pa.array([f(slice(a, b)) for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(data)


def each_pack(packs: DataFrame, f: Callable[[int, pa.Table], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f(pack, its documents)`` for every pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob in zip(batch.column("pack").to_pylist(), batch.column("blob"), strict=True):
                yield from f(pack, thaw(blob.as_py()))

    return packs.mapInArrow(run, schema)


def answered(asked: DataFrame, f: Callable[[list[dict]], list[bytes]]) -> DataFrame:
    """``f`` gets the rows of one bucket, in the order of packs, and gives an answer for each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pack")
        return pa.table({"pack": table["pack"], "bucket": table["bucket"], "answer": pa.array(f(table.to_pylist()), pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "pack long, bucket int, answer binary")


def with_answers(packs: DataFrame, answers: DataFrame, f: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f(pack, its documents, the answers to its questions by bucket)`` for every pack."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left["pack"][0].as_py(), thaw(left["blob"][0].as_py()), right.sort_by("bucket"))

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, schema)
