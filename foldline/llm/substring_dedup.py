"""Substring dedup by fixed-block anchors.

Every text is a reference: its non-overlapping blocks of ``(window + 1) // 2`` words are indexed. A
window of ``window`` words contains a whole block of any text that holds it, so each repeated window
has an anchor among the rolling probes. Every rolling window of block length probes the index; the
full windows around hits are then compared across the corpus by 64-bit hash, and adjoining repeated
windows join into maximal exact repeats. No pairs of documents are formed, so a passage that a third of
all documents share costs one key for each pack.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldline.llm import _packs as P
from foldline.llm._shared import shuffle_partitions

_LAST = np.iinfo(np.int64).max


def _hits(words: P.Words, block: int, keys: np.ndarray, where: np.ndarray, answers: list[bytes]) -> np.ndarray:
    """For each word, whether the block-long window from it on is an anchor of another place."""
    total = np.frombuffer(b"".join(answers), np.uint8)
    if len(total) != len(keys):
        raise RuntimeError("a pack changed between its question and its answer; the input must be a scan of files")
    hit = np.zeros(len(words.hash), bool)
    n = total[where]
    at = np.flatnonzero(words.windows(block)[1])
    hit[at] = (n >= 2) | ((n == 1) & (words.pos[at] % block != 0))
    return hit


def _probes(words: P.Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct probe keys (40 bits, in the high bits), the key of each probe, and the index entries of each key."""
    h, valid = words.windows(block)
    h = (h[valid] >> np.uint64(24)) << np.uint64(24)
    keys, where = np.unique(h, return_inverse=True)
    aligned = words.pos[: len(valid)][valid] % block == 0
    return keys, where, np.minimum(np.bincount(where[aligned], minlength=len(keys)), 255)


def _candidates(words: P.Words, block: int, window: int, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of each full window that contains an anchor."""
    h, valid = words.windows(window)
    run = np.concatenate([[0], np.cumsum(hit)])
    at = np.arange(len(h))
    some = run[at + window - block + 1] > run[at]
    at = at[valid & some]
    return at, h[at]


def substring_dedup(docs: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a ``window`` of words that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) and removed
    (array of [first, last] word indexes of the maximal removed runs). Null and empty texts give an
    empty kept_text and no words. Texts shorter than a window keep everything. Rows that repeat an
    id do not remove words from each other (no id is smaller). A null id counts as the largest. An empty table gives no rows.
    A very long text is one pack, worked on in arrays of its words. Windows are compared by 64-bit hash.
    Other columns are ignored. ``docs`` must be a scan of files or a written table.
    """
    block = (window + 1) // 2
    spark = docs.sparkSession
    buckets = P.key_buckets(docs, 2 * shuffle_partitions(spark))
    packs = P.packed(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), ["doc_id", "text"])

    def ask_blocks(pack: int, t: pa.Table):
        keys, _, entries = _probes(P.Words(P.as_bytes(t["text"])), block)
        yield P.questions(pack, keys, buckets, {"keys": lambda s: P.to_planes(keys[s] >> np.uint64(24), 5), "entries": lambda s: entries[s].astype(np.uint8).tobytes()})

    def count_blocks(rows: list[dict]) -> list[bytes]:
        keys = np.concatenate([P.from_planes(r["keys"], 5) for r in rows])
        entries = np.concatenate([np.frombuffer(r["entries"], np.uint8) for r in rows])
        _, where = np.unique(keys, return_inverse=True)
        total = np.minimum(np.bincount(where, weights=entries), 2).astype(np.uint8)[where]
        ends = np.cumsum([len(r["entries"]) for r in rows])
        return [x.tobytes() for x in np.split(total, ends[:-1])]

    anchors = P.answered(P.each_pack(packs, ask_blocks, "pack long, bucket int, keys binary, entries binary"), count_blocks)

    def known(t: pa.Table, answers: list[bytes]):
        words = P.Words(P.as_bytes(t["text"]))
        keys, where, _ = _probes(words, block)
        at, h = _candidates(words, block, window, _hits(words, block, keys, where, answers))
        ids = np.array([_LAST if x is None else x for x in t["doc_id"].to_pylist()], np.int64)
        full, where = np.unique(h, return_inverse=True)
        first = np.full(len(full), _LAST, np.int64)
        np.minimum.at(first, where, ids[words.doc[at]])
        return words, ids, at, full, where, first

    def ask_windows(pack: int, t: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, _, full, _, first = known(t, answers["answer"].to_pylist())
        return pa.Table.from_batches([P.questions(pack, full, buckets, {"keys": lambda s: P.to_planes(full[s]), "first": lambda s: P.to_planes(first[s])})])

    def find_first(rows: list[dict]) -> list[bytes]:
        keys = np.concatenate([P.from_planes(r["keys"]) for r in rows])
        first = np.concatenate([P.from_planes(r["first"]).astype(np.int64) for r in rows])
        distinct, where = np.unique(keys, return_inverse=True)
        least = np.full(len(distinct), _LAST, np.int64)
        np.minimum.at(least, where, first)
        ends = np.cumsum([len(r["keys"]) // 8 for r in rows])
        return [x.tobytes() for x in np.split((least[where] < first).astype(np.uint8), ends[:-1])]

    asked = P.with_answers(packs, anchors, ask_windows, "pack long, bucket int, keys binary, first binary")
    firsts = P.answered(asked, find_first)

    def cut(pack: int, t: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers["kind"].to_pylist()
        parts = [[a for a, k in zip(answers["answer"].to_pylist(), kind, strict=True) if k == want] for want in (0, 1)]
        words, ids, at, full, where, first = known(t, parts[0])
        earlier = np.frombuffer(b"".join(parts[1]), np.uint8).astype(bool)
        if len(earlier) != len(full):
            raise RuntimeError("a pack changed between its question and its answer; the input must be a scan of files")
        gone = at[earlier[where] | (ids[words.doc[at]] > first[where])] if len(at) else at
        edge = np.zeros(len(words.hash) + window + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        drop = np.cumsum(edge)[: len(words.hash)] > 0
        kept, removed, n_removed = [], [], []
        for i, text in enumerate(P.as_bytes(t["text"])):
            own = drop[words.first[i] : words.first[i + 1]]
            n = int(own.sum())
            parts = text.split()
            kept.append(b" ".join([w for w, d in zip(parts, own.tolist(), strict=True) if not d] if n else parts))
            turn = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)) if n else []
            removed.append([[int(a), int(b) - 1] for a, b in zip(turn[0::2], turn[1::2], strict=True)])
            n_removed.append(n)
        return pa.table({
            "doc_id": t["doc_id"], "n_words": pa.array(words.count, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed": pa.array(removed, pa.list_(pa.list_(pa.int64()))),
        })

    both = anchors.selectExpr("pack", "bucket", "answer", "0 AS kind").unionByName(firsts.selectExpr("pack", "bucket", "answer", "1 AS kind"))
    return P.with_answers(packs, both, cut, "doc_id long, n_words long, n_removed long, kept_text string, removed array<array<long>>")
