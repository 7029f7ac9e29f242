"""Language-model scoring with a log-frequency Bloom filter.

Training counts every word pair of the corpus. The filter holds each pair with its count on a logarithmic
scale: a pair of quantised count q is entered q times, with levels 1 to q, so a count is read by probing
levels until one is missing. The filter is cut into a fixed number of blocks by equal ranges of pair keys,
and each block is sized from its own entries, so no counted pair is left out at any size of the corpus.
It is never in one place: the group that counts a range of keys builds its blocks, probes them for the
pairs the packs ask about, and answers with levels. Scores smooth the pair counts towards exact word
probabilities, which come from the same shuffled lookup of each pack's distinct words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foldline.llm import _packs as P
from foldline.llm._shared import shuffle_partitions

#: The key of the end of a text, and of what stands before its first word.
_END = np.uint64(0x2545F4914F6CDD1D)
#: Levels of a count c: 1 + floor(log(c) / log(_BASE)).
_BASE = 1.5
_HASHES = 6
#: Blocks of the filter (a power of two): the same whatever the cluster.
_BLOCKS = 1 << 20
#: Bits of a block for each of its entries; a missing level is then found present with probability below 0.00003.
_ENTRY_BITS = 32
#: Bits of the blocks that are built at once, one byte each.
_AT_ONCE = 1 << 26


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts, each text ending in the end token; text of each token; index of each text's end."""
    words = P.Words(texts, lower=True)
    ends = words.first[1:] + np.arange(len(texts))
    keys = np.insert(words.hash, words.first[1:], _END)
    return keys, np.repeat(np.arange(len(texts)), words.count + 1), ends


def _pairs(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Key of each token together with the one before it (the end key before a text's first)."""
    before = np.concatenate([[_END], keys[:-1]]).astype(np.uint64)
    before[np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)] = _END
    return P.mix(before * np.uint64(0x9E3779B97F4A7C15) + keys)


def held_out(ids: list) -> np.ndarray:
    """Whether crc32 of the id as text leaves 1 when divided by 5; a null id is trained on."""
    return np.array([x is not None and zlib.crc32(str(x).encode()) % 5 == 1 for x in ids], bool)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(_BASE) + 1e-9).astype(np.int64)


def _places(keys: np.ndarray, level: int, width: np.ndarray) -> np.ndarray:
    """Bit positions of (key, level) inside the key's block of ``width`` bits; one row for each hash."""
    x = P.mix(keys + np.uint64(level) * np.uint64(0xD1342543DE82EF95))
    step = P.mix(x) | np.uint64(1)
    return np.stack([(x + np.uint64(i) * step) % width.astype(np.uint64) for i in range(_HASHES)]).astype(np.int64)


def filter_levels(keys: np.ndarray, count: np.ndarray, least: int) -> np.ndarray:
    """Enter the sorted distinct ``keys`` with a count into their blocks, and read the level of every key; 0 if the first is missing.

    A block has ``least`` bits, or ``_ENTRY_BITS`` for each entry where that is more. Blocks are built a few at a time.
    """
    level = np.where(count > 0, _level(np.maximum(count, 1)), 0)
    out = np.zeros(len(keys), np.int64)
    block = (keys >> np.uint64(64 - _BLOCKS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    if not len(first):
        return out
    width = np.maximum(least, np.add.reduceat(level, first) * _ENTRY_BITS)
    edges, at = [*first.tolist(), len(keys)], 0
    while at < len(first):
        to, size = at, 0
        while to < len(first) and (to == at or size + width[to] <= _AT_ONCE):
            size += int(width[to])
            to += 1
        own = slice(edges[at], edges[to])
        k, q_in = keys[own], level[own]
        which = np.repeat(np.arange(to - at), np.diff(edges[at : to + 1]))
        w, base = width[at:to][which], (np.cumsum(width[at:to]) - width[at:to])[which]
        field = np.zeros(size, bool)
        for q in range(1, int(q_in.max()) + 1):
            x = np.flatnonzero(q_in >= q)
            field[(_places(k[x], q, w[x]) + base[x]).ravel()] = True
        read, open_, q = np.zeros(len(k), np.int64), np.arange(len(k)), 1
        while len(open_):
            open_ = open_[field[_places(k[open_], q, w[open_]) + base[open_]].all(axis=0)]
            read[open_] = q
            q += 1
        out[own] = read
        at = to
    return out


def level_counts(level: np.ndarray) -> np.ndarray:
    """Estimated count of each level; 0 of level 0."""
    level = level.astype(np.int64)
    low = np.ceil(_BASE ** (np.maximum(level, 1) - 1) - 1e-9)
    high = np.ceil(_BASE ** np.maximum(level, 1) - 1e-9) - 1
    return np.where(level > 0, np.sqrt(low * np.maximum(high, low)), 0.0)


def _key_buckets(docs: DataFrame) -> int:
    """Equal key ranges to deal questions by: a power of two, so that each block of the filter lies in one."""
    return min(_BLOCKS, 1 << (P.key_buckets(docs, max(64, 2 * shuffle_partitions(docs.sparkSession))) - 1).bit_length())


def train_totals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """The tokens of the texts that are not held out, and how many are distinct. Only these sums reach the driver."""
    buckets = _key_buckets(docs)
    packs = P.packed(docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")), ["doc_id", "text"], shuffled=False)

    def ask(pack: int, t: pa.Table):
        out = held_out(t["doc_id"].to_pylist())
        k, n = _counted(_tokens([x for x, o in zip(P.as_bytes(t["text"]), out, strict=True) if not o])[0])
        yield P.questions(pack, k, buckets, {"keys": lambda s: P.to_planes(k[s] >> np.uint64(16), 6), "n": lambda s: P.to_planes(n[s], 4)})

    def add(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        keys = np.concatenate([P.from_planes(r["keys"], 6) for r in rows])
        n = sum(int(P.from_planes(r["n"], 4).sum()) for r in rows)
        return pa.table({"n_tokens": pa.array([n], pa.int64()), "n_distinct": pa.array([len(np.unique(keys))], pa.int64())})

    asked = P.each_pack(packs, ask, "pack long, bucket int, keys binary, n binary")
    rows = asked.groupBy("bucket").applyInArrow(add, "n_tokens long, n_distinct long").collect()
    return sum(r["n_tokens"] for r in rows), sum(r["n_distinct"] for r in rows)


def lm_scores(docs: DataFrame, *, bits: int = 1 << 28, strength: float = 100.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every text under the model learnt from the texts that are not held out.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score
    (smoothed word probabilities) and score: the sum of log10 of
    (count(pair) + strength * p(word)) / (count(previous) + strength), the pair count read from the filter
    and limited to the exact counts of its words. ``bits`` is the least size of the filter, which grows with
    its entries. Null texts count as empty; case of A-Z is ignored.
    One row for each input row; rows that repeat an id are counted each. ``docs`` must be a scan of files or a written table.
    """
    n_all, n_distinct = train_totals(docs, id_col=id_col, text_col=text_col)
    buckets, least = _key_buckets(docs), max(8, bits // _BLOCKS)
    packs = P.packed(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), ["doc_id", "text"])

    def ask(pack: int, t: pa.Table):
        keys, doc, ends = _tokens(P.as_bytes(t["text"]))
        trained = ~held_out(t["doc_id"].to_pylist())[doc]
        for kind, k in ((0, keys), (1, _pairs(keys, ends) >> np.uint64(20) << np.uint64(20))):
            k, where = np.unique(k, return_inverse=True)
            n = np.bincount(where[trained], minlength=len(k))
            b = P.questions(pack, k, buckets, {"keys": lambda s, k=k: P.to_planes(k[s] >> np.uint64(16), 6), "n": lambda s, n=n: P.to_planes(n[s], 4)})
            yield b.set_column(1, "bucket", pc.add(b.column("bucket"), pa.scalar(kind * buckets, pa.int32())))

    def count(rows: list[dict]) -> list[bytes]:
        keys = np.concatenate([P.from_planes(r["keys"], 6) for r in rows])
        n = np.concatenate([P.from_planes(r["n"], 4) for r in rows])
        distinct, where = np.unique(keys, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, where, n.astype(np.int64))
        ends = np.cumsum([len(r["n"]) // 4 for r in rows])
        if rows[0]["bucket"] >= buckets:  # pairs: a level each
            return [P.to_planes(x, 1) for x in np.split(filter_levels(distinct << np.uint64(16), total, least)[where], ends[:-1])]
        return [P.to_planes(x, 6) for x in np.split(total[where], ends[:-1])]

    def score(pack: int, t: pa.Table, answers: pa.Table) -> pa.Table:
        texts = P.as_bytes(t["text"])
        keys, doc, ends = _tokens(texts)
        where = np.unique(keys, return_inverse=True)[1]
        given = list(zip(answers["bucket"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        counts = np.concatenate([np.zeros(0, np.uint64), *(P.from_planes(a, 6) for b, a in given if b < buckets)]).astype(np.float64)
        levels = np.concatenate([np.zeros(0, np.uint64), *(P.from_planes(a, 1) for b, a in given if b >= buckets)])
        c = counts[where]
        p = (c + 0.5) / (n_all + 0.5 * (n_distinct + 1))
        before = np.concatenate([[0.0], c[:-1]])
        before[np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)] = counts[where[ends[0]]] if len(ends) else 0
        at = np.unique(_pairs(keys, ends) >> np.uint64(20) << np.uint64(20), return_inverse=True)[1]
        both = np.minimum(level_counts(levels)[at], np.minimum(c, before))
        add = lambda x: np.bincount(doc, weights=x, minlength=len(texts))
        return pa.table({
            "doc_id": t["doc_id"], "held_out": pa.array(held_out(t["doc_id"].to_pylist())), "n_tokens": pa.array(np.bincount(doc, minlength=len(texts)), pa.int64()),
            "n_known": pa.array(add(c > 0).astype(np.int64)), "train_tokens": pa.array([n_all] * len(texts), pa.int64()),
            "base_score": pa.array(add(np.log10(p))), "score": pa.array(add(np.log10((both + strength * p) / (before + strength)))),
        })

    answers = P.answered(P.each_pack(packs, ask, "pack long, bucket int, keys binary, n binary"), count)
    return P.with_answers(packs, answers, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
