"""Byte-level BPE by a table of distinct words.

Texts are split into the pre-tokens of a byte-level tokenizer; each distinct pre-token of a pack is
asked for once, each distinct pre-token of the corpus is encoded once, and its ids return to the
positions of the pre-token in every text. Decoding joins ids with the vocabulary's pieces, a table
whose size the vocabulary fixes.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from foldline.llm import _packs as P
from foldline.llm._shared import shuffle_partitions, small_batches

#: Unicode White_Space, and the pre-token pattern of the byte-level vocabularies.
_WS = r"\t-\r \x85\xa0  -     　"
_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[Tokenizer, dict[str, int]]:
    """The tokenizer without truncation and padding, and its special tokens. A task has one core, so it starts no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, {x["content"]: x["id"] for x in json.loads(t.to_str())["added_tokens"]}


@lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    """The bytes of each id. Byte-level vocabularies write each byte as one printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    t, special = _tokenizer(path)
    vocab = {i: w for w, i in t.get_vocab(with_added_tokens=True).items()}
    return pa.array([
        vocab[i].encode() if i in special.values() else bytes(byte[c] for c in vocab[i]) if i in vocab else b"" for i in range(max(vocab) + 1)
    ], pa.binary())


def _split(text: str, special: dict[str, int]) -> list[str]:
    """Pre-tokens; a special token's string is a pre-token of its own."""
    found = [s for s in special if s in text]
    if not found:
        return _PATTERN.findall(text)
    out: list[str] = []
    for k, part in enumerate(regex.split("(" + "|".join(map(regex.escape, sorted(found, key=len, reverse=True))) + ")", text)):
        out += [part] if k % 2 else _PATTERN.findall(part)
    return out


def _by_bucket(words: Iterable[str], buckets: int) -> list[tuple[int, list[str]]]:
    """Distinct pre-tokens, sorted, by bucket of their hash, in order of the buckets."""
    words = sorted(words)
    by: dict[int, list[str]] = {}
    for w, b in zip(words, _bucket(words, buckets), strict=True):
        by.setdefault(b, []).append(w)
    return sorted(by.items())


def _bucket(words: list[str], buckets: int) -> list[int]:
    """Buckets by the bytes and length of each word."""
    if not words:
        return []
    a = pa.array(words, pa.large_string()).cast(pa.large_binary())
    data, ends = np.frombuffer(a.buffers()[2], np.uint8), np.frombuffer(a.buffers()[1], np.int64, len(words) + 1)
    pos = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(P.mix(data.astype(np.uint64) + (pos.astype(np.uint64) << np.uint64(8))))])
    return (P.mix(total[ends[1:]] - total[ends[:-1]]) % np.uint64(buckets)).tolist()


def _texts(t: pa.Table) -> Iterator[str]:
    return (x.as_py() or "" for x in t["text"])


def _decoded(ids: pa.Array, ends: np.ndarray, path: str) -> pa.Array:
    """The texts of consecutive ranges of ``ids``, by a lookup of each id's piece; ``ends`` has the first begin and all ends."""
    got = _pieces(path).cast(pa.large_binary()).take(ids)
    at = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)[ends]
    data = memoryview(got.buffers()[2]) if len(got) else b""
    return pa.array([str(data[a:b], "utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())


def bpe_encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """Token ids of every text, as the tokenizer file gives them without adding special tokens.

    Returns doc_id and ids (array<int>), one row for each input row, repeated ids included. Null
    and empty texts have no ids. A special token's string in a text becomes its id. ``decoded_col`` names a further
    column for what :func:`bpe_decode` makes of the ids, here in the task that found them. Other columns are ignored. ``docs`` must be a scan of files or a written table; ``tokenizer_path`` must be
    readable where tasks run. For byte-level BPE vocabularies. An empty table gives no rows; a very long text is one pack.
    """
    buckets = P.key_buckets(docs, shuffle_partitions(docs.sparkSession))
    packs = P.packed(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), ["doc_id", "text"])

    def ask(pack: int, t: pa.Table):
        special, words = _tokenizer(tokenizer_path)[1], set()
        for text in _texts(t):
            words.update(_split(text, special))
        by = _by_bucket(words, buckets)
        press = zstandard.ZstdCompressor(level=6)
        asked = [press.compress("\x00".join(w.replace("\x00", "\x00\x01") for w in own).encode()) for _, own in by]
        yield pa.RecordBatch.from_pydict({"pack": pa.array([pack] * len(by), pa.int64()), "bucket": pa.array([b for b, _ in by], pa.int32()), "words": pa.array(asked, pa.binary())})

    def encode(rows: list[dict]) -> list[bytes]:
        tokenizer, special = _tokenizer(tokenizer_path)
        press, unpress = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        asked = [[w.replace("\x00\x01", "\x00") for w in regex.split("\x00(?!\x01)", unpress.decompress(r["words"]).decode())] for r in rows]
        words = sorted(set().union(*asked))
        ids = [[special[w]] if w in special else None for w in words]
        todo = [k for k, x in enumerate(ids) if x is None]
        for k in range(0, len(todo), 4096):
            part = todo[k : k + 4096]
            for i, e in zip(part, tokenizer.encode_batch([words[i] for i in part], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        at = {w: k for k, w in enumerate(words)}
        count, flat = np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.uint32)
        first = np.concatenate([[0], np.cumsum(count)])
        out = []
        for a in asked:
            k = np.array([at[w] for w in a], np.int64)
            own, n = flat[_ranges(first[k], count[k])], count[k].astype(np.uint32)
            out.append(press.compress(np.uint32(len(k)).tobytes() + P.to_planes(n, 4) + own.astype(np.uint32 if len(own) and own.max() > 65535 else np.uint16).tobytes()))
        return out

    def join(pack: int, t: pa.Table, answers: pa.Table) -> pa.Table:
        special, seen = _tokenizer(tokenizer_path)[1], defaultdict(count().__next__)  # numbers pre-tokens as they come
        places = [np.fromiter(map(seen.__getitem__, _split(text, special)), np.int32) for text in _texts(t)]
        words = [w for _, own in _by_bucket(seen, buckets) for w in own]
        unpress, counts, flats = zstandard.ZstdDecompressor(), [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a in answers["answer"].to_pylist():
            b = unpress.decompress(a)
            n = int(np.frombuffer(b, np.uint32, 1)[0])
            counts.append(P.from_planes(b[4 : 4 + 4 * n], 4).astype(np.int64))
            total, rest = int(counts[-1].sum()), b[4 + 4 * n :]
            flats.append(np.frombuffer(rest, np.uint32 if len(rest) == 4 * total else np.uint16).astype(np.uint32))
        n_ids, flat = np.concatenate(counts), np.concatenate(flats)
        first = np.concatenate([[0], np.cumsum(n_ids)])
        if len(words) != len(n_ids):
            raise RuntimeError("a pack changed between its question and its answer; the input must be a scan of files")
        rank = np.zeros(len(words), np.int64)
        rank[np.fromiter((seen[w] for w in words), np.int64, len(words))] = np.arange(len(words))
        k = rank[np.concatenate([np.zeros(0, np.int32), *places])]
        ids = pa.array(flat[_ranges(first[k], n_ids[k])].astype(np.int32), pa.int32())
        ends = np.concatenate([[0], np.cumsum(n_ids[k])])[np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int64)]
        out = {"doc_id": t["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)}
        return pa.table(out | ({decoded_col: _decoded(ids, ends, tokenizer_path)} if decoded_col else {}))

    asked = P.each_pack(packs, ask, "pack long, bucket int, words binary")
    return P.with_answers(packs, P.answered(asked, encode), join, "doc_id long, ids array<int>" + (f", `{decoded_col}` string" if decoded_col else ""))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indexes first, first + 1, ... of every range, one after the other."""
    total = int(count.sum())
    out = np.ones(total, np.int64)
    some = count > 0
    f, n = first[some], count[some]
    if not total:
        return out
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[begin] = f - np.concatenate([[0], f[:-1] + n[:-1] - 1])
    return np.cumsum(out)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``: the text of ``ids_col``, special tokens included; bytes that are no UTF-8 become U+FFFD.

    Ids are joined with the pieces of the vocabulary, whose number is fixed, by a lookup in each task. Null ids give an empty text;
    rows that repeat an id are decoded each, an empty table gives no rows, and a very long list of ids is one row in memory.
    """
    small_batches(encoded.sparkSession)
    schema = encoded.drop(out_col).schema.add(out_col, "string")
    names = [f.name for f in schema][:-1]

    def run(batches):
        for batch in batches:
            ids = batch.column(ids_col)
            ends = np.concatenate([[0], np.cumsum([0 if n is None else n for n in ids.value_lengths().to_pylist()])]).astype(np.int64)
            texts = _decoded(ids.flatten(), ends, tokenizer_path)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts], names=[*names, out_col])

    return encoded.drop(out_col).mapInArrow(run, schema)
