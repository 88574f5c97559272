"""Repeated substrings by a blockwise suffix sort with a difference-cover sample.

A byte is removed when it lies in a string of ``width`` bytes that also starts in a document with
a smaller id. Three rounds between blocks of text and shards of sorted keys:

1. *Cover sample.* Positions whose residue modulo 31 is in a difference cover are sampled; two equal
   strings of 31 + k - 1 bytes, however they lie, hold an equal k-gram at a sampled position of
   both. Each shard sorts the sample's grams and tells which tie between documents. Whole
   documents meet here too: a later copy is removed entirely and takes no further part.
2. *Suffix buckets.* Only suffixes that reach a tied sample within the cover's period can repeat.
   They are dealt to buckets by the fingerprint of their first ``width`` bytes and sorted one
   bucket at a time; each bucket answers, for every suffix class of a block, whether a block of
   smaller ids holds it.
3. *Removal.* Blocks mark the windows that tie with a smaller id and cut the union of them.

Only equality to depth ``width`` matters, so the order within a bucket is that of 64-bit
fingerprints. A task holds one block (a few megabytes, or one longer document) or one bucket.
Blocks are ordered by id, so a bucket needs no ids. A string that a third of all documents hold
is one entry per block.

Nulls: a null text is empty; a null id counts as the largest. Rows that share an id count as one
document and never remove from each other. Texts shorter than ``width`` stay. An empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from greenledger.llm import common as C

PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # every residue modulo 31 is a difference of two of these

ASKED = "_shard int, _blk long, _rank long, body binary, copies binary, own binary"
ANSWER = "_blk long, _shard int, kind int, bits binary, copies binary, own binary"


def _by_id(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, off, ids, _ = C.unbundle(block)
    order = np.argsort(ids, kind="stable")
    if (order[1:] < order[:-1]).any():
        data, off = C.text_bytes(C.binaries(data, off).cast(pa.large_binary()).take(pa.array(order)))
    return data, off, ids[order]


def _offsets(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its document, and the end of that document."""
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    return doc, off[1:][doc]


def _sample(data: np.ndarray, off: np.ndarray, gram: int, bits: int):
    """Sampled positions, and their grams as shard and 32-bit remainder, in sorted order."""
    doc, end = _offsets(off)
    place = np.arange(len(data), dtype=np.int64)
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    at = np.flatnonzero(covered[(place - off[:-1][doc]) % PERIOD] & (place + gram <= end))
    keys = C.gram_hashes(data, gram, at) >> C.U64(32 - bits)
    order, keys = C.ordered(keys, 32 + bits)
    return at, doc, end, order, keys


def _copies(data: np.ndarray, off: np.ndarray, ids: np.ndarray) -> tuple[dict[bytes, int], np.ndarray]:
    """The first document of each text in the block, and which documents copy one with a smaller id here."""
    first, follows = {}, np.zeros(len(ids), bool)
    digests = []
    for i in range(len(ids)):
        d = hashlib.blake2b(data[off[i] : off[i + 1]], digest_size=16).digest()
        digests.append(d)
        follows[i] = ids[first.setdefault(d, i)] < ids[i]
    return dict(sorted(first.items())), follows, digests


def _ask_sample(gram: int, bits: int):
    def ask(key, block):
        data, off, ids = _by_id(block)
        at, doc, _, order, keys = _sample(data, off, gram, bits)
        begin, _ = C.runs(keys)
        owner = ids[doc[at[order]]]
        tied = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin) if len(begin) else np.zeros(0, bool)
        distinct = keys[begin]
        cut = np.searchsorted(distinct >> C.U64(32), np.arange((1 << bits) + 1, dtype=C.U64))
        first, _, _ = _copies(data, off, ids)
        parts: dict[int, list[bytes]] = {}
        for d in first:
            parts.setdefault(d[0] % (1 << bits) if bits <= 8 else int.from_bytes(d[:4], "big") % (1 << bits), []).append(d)
        rank = block.column("_rank")[0].as_py()
        rows = []
        for s in range(1 << bits):
            part = distinct[cut[s] : cut[s + 1]] & C.U64(0xFFFFFFFF)
            if len(part) or s in parts:
                rows.append({"_shard": s, "_blk": key[0].as_py(), "_rank": rank, "body": C.pack_sorted(part), "copies": b"".join(parts.get(s, [])), "own": C.pack_bits(tied[cut[s] : cut[s + 1]])})
        return _table(rows, ("_shard", "_blk", "_rank", "body", "copies", "own"))

    return ask


def _table(rows: list[dict], names: tuple[str, ...]) -> pa.Table:
    kinds = {"_shard": pa.int32(), "_blk": pa.int64(), "_rank": pa.int64(), "kind": pa.int32()}
    return pa.table({n: pa.array([r[n] for r in rows], kinds.get(n, pa.binary())) for n in names})


def _answer_sample(key, rows):
    """A gram ties when two blocks hold it, or two documents of one block."""
    grams = [C.unpack_sorted(x) for x in C.cells(rows, "body")]
    tied = np.concatenate([C.unpack_bits(x) for x in C.cells(rows, "own")])
    sizes = [len(g) for g in grams]
    keys = np.concatenate(grams)
    order, keys = C.ordered(keys)
    begin, run = C.runs(keys)
    ties = (np.diff(np.r_[begin, len(keys)]) > 1) | (np.bincount(run, tied[order], len(begin)) > 0 if len(keys) else np.zeros(0, bool))
    out = np.empty(len(keys), bool)
    out[order] = ties[run]
    ranks, least = C.cells(rows, "_rank"), {}
    lists = [[x[i : i + 16] for i in range(0, len(x), 16)] for x in C.cells(rows, "copies")]
    for rank, digests in zip(ranks, lists):
        for d in digests:
            least[d] = min(rank, least.get(d, rank))
    answers, lo = [], 0
    for blk, rank, size, digests in zip(C.cells(rows, "_blk"), ranks, sizes, lists):
        answers.append({"_blk": blk, "_shard": key[0].as_py(), "kind": 0, "bits": C.pack_bits(out[lo : lo + size]), "copies": b"".join(d for d in digests if least[d] < rank), "own": None})
        lo += size
    return _table(answers, ("_blk", "_shard", "kind", "bits", "copies", "own"))


def _classes(data: np.ndarray, at: np.ndarray, width: int):
    order, keys = C.ordered(C.gram_hashes(data, width, at))
    return keys, order, *C.runs(keys)


def _ask_suffixes(width: int, gram: int, bits: int):
    def ask(key, block, answers):
        data, off, ids = _by_id(block)
        at, doc, end, order, keys = _sample(data, off, gram, bits)
        _, run = C.runs(keys)
        answers = answers.take(pc.sort_indices(answers.column("_shard")))
        ties = np.concatenate([np.zeros(0, bool)] + [C.unpack_bits(x) for x in C.cells(answers, "bits")])
        flags = np.zeros(len(data) + PERIOD + 1, np.int32)
        flags[at[order[ties[run]]] + 1] = 1
        reach = np.cumsum(flags, dtype=np.int32)
        n = len(data)
        chosen = reach[PERIOD : PERIOD + n] > reach[:n]
        _, follows, digests = _copies(data, off, ids)
        elsewhere = {x[i : i + 16] for x in C.cells(answers, "copies") for i in range(0, len(x), 16)}
        follows |= np.fromiter((d in elsewhere for d in digests), bool, len(digests))
        chosen &= (np.arange(n) + width <= end) & ~follows[doc]
        keys, _, begin, _ = _classes(data, np.flatnonzero(chosen), width)
        distinct = keys[begin]
        cut = np.searchsorted(distinct >> C.U64(64 - bits), np.arange((1 << bits) + 1, dtype=C.U64))
        blk, rank = key[0].as_py(), block.column("_rank")[0].as_py()
        rows = []
        for s in range(1 << bits):
            if cut[s] < cut[s + 1] or s == blk % (1 << bits):
                own = C.pack_bits(np.concatenate([follows, chosen])) if s == blk % (1 << bits) else None
                rows.append({"_shard": s, "_blk": blk, "_rank": rank, "body": C.pack_sorted(distinct[cut[s] : cut[s + 1]]), "copies": None, "own": own})
        return _table(rows, ("_shard", "_blk", "_rank", "body", "copies", "own"))

    return ask


def _answer_suffixes(key, rows):
    """Of each block's suffix classes: does a block of smaller rank hold it?"""
    lists = [C.unpack_sorted(x) for x in C.cells(rows, "body")]
    sizes = np.array([len(x) for x in lists])
    ranks = np.repeat(np.array(C.cells(rows, "_rank"), np.int64), sizes)
    keys = np.concatenate(lists)
    order, keys = C.ordered(keys)
    begin, run = C.runs(keys)
    least = np.minimum.reduceat(ranks[order], begin) if len(begin) else ranks
    out = np.empty(len(keys), bool)
    out[order] = ranks[order] > least[run]
    ends = np.cumsum(sizes)
    answers = [
        {"_blk": blk, "_shard": key[0].as_py(), "kind": 1, "bits": C.pack_bits(out[e - n : e]), "copies": None, "own": own}
        for blk, n, e, own in zip(C.cells(rows, "_blk"), sizes, ends, C.cells(rows, "own"))
    ]
    return _table(answers, ("_blk", "_shard", "kind", "bits", "copies", "own"))


def _remove(width: int):
    def remove(key, block, answers):
        data, off, ids = _by_id(block)
        answers = answers.take(pc.sort_indices(answers.column("_shard")))
        own = np.concatenate([C.unpack_bits(x) for x in C.cells(answers, "own") if x is not None])
        follows, chosen = own[: len(ids)], own[len(ids) :]
        earlier = np.concatenate([C.unpack_bits(x) for x in C.cells(answers, "bits")])
        doc, _ = _offsets(off)
        at = np.flatnonzero(chosen)
        _, order, begin, run = _classes(data, at, width)
        at = at[order]
        owner = ids[doc[at]]
        repeated = at[earlier[run] | (owner > np.minimum.reduceat(owner, begin)[run])] if len(at) else at
        steps = np.zeros(len(data) + 1, np.int32)
        np.add.at(steps, repeated, 1)
        np.add.at(steps, repeated + width, -1)
        gone = np.cumsum(steps[:-1]) > 0
        lengths = np.diff(off)
        gone |= (follows & (lengths >= width))[doc]
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[off[1:]] - total[off[:-1]]
        first = gone.copy()
        first[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
        last = gone.copy()
        last[:-1] &= ~gone[1:] | (doc[1:] != doc[:-1])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        spans_off = np.searchsorted(starts, off)
        owner = doc[starts]
        pairs = pa.StructArray.from_arrays([pa.array(starts - off[owner]), pa.array(ends - off[owner])], names=["start", "end"])
        kept_off = np.concatenate([[0], np.cumsum(lengths - removed)])
        return pa.table({
            "_id": pa.array(ids, pa.int64()),
            "n_bytes": pa.array(lengths, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(spans_off, pa.int32()), pairs),
            "kept": C.binaries(data[~gone], kept_off),
        })

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: ``_id`` (long; a missing id is the largest), n_bytes, n_removed, spans
    (array of start and end of maximal removed runs, in bytes) and kept (binary: the rest)."""
    gram = width - PERIOD + 1
    if gram < 8:
        raise ValueError(f"width must be at least {PERIOD + 7}")
    blocks = C.in_blocks(C.intake(docs, id_col, text_col).withColumn("_flag", F.lit(False)), block_bytes, ordered=True)
    bits = C.shard_bits(docs)
    sample = blocks.groupBy("_blk").applyInArrow(_ask_sample(gram, bits), ASKED).groupBy("_shard").applyInArrow(_answer_sample, ANSWER)
    asked = blocks.groupBy("_blk").cogroup(sample.groupBy("_blk")).applyInArrow(_ask_suffixes(width, gram, bits), ASKED)
    found = asked.groupBy("_shard").applyInArrow(_answer_suffixes, ANSWER)
    return blocks.groupBy("_blk").cogroup(found.groupBy("_blk")).applyInArrow(_remove(width), "_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
