"""Benchmark decontamination by winnowing.

Of the 5-word grams in every run of 9 of them only the one with the least hash is kept as a
fingerprint (the rightmost on ties). Two texts that share 13 words in a row therefore share a fingerprint
at the same place of the shared span, so joining the fingerprints of documents and of benchmark
items misses no window of 13 words. Each joined pair of places is then extended word by word in both
directions, and spans of at least 13 words count. An item with fewer words is one window: its whole
word sequence, found by grams of its own length.

The benchmark is the stated query set: it is cut into slices of at most ``slice_bytes`` of text,
measured first, and each slice goes to every task and meets all documents where they lie. Documents are
read once per slice and never shuffled; what a slice finds are word ranges, merged per document.

A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; words are compared by 64-bit hashes.

Nulls: a null text, of a document or an item, has no words. A null item id is no item. Repeated
rows: each document row is judged; items that share an id are one item with several texts. Empty
tables: no document is hit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from greenledger.llm import common as C
from greenledger.session import cut

WINDOW = 13
GRAM = 5
U = C.U64

BREAKS = [b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)]
FOUND = "n_words long, ranges array<struct<start: long, end: long>>, items array<long>"


def words_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words before each text."""
    data, off = C.text_bytes(column)
    data = C.lower_ascii(data)
    breaks = np.zeros(256, bool)
    breaks[BREAKS] = True
    starts, ends, before = C.word_spans(data, off, breaks)
    return C.word_hashes(data, starts, ends), before


def gram_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; texts are not told apart here."""
    n = max(0, len(words) - width + 1)
    key = np.zeros(n, U)
    for k in range(width):
        key = C.mix(key * U(C.BASE) + words[k : k + n])
    return key


def fingerprints(words: np.ndarray, before: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Places of the kept grams, over all texts at once; only runs inside one text count."""
    keys = gram_keys(words, gram)
    span = window - gram + 1
    n = len(keys) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = keys[:n].copy(), np.arange(n)
    for k in range(1, span):
        other = keys[k : k + n]
        lower = other <= least
        least = np.where(lower, other, least)
        at = np.where(lower, np.arange(k, k + n), at)
    text_end = np.repeat(before[1:], np.diff(before))[:n]
    return np.unique(at[np.arange(n) + window <= text_end])


class Slice:
    """Fingerprints and words of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], window: int, gram: int):
        self.window, self.gram = window, gram
        self.ids = np.array(ids, np.int64)
        self.words, self.before = words_of(pa.array(texts, pa.string()))
        sizes = np.diff(self.before)
        self.item = np.repeat(np.arange(len(ids)), sizes)
        places = fingerprints(self.words, self.before, window, gram)
        keys = gram_keys(self.words, gram)[places]
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, window):
            few = np.flatnonzero(sizes == size)
            if len(few):
                keys = np.array([gram_keys(self.words[self.before[i] : self.before[i + 1]], size)[0] for i in few], U)
                order = np.argsort(keys, kind="stable")
                self.short[size] = keys[order], few[order]

    def pairs(self, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of documents and of items that share a fingerprint."""
        at = fingerprints(words, before, self.window, self.gram)
        return _matches(gram_keys(words, self.gram)[at], at, self.keys, self.places)

    def hits(self, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ranges (start, end) that an item's window covers, and the item of each."""
        owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
        low, high = before[owner] if len(owner) else owner, before[owner + 1] if len(owner) else owner
        place, at = self.pairs(words, before)
        item = self.item[at]
        begin, end = self.before[item], self.before[item + 1]
        reach = self.window - self.gram
        left, right = np.zeros(len(place), np.int64), np.full(len(place), self.gram)
        grown = np.ones(len(place), bool)
        for k in range(1, reach + 1):
            grown &= (place - k >= low[place]) & (at - k >= begin)
            grown &= words[np.maximum(place - k, 0)] == self.words[np.maximum(at - k, 0)]
            left += grown
        grown = np.ones(len(place), bool)
        for k in range(reach + self.gram):
            grown &= (place + k < high[place]) & (at + k < end)
            grown &= words[np.minimum(place + k, len(words) - 1)] == self.words[np.minimum(at + k, len(self.words) - 1)]
            right = np.where(grown, k + 1, np.minimum(right, k))
        whole = (left + right >= self.window) & (right >= self.gram)
        starts, ends, items = [(place - left)[whole]], [(place + right)[whole]], [item[whole]]
        for size, (keys, which) in self.short.items():
            inside = np.flatnonzero(np.arange(len(words)) + size <= high)
            spot, i = _matches(gram_keys(words, size)[inside] if len(inside) else np.zeros(0, U), inside, keys, which)
            starts.append(spot)
            ends.append(spot + size)
            items.append(i)
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(items)


def _matches(keys: np.ndarray, at: np.ndarray, table: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (at, places) of equal keys; ``table`` is sorted."""
    first = np.searchsorted(table, keys, "left")
    counts = np.searchsorted(table, keys, "right") - first
    which = np.flatnonzero(counts)
    counts, first = counts[which], first[which]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(at[which], counts), places[np.repeat(first, counts) + within]


def _search(part: Slice):
    def search(texts):
        words, before = words_of(texts)
        starts, ends, items = part.hits(words, before)
        doc = np.searchsorted(before, starts, "right") - 1
        cover = np.zeros(len(words) + 1, np.int32)
        np.add.at(cover, starts, 1)
        np.add.at(cover, ends, -1)
        hit = np.cumsum(cover[:-1]) > 0
        owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
        edge = owner[1:] != owner[:-1]
        first, last = hit.copy(), hit.copy()
        first[1:] &= ~hit[:-1] | edge
        last[:-1] &= ~hit[1:] | edge
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        spans = pa.StructArray.from_arrays([pa.array(a - before[owner[a]], pa.int64()), pa.array(b - before[owner[a]], pa.int64())], names=["start", "end"])
        pairs = np.unique(np.stack([doc, part.ids[items]], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        return (
            pa.array(np.diff(before), pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(a, before), pa.int32()), spans),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(len(before))), pa.int32()), pa.array(pairs[:, 1], pa.int64())),
        )

    return search


def _merge(first: list, more: list) -> list:
    ranges = sorted((r["start"], r["end"]) for r in [*first, *more])
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def slices(items: DataFrame, id_col: str, text_col: str, slice_bytes: int):
    """The benchmark in pieces of about ``slice_bytes``, one at a time on the driver."""
    rows = items.select(C.named(id_col).cast("long").alias("id"), F.coalesce(C.named(text_col).cast("string"), F.lit("")).alias("text")).filter("id IS NOT NULL AND text <> ''")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / slice_bytes))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).distinct().toArrow()
        yield part.column("id").to_pylist(), part.column("text").to_pylist()


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, slice_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` with a struct ``found`` (``C.free_name`` where they have such a column): n_words, ranges (array of start and end, in words,
    that the benchmark covers) and items (array of the ids found, sorted). With several slices the
    documents and what was found so far are written to the shared folder between them, so that
    no process holds more than one slice."""
    if not 0 < gram <= window:
        raise ValueError("a gram is at most a window")
    rows = docs.select(F.struct("*").alias("_doc"), F.coalesce(C.named(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = T.StructType([*rows.schema.fields, *T._parse_datatype_string(FOUND).fields])
    for k, (ids, texts) in enumerate(slices(items, item_id, item_text, slice_bytes)):
        if k:
            rows = cut(rows)
        rows = rows.mapInArrow(_carrying(Slice(ids, texts, window, gram)), kind)
    return rows.select("_doc.*", F.struct("n_words", "ranges", "items").alias(C.free_name(docs, "found")))


def _carrying(part: Slice):
    """Searches one slice batch by batch; the document, and what earlier slices found, ride along."""
    search = _search(part)

    def run(batches):
        for batch in C.pieces(batches):
            n_words, ranges, items = search(batch.column("_text"))
            if "items" in batch.schema.names:
                ranges = pa.array([_merge(a, b) for a, b in zip(batch.column("ranges").to_pylist(), ranges.to_pylist())], ranges.type)
                items = pa.array([sorted({*a, *b}) for a, b in zip(batch.column("items").to_pylist(), items.to_pylist())], items.type)
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_text"), n_words, ranges, items], names=["_doc", "_text", "n_words", "ranges", "items"])

    return run
