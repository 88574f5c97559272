"""Ranked lexical search: the best documents for each item of a query set, by integer scores.

The index is cut by documents: a task turns a few megabytes of text into one block with a posting list
per term (documents in order, and how often each holds the term), packed and written to the shared folder. Any query set can
be asked of it afterwards.

A block is searched by a hybrid of two ways. Short lists are taken a term at a time: their scores are summed into
accumulators, kept in document order, which then count as one list whose bound is the greatest sum. This
list and the long ones are walked a document at a time, in windows of documents, greatest bound first: once the k-th best
score so far is known, the lists whose bounds together stay below it propose no documents any more; they are only
probed, by skipping to the documents that the others propose, and a document is dropped as soon as what it has plus the bounds of
the lists left stays below. Only strictly less is dropped, so ties are whole. A task carries its best k of every item from block
to block, and emits at most k rows an item.

Scores are 64-bit integers: weight ``floor(1000 ln((2N+2)/(2df+1)))`` of each different term of the item, times
``(1000000000 tf) div (1000 tf + 20 m)``, m being ``50 + (50 n N) div L``. N, L and df cover all documents.
Terms are the matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, compared by 64-bit hashes.

The items are a stated query set: they are measured and cut into slices of at most ``slice_bytes`` of text, each of which
goes to every task.

Nulls: a null text has no terms; a null document id is the largest and comes back as null; a null item id is no item. Items that
share an id are one item with the terms of all its texts. Repeated documents count and rank as often as they stand there.
Equal scores go by ascending id. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from greenledger.llm import common as C
from greenledger.llm.winnowing import slices, words_of
from greenledger.session import written

INDEX = "n_docs long, n_terms long, ids binary, sizes binary, terms binary, lengths binary, places binary, tfs binary"
HITS = "item_id long, _id long, score long"
WINDOW_DOCS = 2048
SALTS = 64
U = C.U64


# --- the index -------------------------------------------------------------------

def _index(block_bytes: int):
    names = [field.split(" ")[0] for field in INDEX.split(", ")]

    def index(batches):
        for batch in C.pieces(batches, limit=block_bytes):
            words, before = words_of(batch.column("_text"))
            m, sizes = batch.num_rows, np.diff(before)
            order = np.argsort(words, kind="stable")
            begin, run = C.runs(words[order])
            place = run * m + np.repeat(np.arange(m), sizes)[order]  # list and document as one ascending number
            first, _ = C.runs(place)
            tfs, lists = np.diff(first, append=len(place)), run[first]
            row = [
                int((sizes > 0).sum()), int(len(words)), C.pack(batch.column("_id").to_numpy().view(np.uint64)), C.pack(sizes.astype(U)), C.pack_sorted(words[order][begin]),
                C.pack(np.bincount(lists, minlength=len(begin)).astype(U)), C.pack_sorted(place[first].astype(U)), C.pack(tfs.astype(U)),
            ]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names=names)

    return index


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """Posting lists of all terms of all documents, one row per block, in the shared folder."""
    return written(C.intake(docs, id_col, text_col).mapInArrow(_index(block_bytes), INDEX))


class Block:
    """One block of the index; lists are decoded when they are asked for."""

    def __init__(self, row: dict):
        self.ids = C.unpack(row["ids"]).view(np.int64)
        self.sizes = C.unpack(row["sizes"]).astype(np.int64)
        self.terms = C.unpack_sorted(row["terms"])
        self.ends = np.concatenate([[0], np.cumsum(C.unpack(row["lengths"]).astype(np.int64))])
        self.places, self.tfs = C.unpack_sorted(row["places"]).astype(np.int64), C.unpack(row["tfs"]).astype(np.int64)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term's list, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ends[i], self.ends[i + 1]
        return self.places[a:b] - i * len(self.ids), self.tfs[a:b]


# --- the hybrid ------------------------------------------------------------------

class Best:
    """The k best (score, id) of one item so far. ``floor``: a score below it can't enter."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.floor = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.floor = int(self.scores[-1])


class Walk:
    """A list in document order with its greatest score, and how far it has been read."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray):
        self.docs, self.scores, self.bound, self.at = docs, scores, int(scores.max()), 0

    def window(self, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings from the place read so far to document ``high``."""
        end = self.at + int(np.searchsorted(self.docs[self.at :], high))
        part = slice(self.at, end)
        self.at = end
        return self.docs[part], self.scores[part]

    def probe(self, docs: np.ndarray) -> np.ndarray:
        """Scores of the given documents, zero where the list has none, by skipping to each."""
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[at] == docs, self.scores[at], 0)


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the summed scores of some lists, in document order."""
    docs, scores = np.concatenate([d for d, _ in lists]), np.concatenate([s for _, s in lists])
    order = np.argsort(docs, kind="stable")
    begin, _ = C.runs(docs[order])
    return docs[order][begin], np.add.reduceat(scores[order], begin)


def search_block(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, best: Best, short: int, window: int = WINDOW_DOCS) -> None:
    """Put a block's documents into ``best``. ``lists``: documents and scores of each term; at most ``short`` postings are a short list."""
    few = [x for x in lists if len(x[0]) <= short]
    walks = [Walk(*x) for x in lists if len(x[0]) > short] + ([Walk(*accumulate(few))] if few else [])
    walks.sort(key=lambda w: -w.bound)
    rest = np.cumsum([w.bound for w in walks][::-1])[::-1].tolist() + [0]  # what the lists from here on can add
    sums = np.zeros(window, np.int64)
    for low in range(0, len(ids), window):
        asked = next((i for i in range(len(walks) + 1) if rest[i] < best.floor), len(walks))
        if not asked:
            return
        for walk in walks[:asked]:
            walk.at = max(walk.at, int(np.searchsorted(walk.docs, low)))
            docs, scores = walk.window(low + window)
            sums[docs - low] += scores
        found = np.flatnonzero(sums)
        have = sums[found]
        sums[found] = 0
        for i in range(asked, len(walks)):
            keep = have + rest[i] >= best.floor
            found, have = found[keep], have[keep]
            if not len(found):
                break
            have = have + walks[i].probe(found + low)
        keep = have >= best.floor
        if keep.any():
            best.add(have[keep], ids[found[keep] + low])


class Items:
    """The query set, or a slice of it: terms of each item, all terms, and their weights."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, before = words_of(pa.array(texts, pa.string()))
        terms = defaultdict(list)
        for i, item in enumerate(ids):
            terms[item].append(words[before[i] : before[i + 1]])
        self.ids = sorted(terms)
        self.terms = np.unique(words)
        each = {item: np.unique(np.concatenate(parts)) for item, parts in terms.items()}
        self.places = [np.searchsorted(self.terms, each[item]) for item in self.ids]
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, found: dict[int, int], n: int) -> None:
        """``found``: documents holding each term, by the hash as a signed number."""
        df = [found.get(t, 0) for t in self.terms.view(np.int64).tolist()]
        self.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df], np.int64)


def _held(terms: np.ndarray):
    def held(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                at = block.find(terms)
                total[at >= 0] += np.diff(block.ends)[at[at >= 0]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[seen].view(np.int64)), pa.array(total[seen], pa.int64())], names=["term", "df"])

    return held


def _search(items: Items, n: int, length: int, k: int, short_part: int):
    def search(batches):
        best = [Best(k) for _ in items.ids]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                m = 50 + (50 * block.sizes * n) // length
                at = block.find(items.terms)
                lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for t in np.flatnonzero(at >= 0).tolist():
                    docs, tf = block.postings(at[t])
                    lists[t] = docs, items.weights[t] * ((1000000000 * tf) // (1000 * tf + 20 * m[docs]))
                for item, places in zip(best, items.places):
                    mine = [lists[t] for t in places.tolist() if t in lists and items.weights[t] > 0]
                    if mine:
                        search_block(mine, block.ids, item, max(1, len(block.ids) // short_part))
        rows = [np.repeat(np.array(items.ids, np.int64), [len(b.ids) for b in best])] + [np.concatenate([getattr(b, a) for b in best] or [np.zeros(0, np.int64)]) for a in ("ids", "scores")]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["item_id", "_id", "score"])

    return search


def search(index: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", short_part: int = 32, slice_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank from 1, ``_id`` and score of the k best documents of each item. A list is short when it holds at most
    one in ``short_part`` of a block's documents."""
    n, length = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    found = None
    for ids, texts in slices(queries, id_col, text_col, slice_bytes) if length else ():
        items = Items(ids, texts)
        if not len(items.terms):
            continue
        df = index.mapInArrow(_held(items.terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        items.weigh(dict(zip(df.column("term").to_pylist(), df.column("df").to_pylist())), n)
        part = index.mapInArrow(_search(items, n, length, k, short_part), HITS)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], HITS)
    order = [F.desc("score"), F.asc("_id")]
    first = Window.partitionBy("item_id", F.pmod(F.xxhash64("_id"), F.lit(SALTS))).orderBy(*order)  # an item's rows from all tasks meet in two steps
    kept = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k).select("item_id", "rank", "_id", "score")
