"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``order``, with counts from all training documents.
A symbol is coded at the longest context seen in training: a symbol seen there has the share
count / (total + distinct); an unseen one pays the escape distinct / (total + distinct) and is
coded at the context one byte shorter, where every symbol of the longer context is excluded
from counts, total and distinct. Below the empty context the symbols never seen share evenly.
The symbols are 256 bytes; a document is read after ``order`` bytes 0xFE and closed by 0xFF, neither
of which occurs in UTF-8, so the document's score is a whole probability.

Blocks of documents ask shards for the code length of each distinct context-and-symbol, and for
the count of each distinct word. A shard holds all contexts that end in its byte pairs, hence every
chain of suffixes down to two bytes; the contexts of one byte and of none are a table of 256 x 256
counts that every shard receives. Nothing else is sent everywhere, and the counts, which grow
with the corpus, stay spread.

Nulls: a null text is empty and scores its closing symbol alone; a null id counts as the empty text
in the hold-out rule and as the largest id. Repeated rows are scored and learned each time. Without
training documents every symbol costs log10(256).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from greenledger.llm import common as C

PAD, END = 0xFE, 0xFF
ASKED = "_shard int, _blk long, grams binary, gram_counts binary, words binary, word_counts binary"
ANSWER = "_blk long, _shard int, costs binary, counts binary, tokens long, distinct long"
SCORES = "_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
U = C.U64


def _symbols(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every byte and closing mark, nearest context byte first; and the document of each."""
    m, n = len(off) - 1, len(data)
    doc = np.repeat(np.arange(m, dtype=np.int64), np.diff(off))
    line = np.full(n + m * (order + 1), PAD, np.uint8)
    line[np.arange(n) + (doc + 1) * order + doc] = data
    ends = off[1:] + np.arange(1, m + 1) * (order + 1) - 1
    line[ends] = END
    real = np.ones(len(line), bool)
    begins = ends + 1 - np.diff(off) - (order + 1)
    for k in range(order):
        real[begins + k] = False
    at = np.flatnonzero(real)
    grams = np.zeros(len(at), U)
    for k in range(1, order + 1):
        grams = (grams << U(8)) | line[at - k]
    owner = np.repeat(np.arange(m), np.diff(off) + 1)
    return (grams << U(8)) | line[at], owner


def _pair_table(bits: int) -> np.ndarray:
    return (C.mix(np.arange(65536, dtype=U)) >> U(64 - bits)).astype(np.int64)


def _shard_of_grams(grams: np.ndarray, order: int, bits: int) -> np.ndarray:
    return _pair_table(bits)[(grams >> U(8 * (order - 1))).astype(np.int64)]


def _words(data: np.ndarray, off: np.ndarray):
    data = C.lower_ascii(data)
    starts, ends, before = C.word_spans(data, off, C.SPACES)
    order, keys = C.ordered(C.word_hashes(data, starts, ends))
    return order, keys, *C.runs(keys), np.repeat(np.arange(len(off) - 1), np.diff(before))


def _summed(run: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(run, weights, n).astype(U)


def _ask(order: int, bits: int):
    def ask(key, block):
        data, off, _, learned = C.unbundle(block)
        grams, owner = _symbols(data, off, order)
        flagged = np.sort((grams << U(1)) | learned[owner])
        begin, run = C.runs(flagged >> U(1))
        counts, grams = _summed(run, flagged & U(1), len(begin)), flagged[begin] >> U(1)
        shard = _shard_of_grams(grams, order, bits)
        by = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[by], np.arange((1 << bits) + 1))
        place, words, wbegin, wrun, wowner = _words(data, off)
        wcounts, words = _summed(wrun, learned[wowner[place]], len(wbegin)), words[wbegin]
        wcut = np.searchsorted(words >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
        n = 1 << bits
        return pa.table({
            "_shard": pa.array(range(n), pa.int32()),
            "_blk": pa.array([key[0].as_py()] * n, pa.int64()),
            "grams": pa.array([C.pack_sorted(grams[by[cut[s] : cut[s + 1]]]) for s in range(n)], pa.binary()),
            "gram_counts": pa.array([C.pack(counts[by[cut[s] : cut[s + 1]]]) for s in range(n)], pa.binary()),
            "words": pa.array([C.pack_sorted(words[wcut[s] : wcut[s + 1]]) for s in range(n)], pa.binary()),
            "word_counts": pa.array([C.pack(wcounts[wcut[s] : wcut[s + 1]]) for s in range(n)], pa.binary()),
        })

    return ask


class Level:
    """Contexts of one length: counts by (context, symbol), and total and distinct symbols by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        begin, run = C.runs(keys >> U(8))
        self.contexts, self.run = keys[begin] >> U(8), run
        self.total = np.bincount(run, counts, len(begin))
        self.distinct = np.bincount(run, minlength=len(begin)).astype(float)
        self.excluded = np.zeros(len(begin))

    def place(self, contexts: np.ndarray) -> np.ndarray:
        return _find(self.contexts, contexts)

    def count(self, keys: np.ndarray) -> np.ndarray:
        at = _find(self.keys, keys)
        return np.where(at >= 0, self.counts[at] if len(self.counts) else 0.0, 0.0)

    def shorter(self) -> Level:
        """The trie one byte nearer the root; the farthest context byte is dropped."""
        order, keys = C.ordered(_drop(self.keys))
        begin, run = C.runs(keys)
        return Level(keys[begin], np.bincount(run, self.counts[order], len(begin)))

    def exclude_from(self, below: Level) -> None:
        """How much of the shorter context each context's symbols take away there."""
        self.excluded = np.bincount(self.run, below.count(_drop(self.keys)), len(self.contexts))


def _drop(keys: np.ndarray) -> np.ndarray:
    """(context, symbol) without the farthest byte of the context."""
    return ((keys >> U(16)) << U(8)) | (keys & U(255))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def trie(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> list[Level]:
    """Levels by context length, 0 to order. ``pairs``: 256 x 256 counts of byte and next symbol, over the whole corpus."""
    levels = [Level(grams, counts.astype(float))]
    while len(levels) < order - 1:
        levels.append(levels[-1].shorter())
    flat = np.flatnonzero(pairs)
    levels.append(Level(flat.astype(U), pairs.reshape(-1)[flat].astype(float)))
    levels.append(levels[-1].shorter())
    levels.reverse()
    for k in range(1, order + 1):
        levels[k].exclude_from(levels[k - 1])
    return levels


def code_lengths(levels: list[Level], grams: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's symbol after its context."""
    order = len(levels) - 1
    cost, done, above = np.zeros(len(grams)), np.zeros(len(grams), bool), np.full(len(grams), -1)
    symbol = grams & U(255)
    for k in range(order, -1, -1):
        level = levels[k]
        context = grams >> U(8 * (order - k + 1)) if k else np.zeros(len(grams), U)
        at = level.place(context)
        count = level.count((context << U(8)) | symbol)
        if len(level.contexts):
            held, gone = np.zeros(len(grams)), np.zeros(len(grams))
            if k < order and len(levels[k + 1].contexts):
                held = np.where(above >= 0, levels[k + 1].excluded[above], 0.0)
                gone = np.where(above >= 0, levels[k + 1].distinct[above], 0.0)
            escape = level.distinct[at] - gone
            whole = level.total[at] - held + escape
            live = ~done & (at >= 0)
            seen = live & (count > 0)
            cost[seen] += np.log10(count[seen] / whole[seen])
            left = live & ~seen & (whole > 0)
            cost[left] += np.log10(escape[left] / whole[left])
            done |= seen
        above = at
    unused = 256 - (levels[0].distinct[0] if len(levels[0].contexts) else 0)
    cost[~done] -= np.log10(max(unused, 1))
    return cost


def _answer(order: int, pairs: np.ndarray):
    def answer(key, rows):
        lists = [C.unpack_sorted(x) for x in C.cells(rows, "grams")]
        counts = [C.unpack(x) for x in C.cells(rows, "gram_counts")]
        place, keys = C.ordered(np.concatenate(lists), 8 * (order + 1))
        begin, run = C.runs(keys)
        grams, total = keys[begin], _summed(run, np.concatenate(counts)[place], len(begin))
        learned = total > 0
        cost = code_lengths(trie(grams[learned], total[learned], pairs, order), grams).astype(np.float32)
        costs = np.empty(len(keys), np.float32)
        costs[place] = cost[run]
        words = [C.unpack_sorted(x) for x in C.cells(rows, "words")]
        wplace, wkeys = C.ordered(np.concatenate(words))
        wbegin, wrun = C.runs(wkeys)
        known = _summed(wrun, np.concatenate([C.unpack(x) for x in C.cells(rows, "word_counts")])[wplace], len(wbegin))
        found = np.empty(len(wkeys), U)
        found[wplace] = known[wrun]
        out, lo, wlo = [], 0, 0
        for blk, g, w in zip(C.cells(rows, "_blk"), lists, words):
            out.append((blk, C.pack(costs[lo : lo + len(g)].view(np.uint32)), C.pack(found[wlo : wlo + len(w)])))
            lo, wlo = lo + len(g), wlo + len(w)
        n = len(out)
        return pa.table({
            "_blk": pa.array([x[0] for x in out], pa.int64()),
            "_shard": pa.array([key[0].as_py()] * n, pa.int32()),
            "costs": pa.array([x[1] for x in out], pa.binary()),
            "counts": pa.array([x[2] for x in out], pa.binary()),
            "tokens": pa.array([int(known.sum())] * n, pa.int64()),
            "distinct": pa.array([int((known > 0).sum())] * n, pa.int64()),
        })

    return answer


def _score(order: int, bits: int, ends: int):
    def score(key, block, answers):
        answers = answers.take(pc.sort_indices(answers.column("_shard")))
        data, off, ids, _ = C.unbundle(block)
        m = len(off) - 1
        grams, owner = _symbols(data, off, order)
        place, grams = C.ordered(grams, 8 * (order + 1))
        begin, run = C.runs(grams)
        by = np.argsort(_shard_of_grams(grams[begin], order, bits), kind="stable")
        cost = np.empty(len(begin))
        cost[by] = np.concatenate([C.unpack(x, np.uint32).view(np.float32) for x in C.cells(answers, "costs")])
        total = np.bincount(owner[place], cost[run], m)
        wplace, words, wbegin, wrun, wowner = _words(data, off)
        counts = np.concatenate([C.unpack(x) for x in C.cells(answers, "counts")])[wrun].astype(float)
        docs = wowner[wplace]
        n_tokens = np.bincount(docs, minlength=m) + 1
        train = int(np.sum(C.cells(answers, "tokens"))) + ends
        vocabulary = int(np.sum(C.cells(answers, "distinct"))) + (ends > 0)
        base = np.bincount(docs, np.log10(counts + 0.1), m) + np.log10(ends + 0.1) - n_tokens * np.log10(train + 0.1 * (vocabulary + 1))
        return pa.table({
            "_id": pa.array(ids),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(np.bincount(docs, counts > 0, m).astype(np.int64) + (ends > 0), pa.int64()),
            "train_tokens": pa.array([train] * m, pa.int64()),
            "base_score": pa.array(base),
            "score": pa.array(total),
        })

    return score


def _pairs(batches):
    total = np.zeros(65536, np.int64)
    for batch in C.pieces(batches):
        data, off = C.text_bytes(batch.column("_text"))
        grams, _ = _symbols(data, off, 1)
        total += np.bincount(grams.astype(np.int64), minlength=65536)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["pair", "n"])


def byte_pairs(rows: DataFrame) -> np.ndarray:
    """Counts of byte and next symbol over the training texts: 65,536 numbers whatever the corpus."""
    found = rows.filter("_flag").select("_text").mapInArrow(_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(65536, np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(256, 256)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, order: int = 4, block_bytes: int = 4 << 20) -> DataFrame:
    """``_id``, n_tokens, n_known, train_tokens, base_score (smoothed word frequencies) and score (this
    model), for every document. ``train``: which rows to learn from, by default all; null is no."""
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    flag = F.coalesce(train, F.lit(False)) if train is not None else F.lit(True)
    flagged = docs.select(*C.intake_columns(id_col, text_col), flag.alias("_flag"))
    pairs = byte_pairs(flagged)
    bits = C.shard_bits(docs)
    blocks = C.in_blocks(flagged, block_bytes)
    answers = blocks.groupBy("_blk").applyInArrow(_ask(order, bits), ASKED).groupBy("_shard").applyInArrow(_answer(order, pairs), ANSWER)
    return blocks.groupBy("_blk").cogroup(answers.groupBy("_blk")).applyInArrow(_score(order, bits, int(pairs[:, END].sum())), SCORES)
