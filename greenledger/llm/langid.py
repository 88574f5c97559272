"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its byte 2-, 3- and 4-grams (A-Z lower-cased, other ASCII
signs as spaces), hashed into ``BUCKETS`` rows; a linear layer and a softmax give the language. Embeddings
and layer are trained by stochastic gradient descent in numpy on at most ``per_language`` labelled
documents of each label, chosen by a hash of the id. Tasks count their grams, at most BUCKETS numbers a document;
one task fits the model on these counts, and the driver receives the finished table alone. A fifth of the sample is held back to
calibrate a temperature for the probabilities. Beside the languages the model has a class for no language, learned from a
copy of each document whose bytes are shuffled; its share lowers the scores of the languages, so a score can fall
under 1 / languages. Rejection thresholds, one by class of length (``CLASSES`` in grams), part held-back documents
and their first words from shuffled copies of both: of the bounds that cost at most ``LOSS`` of the rightly
predicted texts, the one with the fewest errors, amid the widest gap.

Prediction reads whole texts in one pass without a shuffle; embeddings times layer is one table
of BUCKETS x languages (its size is set by the parameters) that travels with the task.

Nulls: a text that is null or has no letter is ``und`` with score 0 and rejected. Rows with null text
or label are not learned from. A null id counts as the empty text in the hold-out rule. Without any labelled
document every text is ``und``. Equal texts get equal predictions.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from greenledger.llm import common as C

BUCKETS = 1 << 14
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
CLASSES = (16, 64, 256, 1024)  # grams: about 1 word, 4 words, 15 words, a paragraph, more
FIRST = (8, 28, 100)  # bytes of a document's beginning, to calibrate short texts
LOSS = 0.01
COUNTED = "_place long, _same long, _row long, copy int, _lang string, size int, real boolean, which binary, counts binary"
MODEL = "languages array<string>, cells binary, bias binary, thresholds binary"
SALTS = 64
EMBEDDING_RATE = 50  # a gram's share of a text is small, and so is its gradient


def _signs() -> np.ndarray:
    """What each byte reads as: letters lower-cased, bytes over 0x7F as they are, the rest a space."""
    table = np.full(256, 32, np.uint8)
    table[0x61:0x7B] = table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


def gram_rows(data: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """The hash bucket of the gram that begins at each byte; BUCKETS where the text ends before the gram does."""
    codes = np.random.default_rng(5).integers(1, 2**32, 256, dtype=np.uint32)
    read = codes[_signs()[data]]
    n = len(data)
    key = np.zeros(n, np.uint32)
    for k in range(width):
        m = max(n - k, 0)
        key[:m] = (key[:m] ^ read[k : k + m]) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
    out = (key * np.uint32(0x85EBCA6B) >> np.uint32(18)).astype(np.int32)
    for k in range(1, width):  # the last bytes of each text begin no gram
        out[off[1:][np.diff(off) >= k] - k] = BUCKETS
    return out


def has_letter(texts, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))])
    found = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
    for i in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return found


def shuffled(part: np.ndarray) -> np.ndarray:
    """The bytes between spaces in any order, so that lengths of words stay."""
    out = part.copy()
    at = np.flatnonzero(_signs()[part] != 32)
    out[at] = part[np.random.default_rng(zlib.crc32(part.tobytes())).permutation(at)]
    return out


def _beginning(part: np.ndarray, size: int) -> np.ndarray:
    """The whole words of the first ``size`` bytes, or the first word."""
    gaps = np.flatnonzero(_signs()[part] == 32)
    gaps = gaps[gaps > 0]
    k = int(np.searchsorted(gaps, size, "right"))
    return part[: gaps[max(k - 1, 0)]] if len(gaps) and len(part) > size else part


def _counts(batches):
    """Gram counts of each text, of its beginnings and of shuffled copies (``real`` is false), as packed bucket numbers and counts."""
    for batch in C.pieces(batches):
        data, off = C.text_bytes(batch.column("_text"))
        langs, out = batch.column("_lang").to_pylist(), ([], [], [], [], [])
        copies = 2 * (1 + len(FIRST))
        for i in range(batch.num_rows):
            whole = data[off[i] : off[i + 1]]
            for size in (0, *FIRST):
                real = _beginning(whole, size) if size else whole
                for part in (real, shuffled(real)):
                    ends = np.array([0, len(part)])
                    n = np.bincount(np.concatenate([gram_rows(part, ends, w) for w in WIDTHS]), minlength=BUCKETS + 1)[:BUCKETS]
                    at = np.flatnonzero(n)
                    for column, v in zip(out, (langs[i], size, part is real, C.pack_sorted(at.astype(np.uint64)), C.pack(n[at].astype(np.uint64)))):
                        column.append(v)
        kinds = (pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        own = np.repeat(np.arange(batch.num_rows), copies)
        places = [batch.column(name).take(pa.array(own)) for name in ("_place", "_same", "_row")] + [pa.array(np.tile(np.arange(copies), batch.num_rows), pa.int32())]
        yield pa.RecordBatch.from_arrays([*places, *[pa.array(v, t) for v, t in zip(out, kinds)]], names=[field.split(" ")[0] for field in COUNTED.split(", ")])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # (BUCKETS + 1, languages + 1): embedding times layer over temperature; the last row is 0, the last column no language
    bias: np.ndarray
    thresholds: np.ndarray  # by class of length

    def scores(self, data: np.ndarray, off: np.ndarray, positions: int = 1 << 16) -> np.ndarray:
        """Probabilities by text and language; what lacks to 1 is no language."""
        m = len(off) - 1
        total = np.zeros((m, len(self.bias)))
        step = max(1024, positions * 4 // max(4, len(self.bias)))
        for width in WIDTHS:
            rows = gram_rows(data, off, width)
            for lo in range(0, len(rows), step):
                hi = min(lo + step, len(rows))
                first, last = np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, hi, "left")
                texts = np.arange(first, last)
                texts = texts[(np.minimum(off[texts + 1], hi) > np.maximum(off[texts], lo))]
                total[texts] += np.add.reduceat(self.table[rows[lo:hi]], np.maximum(off[texts], lo) - lo, axis=0)
        return softmax(total / np.maximum(grams(off), 1)[:, None] + self.bias)[:, :-1]


def grams(off: np.ndarray) -> np.ndarray:
    return sum(np.maximum(np.diff(off) - w + 1, 0) for w in WIDTHS)


def _threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The bound on scores with the fewest errors among those that cost at most LOSS of the good ones."""
    if not len(good):
        return 0.0
    values = np.unique(np.r_[0.0, good, bad])
    lost, passed = np.searchsorted(np.sort(good), values), len(bad) - np.searchsorted(np.sort(bad), values)  # for a bound at the value
    fits = np.flatnonzero(lost <= LOSS * len(good))
    errors = lost[fits] / len(good) + passed[fits] / max(len(bad), 1)
    best = fits[np.flatnonzero(errors <= errors.min() + 1e-12)]
    gap = values[best] - np.r_[0.0, values][best]
    i = best[int(gap.argmax())]
    return float(values[i] + np.r_[0.0, values][i]) / 2


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def descend(x: np.ndarray, y: np.ndarray, languages: int, dims: int, epochs: int, rate: float, batch: int, seed: int):
    """Embeddings, layer and bias after plain minibatch descent on the cross-entropy. ``x``: list of (buckets, shares)."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, dims)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (dims, languages)).astype(np.float32), np.zeros(languages, np.float32)
    for epoch in range(epochs):
        order, step = rng.permutation(len(y)), rate * (1 - epoch / epochs)
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            dense = np.zeros((len(pick), BUCKETS), np.float32)
            for r, i in enumerate(pick):
                dense[r, x[i][0]] = x[i][1]
            mean = dense @ emb
            miss = softmax(mean @ out + bias).astype(np.float32)
            miss[np.arange(len(pick)), y[pick]] -= 1
            miss /= len(pick)
            back = miss @ out.T
            out -= step * mean.T @ miss
            bias -= step * 0.01 * miss.sum(0)
            emb -= step * EMBEDDING_RATE * dense.T @ back
    return emb, out, bias


def _fit(found: pa.Table, dims: int, epochs: int, rate: float, batch: int, seed: int) -> Model:
    labels = found.column("_lang").to_pylist()
    languages = tuple(sorted(set(labels)))
    at = {v: i for i, v in enumerate(languages)}
    size, real = found.column("size").to_numpy(), found.column("real").to_numpy(zero_copy_only=False)
    own = np.array([at[v] for v in labels])
    y = np.where(real, own, len(languages))
    x, n = [], np.zeros(len(y))
    for i, (which, counts) in enumerate(zip(C.cells(found, "which"), C.cells(found, "counts"))):
        count = C.unpack(counts).astype(np.float32)
        n[i] = count.sum()
        x.append((C.unpack_sorted(which).astype(np.int64), count / max(n[i], 1)))
    doc = np.cumsum((size == 0) & real) - 1  # a document's copies follow it
    held = doc % 5 == 4
    if doc[-1] + 1 < 20:
        held[:] = False
    train = np.flatnonzero(~held & (size == 0))
    emb, out, bias = descend([x[i] for i in train], y[train], len(languages) + 1, dims, epochs, rate, batch, seed)
    table = (emb @ out).astype(np.float64)
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    logits = np.stack([(table[x[i][0]] * x[i][1][:, None]).sum(0) + bias for i in check])
    whole = size[check] == 0
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(logits[whole] / t)[np.arange(whole.sum()), y[check][whole]], 1e-12)).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = softmax(logits / heat)[:, :-1]
    score, right = p.max(1), real[check] & (p.argmax(1) == own[check])
    group = np.searchsorted(CLASSES, n[check], "right")
    thresholds = np.array([_threshold(score[right & (group == k)], score[~real[check] & (group == k)]) for k in range(len(CLASSES) + 1)])
    return Model(languages, np.vstack([table / heat, np.zeros((1, len(languages) + 1))]).astype(np.float32), bias / heat, thresholds)


def _fitted(dims: int, epochs: int, rate: float, batch: int, seed: int):
    """The whole sample to a model, as one row; no row without a sample."""

    def fitted(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        model = _fit(pa.Table.from_batches(batches), dims, epochs, rate, batch, seed)
        cells = [[list(model.languages)], *[[x.astype(np.float64).tobytes()] for x in (model.table, model.bias, model.thresholds)]]
        kinds = [pa.list_(pa.string()), *[pa.binary()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["languages", "cells", "bias", "thresholds"])

    return fitted


def train(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 600, dims: int = 16, epochs: int = 6, rate: float = 2.0, batch: int = 32, seed: int = 1) -> Model | None:
    """A model from the labelled rows for which ``learn`` holds (by default all)."""
    rows = docs.select(*C.intake_columns(id_col, text_col), C.named(label_col).cast("string").alias("_lang"), (F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)).alias("_learn"))
    rows = rows.filter("_learn AND _lang IS NOT NULL").filter(F.col("_text").rlike(r"\p{L}"))
    place, cut = F.xxhash64("_id", "_lang"), rows.select("_lang", F.xxhash64("_id", "_lang").alias("_place"))
    for keys in ([F.col("_lang"), F.pmod("_place", F.lit(SALTS))], [F.col("_lang")]):  # the least places of a label, in two steps
        cut = cut.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_place"))).filter(F.col("_n") <= per_language)
    limits = cut.groupBy("_lang").agg(F.max("_place").alias("_last"))  # a row per label
    chosen = rows.withColumn("_place", place).join(F.broadcast(limits), "_lang").filter("_place <= _last")
    chosen = chosen.select("_place", F.xxhash64("_text").alias("_same"), F.monotonically_increasing_id().alias("_row"), "_lang", "_text")
    counted = chosen.mapInArrow(_counts, COUNTED).repartition(1).sortWithinPartitions("_place", "_same", "_row", "copy")
    found = counted.mapInArrow(_fitted(dims, epochs, rate, batch, seed), MODEL).first()
    if found is None:
        return None
    bias = np.frombuffer(found["bias"])
    return Model(tuple(found["languages"]), np.frombuffer(found["cells"]).reshape(-1, len(bias)).astype(np.float32), bias, np.frombuffer(found["thresholds"]))


def _predict(model: Model | None):
    def predict(batches):
        for batch in C.pieces(batches):
            texts = batch.column("_text")
            data, off = C.text_bytes(texts)
            known = has_letter(texts, data, off) if model else np.zeros(batch.num_rows, bool)
            if model:
                p = model.scores(data, off)
                best = p.argmax(1)
                names = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
                score = np.where(known, p[np.arange(len(best)), best], 0.0)
            else:
                names, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            rejected = ~known | (score < (model.thresholds[np.searchsorted(CLASSES, grams(off), "right")] if model else 1))
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(rejected)], names=["_doc", "lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a struct ``language`` (``C.free_name`` where they have such a column): lang_pred, score (0 to 1) and rejected."""
    rows = docs.select(F.struct("*").alias("_doc"), F.coalesce(C.named(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = T.StructType([rows.schema["_doc"], *T._parse_datatype_string("lang_pred string, score double, rejected boolean").fields])
    return rows.mapInArrow(_predict(model), kind).select("_doc.*", F.struct("lang_pred", "score", "rejected").alias(C.free_name(docs, "language")))
