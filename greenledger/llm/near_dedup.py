"""Near-duplicate groups by MinHash and an inverted join over signature coordinates.

1. Every text becomes its set of word shingles and a signature of ``COORDINATES`` minima. Equal sets
   become one class at once, combined before the shuffle.
2. *Prefix.* Two sets that reach the threshold agree, but for a chance under one in a million, on
   ``MATCHES`` coordinates. Hence they share one of any COORDINATES - MATCHES + 1 coordinates that both take
   first in one common order; a class is posted under its rarest ones only, by the count of classes
   that hold a coordinate-value pair.
3. *Skip.* The long lists are not merged: a pair found in a short list is counted by comparing the two
   signatures, and is kept from MATCHES equal coordinates on.
4. *Confirm.* Kept pairs are confirmed on the full sets, read again from the texts.

A list of at most ``CROWD`` classes is expanded into its pairs, at most CROWD / 2 a posting. Longer lists are
never: those that share a class form a family, and the family's sets meet in tiles of at most 2 x ``TILE`` full
sets, compared by products of their membership matrices; a tile returns a forest of links. Both ways compare every
colliding pair, so the components are those of all confirmed links. Work is in proportion to the postings
but for families, where it is the square of the family over TILE. Hot lists, components and groups of copies
are split by salts.

Nulls: a null text, like one without words, has an empty set and is alone. Texts with fewer words
than a shingle have their whole sequence as the one shingle. A null id is the largest id. Rows that share
id and text are one node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from greenledger.llm import common as C
from greenledger.session import written

COORDINATES = 40
CROWD = 64
TILE = 768
COLUMNS = 2048
PACK = 1 << 10  # texts handled together: their number takes 10 bits beside 54 bits of a shingle
U = C.U64
NODE = "struct<id: long, f: long>"
SETS = "_id long, _same long, n long, f1 long, f2 long, sig binary"


def least_matches(threshold: float) -> int:
    """Coordinates that a pair at the threshold shares but for a chance under 1e-6."""
    chance, k = 0.0, -1
    while chance < 1e-6:
        k += 1
        chance += math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k)
    return max(k, 1)


def shingle_sets(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (text, shingle) keys of at most PACK texts without repetition, and where each text begins."""
    data, off = C.text_bytes(column)
    data = C.lower_ascii(data)
    starts, ends, before = C.word_spans(data, off, C.SPACES)
    words = C.word_hashes(data, starts, ends)
    m = len(off) - 1
    counts = np.diff(before)
    n = max(0, len(words) - width + 1)
    key = np.full(n, U(width))
    for k in range(width):
        key = C.mix(key * U(C.BASE) + words[k : k + n])
    owner = np.repeat(np.arange(m), counts)
    whole = np.arange(n) + width <= before[1:][owner[:n]]
    keys, docs = [key[whole]], [owner[:n][whole]]
    for size in range(1, width):
        few = np.flatnonzero(counts == size)
        short = np.full(len(few), U(size))
        for k in range(size):
            short = C.mix(short * U(C.BASE) + words[before[few] + k])
        keys.append(short)
        docs.append(few)
    packed = np.sort((np.concatenate(docs).astype(U) << U(54)) | (np.concatenate(keys) >> U(10)))
    packed = packed[C.runs(packed)[0]]
    return packed, np.searchsorted(packed >> U(54), np.arange(m + 1, dtype=U))


def _small(batches, column: str = "_text"):
    for batch in C.pieces(batches, column):
        for lo in range(0, batch.num_rows, PACK):
            yield batch.slice(lo, PACK)


def signatures(packed: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minima of COORDINATES hash functions over each set; sets must not be empty."""
    s = packed & U((1 << 54) - 1)
    rng = np.random.default_rng(3)
    mult, flip = rng.integers(0, 2**63, COORDINATES, dtype=U) * U(2) + U(1), rng.integers(0, 2**63, COORDINATES, dtype=U)
    out = np.empty((len(begin) - 1, COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((((s ^ flip[k]) * mult[k]) >> U(32)).astype(np.uint32), begin[:-1])
    return out


def _sets(width: int):
    def sets(batches):
        for batch in _small(batches):
            packed, begin = shingle_sets(batch.column("_text"), width)
            n = np.diff(begin)
            full = np.flatnonzero(n)
            one, two, sig = np.zeros(len(n), U), np.zeros(len(n), U), [b""] * len(n)
            if len(full):
                at = np.append(begin[full], begin[-1])
                mixed = C.mix(packed & U((1 << 54) - 1))
                one[full], two[full] = np.add.reduceat(mixed, at[:-1]), np.add.reduceat(C.mix(mixed ^ U(C.BASE)), at[:-1])
                for i, row in zip(full, signatures(packed, at)):
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), batch.column("_same"), pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sig, pa.binary()),
            ], names=["_id", "_same", "n", "f1", "f2", "sig"])

    return sets


def _matrix(column) -> np.ndarray:
    data, _ = C.text_bytes(column)
    return np.frombuffer(data.tobytes(), np.uint32).reshape(-1, COORDINATES)


def _keys(sig: np.ndarray) -> np.ndarray:
    return (np.arange(COORDINATES, dtype=U) << U(32)) | sig


def _postings(batches):
    """Every class under each of its coordinate-value pairs."""
    for batch in batches:
        keys = _keys(_matrix(batch.column("sig")))
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), COORDINATES)))], names=["key", "node"])


def _alike(least: int):
    def alike(batches):
        for batch in batches:
            same = (_matrix(batch.column("sig_a")) == _matrix(batch.column("sig_b"))).sum(1) if batch.num_rows else np.zeros(0, int)
            yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    return alike


def _confirm(width: int, percent: int):
    def confirm(batches):
        for batch in _small((b for x in batches for b in C.pieces([x], "text_b")), "text_a"):
            a, at = shingle_sets(batch.column("text_a"), width)
            b, bt = shingle_sets(batch.column("text_b"), width)
            both = np.bincount((np.intersect1d(a, b, assume_unique=True) >> U(54)).astype(np.int64), minlength=batch.num_rows)
            union = np.diff(at) + np.diff(bt) - both
            yield batch.select(["a", "b"]).filter(pa.array((100 * both >= percent * union) & (both > 0)))

    return confirm


def _full_sets(width: int):
    def full_sets(batches):
        for batch in _small(batches):
            packed, begin = shingle_sets(batch.column("_text"), width)
            body = [C.pack_sorted(packed[i:j] & U((1 << 54) - 1)) for i, j in zip(begin, begin[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(body, pa.binary())], names=["node", "body"])

    return full_sets


def _tile(percent: int):
    """All sets of one or two parts against each other by products of their membership matrices."""
    def tile(key, rows):
        sets = [C.unpack_sorted(x) for x in C.cells(rows, "body")]
        sizes = np.array([len(x) for x in sets])
        order = np.argsort(np.concatenate(sets), kind="stable")
        begin, run = C.runs(np.concatenate(sets)[order])
        column, owner = np.empty(len(order), np.int64), np.repeat(np.arange(len(sets)), sizes)
        column[order] = run
        shared = np.diff(np.append(begin, len(order))) > 1  # what one set alone holds is in no intersection
        number = np.cumsum(shared) - 1
        inside = shared[column]
        column, owner = number[column[inside]], owner[inside]
        by = np.argsort(column, kind="stable")
        column, owner = column[by], owner[by]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(shared.sum()), COLUMNS):
            i, j = np.searchsorted(column, (lo, lo + COLUMNS))
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[owner[i:j], column[i:j] - lo] = 1
            both += part @ part.T
        linked = (100 * both >= percent * (sizes[:, None] + sizes - both)) & (both > 0)
        label, last = np.arange(len(sets)), None
        while last is None or (label != last).any():  # the least number reachable
            last = label
            label = np.array([label[row].min(initial=label[i]) for i, row in enumerate(linked)])
            label = label[label]
        moved = np.flatnonzero(label != np.arange(len(sets)))
        nodes = rows.column("node").combine_chunks()
        return pa.table({"a": nodes.take(pa.array(moved)), "b": nodes.take(pa.array(label[moved]))})

    return tile


class _Groups:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        self.width, self.percent = width, percent
        self.texts = C.intake(docs, id_col, text_col).withColumn("_same", F.xxhash64("_text"))
        self.least = least_matches(percent / 100)
        self.sets = written(self.texts.mapInArrow(_sets(width), SETS))
        first = self.sets.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("_id", "_same")).alias("r"), F.first("sig").alias("sig"))
        self.classes = written(first.select(F.struct(F.col("r._id").alias("id"), F.col("f1").alias("f")).alias("node"), "f1", "f2", "n", F.col("r._same").alias("_same"), "sig"))

    def lists(self) -> DataFrame:
        """Postings (key, node) of every class under the rarest of its coordinate-value pairs, as many as the
        prefix has. Pairs that one class alone holds come first and meet nobody, so they only use up places."""
        posted = self.classes.select("node", "sig").mapInArrow(_postings, f"key long, node {NODE}")
        counted = written(posted.groupBy("key").count().filter("count > 1"))
        shared = C.salted_join(posted, counted.withColumn("n", F.col("count")).drop("count"), ["key"], F.col("node"), counts=counted)
        own = W.partitionBy("node")
        ranked = shared.withColumn("place", F.row_number().over(own.orderBy("n", "key"))).withColumn("held", F.count(F.lit(1)).over(own))
        prefix = COORDINATES - self.least + 1
        return written(ranked.filter(F.col("place") <= prefix - (COORDINATES - F.col("held"))).select("key", "node"))

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """(node, _text): a text of each class."""
        where = self.classes.join(nodes, "node").select("node", F.col("node.id").alias("_id"), "_same")
        text = self.texts.join(where.select("_id", "_same"), ["_id", "_same"], "left_semi").groupBy("_id", "_same").agg(F.first("_text").alias("_text"))
        return where.join(text, ["_id", "_same"]).select("node", "_text")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that agree on enough coordinates and whose full sets reach the threshold."""
        sig = self.classes.select("node", "sig")
        found = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
        counts = written(pairs.groupBy("b").count())
        found = C.salted_join(found, sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), ["b"], F.col("a"), counts=counts)
        near = written(found.select("a", "b", "sig_a", "sig_b").mapInArrow(_alike(self.least), f"a {NODE}, b {NODE}"))
        text = self.texts_of(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct())
        found = near.join(text.select(F.col("node").alias("a"), F.col("_text").alias("text_a")), "a")
        found = C.salted_join(found, text.select(F.col("node").alias("b"), F.col("_text").alias("text_b")), ["b"], F.col("a"), counts=written(near.groupBy("b").count()))
        return written(found.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(self.width, self.percent), f"a {NODE}, b {NODE}"))

    def linked_in_tiles(self, crowded: DataFrame) -> DataFrame:
        """Links (a, b) that connect, within each family of crowded lists, what is linked there.

        Lists that share a class are one family. Its classes are dealt to parts of ``TILE`` and every two parts meet
        in one task with their full sets; a tile gives at most one link per class, not its pairs.
        """
        first = crowded.groupBy("key").agg(F.min("node").alias("b"))
        star = written(C.salted_join(crowded, first, ["key"], F.col("node")).filter("node <> b").select(F.col("node").alias("a"), "b").distinct())
        family = unite(written(crowded.select("node").distinct().withColumn("comp", F.col("node"))), star, apart=True)
        sizes = family.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
        parted = C.salted_join(family, sizes, ["comp"], F.col("node")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        full = written(self.texts_of(family.select("node")).mapInArrow(_full_sets(self.width), f"node {NODE}, body binary"))
        dealt = parted.join(full, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tiles = dealt.select("comp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "body")
        return written(tiles.groupBy("comp", "i", "j").applyInArrow(_tile(self.percent), f"a {NODE}, b {NODE}"))

    def components(self) -> DataFrame:
        """(node, comp): for every class that is posted with another one, the smallest class it is linked with."""
        lists = self.lists()
        sizes = written(lists.groupBy("key").count().filter("count > 1"))
        comp = written(lists.select("node").distinct().withColumn("comp", F.col("node")))
        crowded = written(lists.join(sizes.filter(F.col("count") > CROWD).select("key"), "key"))
        apart = crowded.isEmpty()
        if not apart:
            comp = unite(comp, self.linked_in_tiles(crowded), apart=True)
        thin = written(lists.join(sizes.filter(F.col("count") <= CROWD).select("key"), "key").join(comp, "node"))
        one, two = thin.select("key", F.col("node").alias("a"), F.col("comp").alias("ca")), thin.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"))
        pairs = one.join(two, "key").filter("a > b AND ca <> cb").select("a", "b").distinct()
        return unite(comp, self.linked(written(pairs)), apart)


def unite(comp: DataFrame, links: DataFrame, apart: bool = False) -> DataFrame:
    """Components (node, comp) after adding links (a, b): roots hook to their smallest neighbour, then paths are halved.
    ``apart``: every node is still its own component, so the links are those of roots already."""
    while True:
        if not apart:
            ends = C.salted_join(links, comp.select(F.col("node").alias("b"), F.col("comp").alias("y")), ["b"], F.col("a"))
            ends = ends.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").filter("x <> y").select("x", "y").distinct()
            links = written(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
        apart = False
        if links.isEmpty():
            return comp
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("b")).filter("b < a"))
        while True:
            step = written(hook.alias("h").join(hook.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
            hook = step.select("a", "b")
            if step.filter("moved").isEmpty():
                break
        moved = C.salted_join(comp, hook.select(F.col("a").alias("comp"), F.col("b").alias("to")), ["comp"], F.col("node"), "left")
        comp = written(moved.select("node", F.coalesce("to", "comp").alias("comp")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``_id``, ``_same`` (hash of its text), n_shingles, and component (struct of
    id, the smallest linked id, and f, which tells groups apart when ids repeat; null for an empty set)."""
    groups = _Groups(docs, id_col, text_col, width, percent)
    comp = groups.components()
    classes = groups.classes.select("f1", "f2", "n", "node").join(comp, "node", "left").select("f1", "f2", "n", F.coalesce("comp", "node").alias("component"))
    rows = groups.sets.select("_id", "_same", "n", "f1", "f2")
    found = C.salted_join(rows, classes, ["f1", "f2", "n"], F.struct("_id", "_same"), "left")
    return found.select("_id", "_same", F.col("n").alias("n_shingles"), "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of the smallest id of each group; texts without words all stay."""
    groups = near_groups(docs, id_col, text_col, width, percent)
    chosen = groups.filter("component IS NOT NULL AND _id = component.id").groupBy("component").agg(F.min(F.struct("_id", "_same")).alias("r")).select("r.*")
    rows = docs.select(F.struct("*").alias("_doc"), *C.intake_columns(id_col, text_col)).withColumn("_same", F.xxhash64("_text"))
    stays = chosen.withColumn("_once", F.lit(True)).unionByName(groups.filter("component IS NULL").select("_id", "_same").distinct().withColumn("_once", F.lit(False)))
    kept = rows.join(written(stays), ["_id", "_same"]).select("_doc", "_id", "_same", "_once")
    single = kept.filter("_once").groupBy("_id", "_same").agg(F.first("_doc").alias("_doc")).select("_doc")
    return single.unionByName(kept.filter("NOT _once").select("_doc")).select("_doc.*")
