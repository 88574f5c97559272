"""Incremental line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys of at least
``min_chars`` code points count, identified by 128 bits of hash. The index has three tables:

* ``refs``: one row per (key, document) with the number of lines: the exact counts.
* ``filters``: one cuckoo filter per shard of keys, over all keys in ``refs``.
* ``repeated``: keys of at least two documents, and the smallest id that holds each.

``insert`` reduces a batch to distinct keys (combined before the shuffle, so a line of a third of
all documents is one row per task) and probes the filter of each shard. A key that the filter does
not know and that one document of the batch holds is new: it enters the filter and the exact tables
are not read for it. Only the others are looked up in ``refs``. ``delete`` takes a document's
references out, recounts the keys it touched, and takes keys without references out of the filters,
so an insertion followed by its deletion leaves the index as it was.

``clean`` drops the lines of repeated keys everywhere but in the smallest id. Keys that more than a
thousandth of all references name (at most a thousand) are joined apart, by broadcast.

Nulls: a null or empty text is one empty line; a null id counts as the largest id, and all such
rows as one document; so do rows that share an id. Empty tables give an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from greenledger.llm import common as C
from greenledger.llm.cuckoo import CuckooFilter
from greenledger.session import cut

REFS = "_id long, _same long, k1 long, k2 long, n int"
FILTERS = "shard int, body binary"
REPEATED = "k1 long, k2 long, first long"
PROBED = "shard int, k1 long, k2 long, first long, last long, known boolean, body binary"
HOT_SHARE = 1000
U = C.U64


def line_keys(column, min_chars: int):
    """All lines of all texts: where each begins and ends, its text, and its two hashes; ``counted``: long enough for a key."""
    data, off = C.text_bytes(column)
    breaks = np.flatnonzero(data == 10)
    m = len(off) - 1
    begins = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, off[1:]]), kind="stable")
    owner = np.repeat(np.arange(m), np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1)
    solid = np.flatnonzero(~C.SPACES[data])
    first, last = np.searchsorted(solid, begins), np.searchsorted(solid, ends)
    filled = first < last
    a = np.where(filled, solid[np.minimum(first, len(solid) - 1)] if len(solid) else 0, 0)
    b = np.where(filled, solid[np.maximum(last - 1, 0)] + 1 if len(solid) else 0, 0)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    counted = np.flatnonzero(chars[b] - chars[a] >= max(1, min_chars))
    lowered = C.lower_ascii(data)
    one = C.word_hashes(lowered, a[counted], b[counted])
    two = C.word_hashes(lowered[::1] ^ np.uint8(0xA5), a[counted], b[counted])
    return data, begins, ends, owner, counted, one, C.mix(two + U(C.BASE))


def _references(min_chars: int):
    def references(batches):
        for batch in C.pieces(batches):
            _, _, _, owner, counted, one, two = line_keys(batch.column("_text"), min_chars)
            doc = owner[counted]
            order = np.lexsort((two, one, doc))
            doc, one, two = doc[order], one[order], two[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(doc)))
            yield pa.RecordBatch.from_arrays([
                batch.column("_id").take(pa.array(doc[at])), batch.column("_same").take(pa.array(doc[at])),
                pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), pa.array(n, pa.int32()),
            ], names=["_id", "_same", "k1", "k2", "n"])

    return references


def _probe(expected_only: bool):
    """Distinct keys of a shard against its filter: new keys enter it; a row for each key that needs the exact tables."""
    def probe(key, keys, filters):
        bodies = C.cells(filters, "body")
        held = CuckooFilter.from_bytes(bodies[0]) if bodies else CuckooFilter(keys.num_rows)
        hashes = keys.column("k1").to_numpy().view(U)
        known = held.contains(hashes)
        held.insert(hashes[~known] if not expected_only else hashes)
        needed = known | (keys.column("first").to_numpy() != keys.column("last").to_numpy()) if not expected_only else np.zeros(len(hashes), bool)
        shard = key[0].as_py()
        at = np.flatnonzero(needed)
        part = keys.take(pa.array(at))
        state = {"shard": [shard], "k1": [None], "k2": [None], "first": [None], "last": [None], "known": [None], "body": [held.to_bytes()]}
        schema = pa.schema([("shard", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("known", pa.bool_()), ("body", pa.binary())])
        rows = pa.table([pa.array([shard] * len(at), pa.int32()), part.column("k1"), part.column("k2"), part.column("first"), part.column("last"), pa.array(known[at]), pa.nulls(len(at), pa.binary())], schema=schema)
        return pa.concat_tables([rows, pa.table(state, schema=schema)])

    return probe


def _forget(key, keys, filters):
    bodies = C.cells(filters, "body")
    if not bodies:
        return pa.table({"shard": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
    held = CuckooFilter.from_bytes(bodies[0])
    held.delete(keys.column("k1").to_numpy().view(U))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([held.to_bytes()], pa.binary())})


def _kept_lines(min_chars: int):
    def kept_lines(batches):
        for batch in C.pieces(batches):
            data, begins, ends, owner, counted, one, two = line_keys(batch.column("_text"), min_chars)
            drops = batch.column("_drops")
            keep = np.ones(len(begins), bool)
            doc = owner[counted]
            flat = drops.flatten()
            if len(flat):
                listed = np.repeat(np.arange(batch.num_rows), np.diff(drops.offsets.to_numpy()))
                gone = set(zip(listed.tolist(), flat.field(0).to_pylist(), flat.field(1).to_pylist()))
                busy = np.flatnonzero(np.isin(doc, np.unique(listed)))
                keys = zip(doc[busy].tolist(), one[busy].view(np.int64).tolist(), two[busy].view(np.int64).tolist())
                keep[counted[busy]] = [k not in gone for k in keys]
            m = batch.num_rows
            n_lines = np.bincount(owner, minlength=m)
            dropped = np.bincount(owner[~keep], minlength=m)
            # a kept line takes its line break along, but for the last kept one of a text
            tail = np.zeros(len(begins), bool)
            kept = np.flatnonzero(keep)
            tail[kept[np.append(np.flatnonzero(np.diff(owner[kept])), len(kept) - 1)] if len(kept) else kept] = True
            marks = np.zeros(len(data) + 1, np.int32)
            span = keep & (ends + ~tail > begins)
            np.add.at(marks, begins[span], 1)
            np.add.at(marks, (ends + ~tail)[span], -1)
            mask = np.cumsum(marks[:-1]) > 0
            sizes = np.bincount(owner[keep], (ends - begins + ~tail)[keep], m).astype(np.int64)
            # the line break behind the last line of a text does not exist
            text = C.binaries(data[mask], np.concatenate([[0], np.cumsum(sizes)])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), text, pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64())], names=["_doc", "_kept", "n_lines", "n_dropped"])

    return kept_lines


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new attribute ids, for cogroups of tables with common ancestors."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame
    filters: DataFrame
    repeated: DataFrame
    bits: int
    min_chars: int = 10
    blank: bool = True

    @classmethod
    def empty(cls, spark: SparkSession, min_chars: int = 10, shards: int | None = None) -> LineIndex:
        """Shards: by default at least as many as shuffle partitions; fixed for the life of the index."""
        bits = max(0, (shards or int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length()
        return cls(spark.createDataFrame([], REFS), spark.createDataFrame([], FILTERS), spark.createDataFrame([], REPEATED), bits, min_chars)

    def _shard(self):
        return F.shiftrightunsigned("k2", 64 - self.bits).cast("int") if self.bits else F.lit(0)

    def references(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        rows = C.intake(docs, id_col, text_col)
        return rows.withColumn("_same", F.xxhash64("_text")).mapInArrow(_references(self.min_chars), REFS)

    @staticmethod
    def _counted(refs: DataFrame) -> DataFrame:
        return refs.groupBy("k1", "k2").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with these documents too. Their ids must be new to it."""
        added = cut(self.references(docs, id_col, text_col))
        keys = self._counted(added).withColumn("shard", self._shard())
        probed = cut(keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_probe(False), PROBED))
        filters = probed.filter("body IS NOT NULL").select("shard", "body")
        found = probed.filter("body IS NULL")
        if self.blank:
            return replace(self, refs=added, filters=filters, repeated=found.filter("first < last").select("k1", "k2", "first"), blank=False)
        untouched = self.filters.join(filters, "shard", "left_anti")
        filters = filters.unionByName(untouched)
        old = self.refs.join(found.select("k1", "k2"), ["k1", "k2"], "left_semi")
        mistaken = cut(found.filter("known").join(old.select("k1", "k2"), ["k1", "k2"], "left_anti").select("shard", "k1", "k2", "first", "last"))
        late = _fresh(mistaken).groupBy("shard").cogroup(filters.join(mistaken.select("shard").distinct(), "shard", "left_semi").groupBy("shard")).applyInArrow(_probe(True), PROBED).select("shard", "body")
        filters = cut(late.unionByName(filters.join(mistaken.select("shard").distinct(), "shard", "left_anti")))
        counted = self._counted(old.select("k1", "k2", "_id").unionByName(added.join(found.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "_id")))
        repeated = counted.filter("first < last").select("k1", "k2", "first")
        repeated = cut(repeated.unionByName(self.repeated.join(found.select("k1", "k2"), ["k1", "k2"], "left_anti")))
        return replace(self, refs=self.refs.unionByName(added), filters=filters, repeated=repeated)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index without these documents."""
        ids = ids.select(F.coalesce(C.named(id_col).cast("long"), F.lit(C.NO_ID)).alias("_id")).distinct()
        touched = cut(self.refs.join(ids, "_id", "left_semi").select("k1", "k2").distinct().withColumn("shard", self._shard()))
        refs = cut(self.refs.join(ids, "_id", "left_anti"))
        counted = cut(self._counted(refs.join(touched.select("k1", "k2"), ["k1", "k2"], "left_semi")))
        orphans = touched.join(counted, ["k1", "k2"], "left_anti")
        shards = orphans.select("shard").distinct()
        changed = _fresh(orphans).groupBy("shard").cogroup(self.filters.join(shards, "shard", "left_semi").groupBy("shard")).applyInArrow(_forget, FILTERS)
        filters = cut(changed.unionByName(self.filters.join(shards, "shard", "left_anti")))
        repeated = self.repeated.join(touched.select("k1", "k2"), ["k1", "k2"], "left_anti").unionByName(counted.filter("first < last").select("k1", "k2", "first"))
        return replace(self, refs=refs, filters=filters, repeated=cut(repeated))

    def drops(self, refs: DataFrame) -> DataFrame:
        """``_id``, ``_same`` and the keys whose lines go, for documents by their references."""
        total = refs.count()
        hot = cut(refs.groupBy("k1", "k2").count().filter(F.col("count") > max(1, total // HOT_SHARE)).select("k1", "k2"))
        hot_keys = F.broadcast(self.repeated.join(F.broadcast(hot), ["k1", "k2"]))
        rest = refs.join(F.broadcast(hot), ["k1", "k2"], "left_anti").join(self.repeated, ["k1", "k2"])
        both = refs.join(hot_keys, ["k1", "k2"]).select(rest.columns).unionByName(rest)
        return both.filter("first < _id").groupBy("_id", "_same").agg(F.collect_set(F.struct("k1", "k2")).alias("_drops"))

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", refs: DataFrame | None = None) -> DataFrame:
        """The rows of ``docs`` with a struct ``lines`` (``C.free_name`` where they have such a column): kept (the text left; null if the row had no
        text), n_lines and n_dropped. ``refs``: their references, where the index has exactly these documents."""
        found = refs if refs is not None else cut(self.references(docs, id_col, text_col))
        rows = docs.select(F.struct("*").alias("_doc"), *C.intake_columns(id_col, text_col), C.named(text_col).isNull().alias("_none")).withColumn("_same", F.xxhash64("_text"))
        drops = self.drops(found)
        joined = rows.join(drops, ["_id", "_same"], "left").select("_doc", "_text", F.coalesce("_drops", F.array().cast("array<struct<k1:long,k2:long>>")).alias("_drops"))
        kind = T.StructType([joined.schema["_doc"], *T._parse_datatype_string("_kept string, n_lines long, n_dropped long").fields])
        out = joined.mapInArrow(_kept_lines(self.min_chars), kind)
        missing = F.col("_doc").getField(text_col).isNull()
        return out.select("_doc.*", F.struct(F.when(~missing, F.col("_kept")).alias("kept"), "n_lines", "n_dropped").alias(C.free_name(docs, "lines")))
