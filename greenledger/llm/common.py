"""Shared pieces: row intake, text as byte arrays, hashes, packed arrays, and blocks that ask shards.

Blocks and shards: a fine-grained key (a byte window, a gram, a word) is never a Spark row. Documents
are dealt to blocks of a few megabytes; a block sends each shard one packed, sorted list of its
distinct keys, and the shard answers with one packed list in the same order. A key that a third of
all documents hold costs one entry per block, and no group grows beyond a block or a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

NO_ID = 2**63 - 1
SEGMENT = 1 << 18
HOT_KEYS = 1000
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
U64 = np.uint64


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """The name for a column beside those of ``df``: underscores are added until none of them has it (case ignored, as Spark does). The
    operators that add a struct to given rows name it so; the given columns stay as they are."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def intake_columns(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("_text")]


def intake(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id`` and ``_text`` alone: a null id sorts last (as the largest long), a null text is empty."""
    return df.select(*intake_columns(id_col, text_col))


def given_id() -> Column:
    """The id as it came in."""
    return F.nullif(F.col("_id"), F.lit(NO_ID))


def remainder(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


# --- bytes and hashes ------------------------------------------------------------

def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and where each begins."""
    a = column.cast(pa.large_binary())
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_binary())
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(batches, column: str = "_text", limit: int = 4 << 20):
    """The batches cut so that none holds more text than ``limit``, but for a single longer row."""
    for batch in batches:
        sizes = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            done = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, done + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def binaries(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """One Arrow binary per slice of a byte array."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def byte_codes() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**64, 256, dtype=U64)


def running(part: np.ndarray, codes: np.ndarray, fwd: np.ndarray) -> np.ndarray:
    h = np.zeros(len(part) + 1, U64)
    np.cumsum(codes[part] * fwd[: len(part)], out=h[1:], dtype=U64)
    return h


def gram_hashes(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """64-bit hash of ``data[p : p + width]`` for every p of the sorted ``at``, by differences of a running sum."""
    out, codes = np.empty(len(at), U64), byte_codes()
    fwd, back = powers(BASE, SEGMENT + width), powers(pow(BASE, -1, 2**64), SEGMENT)
    for lo in range(0, len(data), SEGMENT):
        i, j = np.searchsorted(at, (lo, lo + SEGMENT))
        if i < j:
            h, p = running(data[lo : lo + SEGMENT + width], codes, fwd), at[i:j] - lo
            out[i:j] = (h[p + width] - h[p]) * back[p]
    return mix(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    out, codes, i = np.empty(len(starts), U64), byte_codes(), 0
    fwd, back = powers(BASE, 2 * SEGMENT), powers(pow(BASE, -1, 2**64), SEGMENT)
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(starts, lo + SEGMENT))
        part = data[lo : ends[j - 1]]
        if len(part) > len(fwd):
            fwd = powers(BASE, len(part))
        h, s = running(part, codes, fwd), starts[i:j] - lo
        out[i:j] = (h[ends[i:j] - lo] - h[s]) * back[s]
        i = j
    return mix(out)


SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True


def word_spans(data: np.ndarray, off: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in all texts, and the number of words before each text. ``breaks[byte]``: no part of a word."""
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = off[(off > 0) & (off < len(data))]  # words end where a text ends
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


# --- packed arrays ---------------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes; planes of zeros are left out."""
    raw = np.ascontiguousarray(values)
    width = raw.dtype.itemsize
    while width > 1 and len(raw) and raw.max() < 1 << (8 * (width - 1)):
        width -= 1
    planes = raw.view(np.uint8).reshape(-1, raw.dtype.itemsize)[:, :width].T.tobytes()
    return len(raw).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(body: bytes, dtype=U64) -> np.ndarray:
    n, width = int.from_bytes(body[:8], "little"), body[8]
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(body[9:], decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(body: bytes, dtype=U64) -> np.ndarray:
    return np.cumsum(unpack(body, dtype), dtype=dtype)


def pack_bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + pa.compress(np.packbits(flags).tobytes(), codec="zstd", asbytes=True)


def unpack_bits(body: bytes) -> np.ndarray:
    n = int.from_bytes(body[:8], "little")
    raw = pa.decompress(body[8:], decompressed_size=(n + 7) // 8, codec="zstd") if n else b""
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and the run of each value."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def ordered(keys: np.ndarray, key_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Sort order and sorted keys. Short keys carry their place in the spare bits: one plain sort, ties in place order."""
    room = max(1, (len(keys) - 1).bit_length()) if len(keys) else 1
    if key_bits + room <= 64:
        both = np.sort((keys << U64(room)) | np.arange(len(keys), dtype=U64))
        return (both & U64((1 << room) - 1)).astype(np.int64), both >> U64(room)
    order = np.argsort(keys)
    return order, keys[order]


# --- blocks and shards -----------------------------------------------------------

def _dealt(rows: DataFrame, block_bytes: int, ordered: bool = False) -> DataFrame:
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    row = F.monotonically_increasing_id()
    if not ordered:
        return rows.withColumn("_blk", F.pmod(F.xxhash64("_id", row), F.lit(n))).withColumn("_rank", F.lit(0).cast("long"))
    cuts = rows.agg(F.percentile_approx("_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(max(10000, 20 * n)))).first()[0] if n > 1 else []
    cuts = cuts or []
    hot = {v: cuts.count(v) + 1 for v in dict.fromkeys(cuts) if cuts.count(v) > 1}
    bounds = sorted({*cuts, *(v + 1 for v in hot if v < NO_ID)})
    rank = F.lit(0).cast("long")
    if bounds:
        # binary search by halves: the depth of the expression is the logarithm of the number of bounds
        table = F.array(*[F.lit(b) for b in bounds])
        step = 1 << (len(bounds).bit_length() - 1)
        rows = rows.withColumn("_at", F.lit(0))
        while step:
            probe = F.col("_at") + step
            rows = rows.withColumn("_at", F.when((probe <= len(bounds)) & (F.get(table, probe - 1) <= F.col("_id")), probe).otherwise(F.col("_at")))
            step >>= 1
        rank = F.col("_at").cast("long")
    salt = F.lit(0).cast("long")
    for value, parts in hot.items():
        salt = F.when(F.col("_id") == value, F.pmod(F.xxhash64(row), F.lit(parts))).otherwise(salt)
    return rows.withColumn("_rank", rank).withColumn("_blk", F.col("_rank") * (n + 2) + salt).drop("_at")


BLOCKS = "_blk long, _rank long, ids binary, sizes binary, flags binary, body binary"


def _bundle(batches):
    """One row per block and batch: ids, sizes, flags and the joined texts, compressed for the shuffle."""
    for batch in batches:
        blocks = batch.column("_blk").to_numpy()
        order = np.argsort(blocks, kind="stable")
        batch = batch.take(pa.array(order))
        data, off = text_bytes(batch.column("_text"))
        ids = batch.column("_id").to_numpy().astype(np.int64)
        flags = batch.column("_flag").to_numpy(zero_copy_only=False)
        ranks, cut_at = batch.column("_rank").to_numpy(), np.append(runs(blocks[order])[0], len(order))
        rows = [(int(blocks[order[i]]), int(ranks[i]), pack(ids[i:j].view(U64)), pack(np.diff(off[i : j + 1]).astype(U64)), pack_bits(flags[i:j]), pa.compress(data[off[i] : off[j]].tobytes(), codec="zstd", asbytes=True)) for i, j in zip(cut_at, cut_at[1:])]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["_blk", "_rank", "ids", "sizes", "flags", "body"])


def unbundle(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one byte array with offsets, ids and flags of a block."""
    sizes = [unpack(x).astype(np.int64) for x in cells(block, "sizes")]
    data = b"".join(pa.decompress(x, decompressed_size=int(n.sum()), codec="zstd", asbytes=True) if n.sum() else b"" for x, n in zip(cells(block, "body"), sizes))
    ids = np.concatenate([unpack(x).view(np.int64) for x in cells(block, "ids")])
    flags = np.concatenate([unpack_bits(x) for x in cells(block, "flags")])
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), ids, flags


def in_blocks(rows: DataFrame, block_bytes: int, ordered: bool = False) -> DataFrame:
    """Rows of ``_id``, ``_text`` and ``_flag`` bundled by ``_blk`` and ``_rank``, about ``block_bytes`` of text a
    block (one document is never cut). Grouping by ``_blk`` brings a block together.

    ``ordered``: an id in a block of smaller rank is smaller than every id in a block of larger rank;
    an id that fills several blocks has them at one rank, and no other id is in them. Otherwise
    every rank is 0.
    """
    return _dealt(rows, block_bytes, ordered).select("_blk", "_rank", "_id", "_flag", "_text").mapInArrow(_bundle, BLOCKS)


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join of ``many`` rows with at most one row of ``one`` per key, with hot keys split.

    A key with more than a thousandth of all rows (there are at most a thousand, so the driver may see them) is spread
    over as many salts as it has thousandths; its one row is repeated for each salt. ``counts``: rows by key (keys
    and ``count``) where they are known already. One job finds the hot keys and the number of rows.
    """
    counts, seen = counts if counts is not None else many.groupBy(*keys).count(), Observation()
    top = counts.observe(seen, F.sum("count").alias("rows")).orderBy(F.desc("count")).limit(HOT_KEYS).select(*keys, "count")
    largest = top.collect()
    limit = max(1000, (seen.get["rows"] or 0) // HOT_KEYS)
    largest = [(*row[:-1], -(-row[-1] // limit)) for row in largest if row[-1] > limit]
    if not largest:
        return many.join(one, keys, how)
    fields = [T.StructField(f"_hot_{i}", top.schema[k].dataType) for i, k in enumerate(keys)]
    hot = many.sparkSession.createDataFrame(largest, T.StructType([*fields, T.StructField("_parts", T.IntegerType())]))

    def with_parts(df: DataFrame) -> DataFrame:
        match = [df[k].eqNullSafe(F.col(f"_hot_{i}")) for i, k in enumerate(keys)]
        return df.join(F.broadcast(hot), match, "left").drop(*[f"_hot_{i}" for i in range(len(keys))])

    left = with_parts(many).withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = with_parts(one).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def shard_bits(df: DataFrame) -> int:
    """Shards are a power of two of them, at least as many as shuffle partitions."""
    return max(1, (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def cells(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()
