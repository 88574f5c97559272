"""Alignment of two tokenizers over the same texts.

Both tokenizers read the text with one space in front. The byte ends of A's tokens, and of B's, are keys of a
dictionary from end to number of tokens; the intersection of the two key sets, sorted, cuts both id lists into groups,
the smallest runs of tokens that cover the same bytes. In every group the last A token and the last B token end
together: that pair is the group's link. (Tokens are never empty, so no other pair ends there.)

A task encodes blocks of a few megabytes once and writes them packed, a quarter of a megabyte of text to a row, so neither the
JVM nor Python holds more than such a row unpacked (a longer text is a row of its own). Links of a block are summed before the shuffle,
so the count of an id pair adds at most one row per block (two where a split of the file ends in it); the counts return to the blocks by
a join whose hot pairs are split. Only B's vocabulary, whose size is known, is broadcast.

A: a byte-level vocabulary in JSON; special tokens are plain text. Where the order of its merges is the order of its ids, which is
checked, ``tiktoken`` encodes (the same tokens in a quarter of the time); a text with a very long run
of white space, or any other vocabulary, goes through ``tokenizers``. B: a sentencepiece model, which adds the
space itself. The files are read once on the driver and travel with the tasks.

Nulls: a null or empty text has no tokens, nor has one whose bytes either tokenizer does not give back (one holding
U+2581, or invalid UTF-8); a null id is the largest. Repeated rows are aligned and counted each time. An empty table gives no
rows. Only ``id_col`` and ``text_col`` are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import cached_property, lru_cache
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from greenledger.llm import common as C
from greenledger.session import written

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: How a byte-level vocabulary of this kind cuts a text before merging. Fixed value of the public format.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NOTHING = [np.zeros(0, np.uint32)] * 4
LONG_SPACE = re.compile(r"\s{1000}")
PART = 1 << 18  # bytes of text in a packed row; a block has several
ROW_GROUP = 16 << 20  # bytes that a task's writer holds, and a reader takes at once

PACKED = "_blk long, ids binary, n_a binary, n_b binary, n_groups binary, a_ids binary, b_ids binary, a_sizes binary, b_sizes binary"
GROUPS = "_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
SCORES = "_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


# --- encoders --------------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A: byte-level BPE from a JSON file."""

    def __init__(self, body: str):
        model, letters = json.loads(body)["model"], byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        self.pieces = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = token
        self.body = body
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = [model["vocab"].get(a + b) for a, b in merges] == list(range(256, 256 + len(merges)))
        self.fast = None
        if in_order and sorted(vocab[bytes([b])] for b in range(256) if bytes([b]) in vocab) == list(range(256)):
            import tiktoken

            ranks = {token: i for token, i in vocab.items() if i < 256 + len(merges)}
            self.fast = tiktoken.Encoding("bytes", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self.body)
        found.encode_special_tokens = True
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none where they don't give it back. The fast way cuts the text's own bytes, so that they lack nothing is seen by their length."""
        if self.fast is not None and not LONG_SPACE.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        ids = self.slow.encode(text, add_special_tokens=False).ids
        return np.array(ids if b"".join(map(self.pieces.__getitem__, ids)) == text.encode() else [], np.uint32)


class Pieces:
    """B: a sentencepiece model, which puts the space before the text itself."""

    def __init__(self, body: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=body)
        self.pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> np.ndarray:
        """Ids; none where they don't give the text back."""
        ids = self.model.encode(text)
        return np.array(ids if b"".join(map(self.pieces.__getitem__, ids)) == (" " + text).encode() else [], np.uint32)


@lru_cache(maxsize=4)
def encoders(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """Built once per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteLevel(a), Pieces(base64.b64decode(b))


# --- one text --------------------------------------------------------------------

def cut_together(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """Numbers of tokens before each common end, in A and in B, by dictionaries from byte end to place."""
    a_at, b_at = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    common = sorted(a_at.keys() & b_at.keys())
    return list(map(a_at.__getitem__, common)), list(map(b_at.__getitem__, common))


def decoded(raw: bytes) -> str:
    """The text, empty where the bytes are none."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return ""


class Aligner:
    def __init__(self, a: str, b: str):
        self.a, self.b = encoders(a, b)
        self.a_lengths, self.b_lengths = (np.array([len(p) for p in x.pieces], np.int64) for x in (self.a, self.b))

    def align(self, raw: bytes) -> list[np.ndarray]:
        """Ids of A and of B, and the numbers of tokens before each common end; nothing for a text without tokens."""
        text = decoded(raw)
        if not text:
            return NOTHING
        a, b = self.a.encode(" " + text), self.b.encode(text)
        a_ends, b_ends = np.cumsum(self.a_lengths[a]).tolist(), np.cumsum(self.b_lengths[b]).tolist()
        if not len(a) or not len(b) or a_ends[-1] != len(raw) + 1 or b_ends[-1] != len(raw) + 1:
            return NOTHING
        return [a, b, *[np.array(x, np.uint32) for x in cut_together(a_ends, b_ends)]]


def _pack32(lists: list) -> bytes:
    """Numbers in the least of 1, 2 or 4 bytes each, side by side, so that what comes again as a run of tokens is found again."""
    values = np.concatenate([np.asarray(x, np.uint32) for x in lists]) if lists else np.zeros(0, np.uint32)
    width = next(w for w in (1, 2, 4) if int(values.max(initial=0)) < 1 << (8 * w))
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.Codec("zstd", compression_level=3).compress(values.astype(f"<u{width}").tobytes(), asbytes=True)


def _unpack32(body: bytes) -> np.ndarray:
    n, width = int.from_bytes(body[:8], "little"), body[8]
    return np.frombuffer(pa.decompress(body[9:], decompressed_size=n * width, codec="zstd") if n else b"", f"<u{width}").astype(np.int64)


def _encode(a: str, b: str, block_bytes: int):
    def encode(batches):
        aligner, block, held = Aligner(a, b), TaskContext.get().partitionId() << 33, 0
        names = [field.split(" ")[0] for field in PACKED.split(", ")]
        for batch in C.pieces(batches, limit=min(PART, block_bytes)):
            texts = batch.column("_text").cast(pa.large_binary())
            size = pc.sum(pc.binary_length(texts)).as_py() or 0
            if held and held + size > block_bytes:
                block, held = block + 1, 0
            held += size
            found = [aligner.align(raw.as_py()) for raw in texts]
            sizes = [[len(f[k]) for f in found] for k in (0, 1, 2)]
            columns = [
                C.pack(batch.column("_id").to_numpy().view(np.uint64)), *[_pack32([s]) for s in sizes], _pack32([f[0] for f in found]), _pack32([f[1] for f in found]),
                _pack32([np.diff(f[2], prepend=np.uint32(0)) for f in found]), _pack32([np.diff(f[3], prepend=np.uint32(0)) for f in found]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([c], pa.binary()) for c in columns]], names=names)

    return encode


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, block_bytes: int = 4 << 20) -> DataFrame:
    """Aligned blocks, some rows each, written to the shared folder: the texts are encoded once, whatever is asked of them later."""
    a, b = Path(a_file).read_text(), base64.b64encode(Path(b_file).read_bytes()).decode()
    return written(C.intake(docs, id_col, text_col).mapInArrow(_encode(a, b, block_bytes), PACKED), ROW_GROUP)


# --- what a block holds ----------------------------------------------------------

class Block:
    """One packed row, a part of a block: documents in order, their tokens and groups."""

    def __init__(self, row: dict):
        self.ids = C.unpack(row["ids"]).view(np.int64)
        self.n_a, self.n_b, self.n_groups = (_unpack32(row[k]) for k in ("n_a", "n_b", "n_groups"))
        self.a, self.b, self.a_sizes, self.b_sizes = (_unpack32(row[k]) for k in ("a_ids", "b_ids", "a_sizes", "b_sizes"))

    def links(self) -> np.ndarray:
        """B id and A id of every group's last tokens, as one number."""
        return (self.b[np.cumsum(self.b_sizes) - 1] << 32) | self.a[np.cumsum(self.a_sizes) - 1]


def _blocks(rows):
    for i in range(rows.num_rows):  # one unpacked at a time
        row = rows.slice(i, 1).to_pylist()[0]
        yield row["_blk"], Block(row)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def _unfold(batches):
    for batch in batches:
        for _, b in _blocks(batch):
            columns = [pa.array(b.ids, pa.int64()), _lists(b.a, b.n_a), _lists(b.b, b.n_b), _lists(b.a_sizes, b.n_groups), _lists(b.b_sizes, b.n_groups)]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])


def alignments(blocks: DataFrame) -> DataFrame:
    """``_id``, the ids of A and B, and how many tokens of each every group has, one row per document."""
    return blocks.mapInArrow(_unfold, GROUPS)


def _pairs(batches):
    parts = ((blk, *np.unique(block.links(), return_counts=True)) for batch in batches for blk, block in _blocks(batch))
    for blk, found in groupby(parts, key=lambda part: part[0]):
        _, keys, n = zip(*found)
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(n), len(keys)).astype(np.int64)  # sums stay far below 2^53
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), blk), pa.int64()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["_blk", "pair", "n"])


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links by block and pair, and by pair alone: ``pair`` (B id and A id), ``links``, ``count`` (blocks holding
    it) and ``best`` (no pair with the same B id has more links)."""
    asked = written(blocks.mapInArrow(_pairs, "_blk long, pair long, n long"))
    total = written(asked.groupBy("pair").agg(F.sum("n").alias("links"), F.count("*").alias("count")))
    most = total.groupBy(F.shiftright("pair", 32).alias("b")).agg(F.max("links").alias("most"))  # a row per B id: the vocabulary bounds it
    marked = total.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("b")).select("pair", "links", "count", (F.col("links") == F.col("most")).alias("best"))
    return asked, marked


@lru_cache(maxsize=32)
def _names(bits: int) -> pa.Array:
    """All numbers of so many bits as text, once per worker process."""
    return pa.array(np.arange(1 << bits)).cast(pa.string())


def _notation(block: Block) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` for every document."""

    def joined(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        names = _names(int(values.max(initial=0)).bit_length()).take(pa.array(values))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), names)
        return pc.binary_join(lists, ",")

    groups = pc.binary_join_element_wise(joined(block.a, block.a_sizes), joined(block.b, block.b_sizes), "|")
    offsets = pa.array(np.concatenate([[0], np.cumsum(block.n_groups)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, groups), ";")


def _score(key, rows, answers):
    pairs = answers.column("pair").to_numpy()
    order = np.argsort(pairs)
    pairs, links, best = pairs[order], answers.column("links").to_numpy()[order], answers.column("best").to_numpy(zero_copy_only=False)[order]
    out = []
    for _, b in _blocks(rows):
        at = np.searchsorted(pairs, b.links())
        ends = np.concatenate([[0], np.cumsum(b.n_groups)])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])  # noqa: B023, E731
        columns = [b.ids, b.n_a, b.n_b, b.n_groups, b.n_groups, total(best[at].astype(np.int64)), total(links[at])]
        out.append(pa.table([*[pa.array(c, pa.int64()) for c in columns], _notation(b)], names=[field.split(" ")[0] for field in SCORES.split(", ")]))
    return pa.concat_tables(out)


def link_scores(blocks: DataFrame) -> DataFrame:
    """One row per document: tokens, groups and links, how many links are their B id's most frequent, the sum of the links'
    corpus-wide counts, and the groups as text (empty without tokens)."""
    asked, counts = pair_counts(blocks)
    answers = C.salted_join(asked.select("_blk", "pair"), counts.select("pair", "links", "best"), ["pair"], F.col("_blk"), counts=counts.select("pair", "count"))
    return blocks.groupBy("_blk").cogroup(answers.groupBy("_blk")).applyInArrow(_score, SCORES)
