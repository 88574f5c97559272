"""A cuckoo filter over 64-bit hashes: 16-bit fingerprints, four to a bucket, two buckets per key.

It grows by further tables, so it never fills; what finds no room after many moves waits in a
small exact list. A key is inserted once and may then be deleted once; a key that was never
inserted must not be deleted.
"""

from __future__ import annotations

import io

import numpy as np

from greenledger.llm.common import U64, mix

SLOTS = 4
ROUNDS = 200


class CuckooFilter:
    def __init__(self, expected: int = 256):
        self.tables: list[np.ndarray] = []
        self.waiting = np.zeros((0, 2), np.int64)  # (bucket's low bits, fingerprint)
        self._grow(expected)

    def _grow(self, keys: int) -> None:
        buckets = 1 << max(4, int(np.ceil(keys / (SLOTS * 0.8))).bit_length())
        self.tables.append(np.zeros((buckets, SLOTS), np.uint16))

    @staticmethod
    def _parts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = ((hashes >> U64(48)) % U64(65535) + U64(1)).astype(np.int64)
        one = (hashes & U64(0x7FFFFFFF)).astype(np.int64)
        return mark, one, one ^ CuckooFilter._jump(mark)

    @staticmethod
    def _jump(mark: np.ndarray) -> np.ndarray:
        return (mix(mark.astype(U64)) & U64(0x7FFFFFFF)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self._parts(hashes)
        found = np.zeros(len(hashes), bool)
        for table in self.tables:
            for at in (one, two):
                found |= (table[at & (len(table) - 1)] == mark[:, None]).any(1)
        if len(self.waiting):
            held = set(map(tuple, self.waiting.tolist()))
            found |= np.fromiter(((a & 15, m) in held or (b & 15, m) in held for a, b, m in zip(one.tolist(), two.tolist(), mark.tolist())), bool, len(hashes))
        return found

    def insert(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        table = self.tables[-1]
        if np.count_nonzero(table) + len(hashes) > 0.85 * table.size:
            self._grow(max(len(hashes), 2 * table.size))
            table = self.tables[-1]
        mark, one, two = self._parts(hashes)
        self._place(table, mark, one, first=two)

    def _place(self, table: np.ndarray, mark: np.ndarray, at: np.ndarray, first: np.ndarray) -> None:
        """Rounds over all keys without a slot: take a free slot, else swap with one key of the bucket."""
        at, pick = np.where(np.arange(len(at)) % 2 == 0, at, first), np.random.default_rng(11)
        for _ in range(ROUNDS):
            bucket = at & (len(table) - 1)
            order = np.argsort(bucket, kind="stable")
            mark, at, bucket = mark[order], at[order], bucket[order]
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            turn = np.arange(len(bucket)) - np.repeat(begin, np.diff(np.r_[begin, len(bucket)]))
            free = table[bucket] == 0
            fits = turn < free.sum(1)
            slot = np.argmax(np.cumsum(free, 1) > turn[:, None], 1)
            table[bucket[fits], slot[fits]] = mark[fits]
            mark, at, bucket, turn = mark[~fits], at[~fits], bucket[~fits], turn[~fits]
            if not len(mark):
                return
            _, lead = np.unique(bucket, return_index=True)
            slot = pick.integers(0, SLOTS, len(lead))
            out = table[bucket[lead], slot].astype(np.int64)
            table[bucket[lead], slot] = mark[lead]
            mark[lead] = out
            at = at ^ self._jump(mark)  # its other bucket; only the table's low bits are meant
        self.waiting = np.concatenate([self.waiting, np.stack([at & 15, mark], 1)])

    def delete(self, hashes: np.ndarray) -> None:
        """Takes one copy of each key's fingerprint out."""
        for mark, one, two in zip(*(x.tolist() for x in self._parts(hashes))):
            if not any(self._clear(table, mark, at) for table in self.tables for at in (one, two)):
                hit = np.flatnonzero((self.waiting[:, 1] == mark) & np.isin(self.waiting[:, 0], (one & 15, two & 15)))
                self.waiting = np.delete(self.waiting, hit[:1], axis=0)

    @staticmethod
    def _clear(table: np.ndarray, mark: int, at: int) -> bool:
        row = table[at & (len(table) - 1)]
        hit = np.flatnonzero(row == mark)
        if len(hit):
            row[hit[0]] = 0
        return bool(len(hit))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, waiting=self.waiting, **{f"t{i}": t for i, t in enumerate(self.tables)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, body: bytes) -> CuckooFilter:
        new, held = cls.__new__(cls), np.load(io.BytesIO(body))
        new.waiting = held["waiting"]
        new.tables = [held[f"t{i}"] for i in range(len(held.files) - 1)]
        return new
