"""Counting quotient filters of word-id n-grams: lossless, since the permutation of a gram can be undone.

A gram of ``n`` ids of ``width`` bits is permuted within its ``n * width`` bits and packed into as few
64-bit limbs as hold whole ids. The leading bits say in which shard it belongs, the next ones are its
quotient, and all others are kept as the remainder. A filter is sorted: a run length for each
quotient, the remainders in as few bytes as hold them, and the counters of those counted more than once.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

ROUNDS = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HEAD = struct.Struct("<IBBI")


def _mix(columns: list[np.ndarray], but: int, turn: int, width: int) -> np.ndarray:
    """``width`` bits made of all columns but one."""
    found = np.full(len(columns[0]), (turn * 8 + but) * 8 + len(columns) + 1, np.uint64) * _ODD
    for ix, column in enumerate(columns):
        if ix != but:
            found = (found ^ column) * _ODD
            found ^= found >> np.uint64(31)
    return found >> np.uint64(64 - width)


def permute(grams: np.ndarray, width: int) -> list[np.ndarray]:
    """Columns of ``width`` bits that look random: each in turn is changed by a function of the others."""
    columns = [np.ascontiguousarray(grams[:, ix]).astype(np.uint64) for ix in range(grams.shape[1])]
    for turn in range(ROUNDS):
        for ix in range(len(columns)):
            columns[ix] = columns[ix] ^ _mix(columns, ix, turn, width)
    return columns


def restore(columns: Sequence[np.ndarray], width: int) -> np.ndarray:
    """The grams of :func:`permute`: the same changes, undone from the last to the first."""
    columns = list(columns)
    for turn in reversed(range(ROUNDS)):
        for ix in reversed(range(len(columns))):
            columns[ix] = columns[ix] ^ _mix(columns, ix, turn, width)
    return np.stack(columns, axis=1).astype(np.int64)


@dataclass(frozen=True)
class Packing:
    """How permuted grams of ``n`` ids of ``width`` bits lie in limbs, and how many leading bits name the shard."""

    n: int
    width: int
    shard_bits: int = 0

    @property
    def limbs(self) -> list[int]:
        """Ids in each limb."""
        room = 64 // self.width
        return [min(room, self.n - at) for at in range(0, self.n, room)]

    @property
    def rest(self) -> int:
        """Bits of the first limb that the shard does not tell."""
        return max(0, self.limbs[0] * self.width - self.shard_bits)

    def pack(self, columns: Sequence[np.ndarray]) -> list[np.ndarray]:
        made, at = [], 0
        for ids in self.limbs:
            limb = columns[at]
            for column in columns[at + 1 : at + ids]:
                limb = (limb << np.uint64(self.width)) | column
            made.append(limb)
            at += ids
        return made

    def unpack(self, limbs: Sequence[np.ndarray]) -> list[np.ndarray]:
        mask = np.uint64((1 << self.width) - 1)
        return [
            (limb >> np.uint64(self.width * (ids - 1 - ix))) & mask
            for limb, ids in zip(limbs, self.limbs, strict=True)
            for ix in range(ids)
        ]

    def shards(self, first: np.ndarray) -> np.ndarray:
        """The shard of each gram, by the first limb."""
        return (first >> np.uint64(self.rest)).astype(np.int64) if self.rest < 64 else np.zeros(len(first), np.int64)


def _narrow(numbers: np.ndarray, bits: int) -> bytes:
    """The low bytes of numbers of ``bits`` bits."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8]).tobytes()


def _wide(data: memoryview, n: int, bits: int) -> tuple[np.ndarray, memoryview]:
    size = (bits + 7) // 8
    found = np.zeros((n, 8), np.uint8)
    found[:, :size] = np.frombuffer(data[: n * size], np.uint8).reshape(n, size)
    return found.reshape(-1).view("<u8").astype(np.uint64), data[n * size :]


def write_filter(packing: Packing, shard: int, limbs: Sequence[np.ndarray], counts: np.ndarray) -> bytes:
    """A sorted filter of distinct grams of one shard. ``limbs`` must be in order."""
    m, rest = len(counts), packing.rest
    quotient = min(rest, max(0, int(m).bit_length() - 1))
    inner = limbs[0] - (np.uint64(shard) << np.uint64(rest) if rest < 64 else np.uint64(0))
    low = rest - quotient
    slots = (inner >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(m, np.int64)
    runs = np.bincount(slots, minlength=1 << quotient)
    run_type = "<u1" if runs.max(initial=0) < 256 else "<u4"
    many = np.flatnonzero(counts > 1)
    parts = [_HEAD.pack(m, quotient, int(run_type[2]), len(many)), runs.astype(run_type).tobytes()]
    parts.append(_narrow(inner & np.uint64((1 << low) - 1), low))
    for limb, ids in zip(limbs[1:], packing.limbs[1:], strict=True):
        parts.append(_narrow(limb, ids * packing.width))
    parts += [many.astype("<u4").tobytes(), counts[many].astype("<i8").tobytes()]
    return b"".join(parts)


def read_filter(packing: Packing, shard: int, data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Limbs, in order, and counts."""
    m, quotient, run_size, many = _HEAD.unpack_from(data)
    left = memoryview(data)[_HEAD.size :]
    rest = packing.rest
    low = rest - quotient
    runs = np.frombuffer(left[: run_size << quotient], f"<u{run_size}")
    left = left[run_size << quotient :]
    inner, left = _wide(left, m, low)
    slots = np.repeat(np.arange(1 << quotient, dtype=np.uint64), runs)
    if low < 64:
        inner |= slots << np.uint64(low)
    if rest < 64:
        inner += np.uint64(shard) << np.uint64(rest)
    limbs = [inner]
    for ids in packing.limbs[1:]:
        limb, left = _wide(left, m, ids * packing.width)
        limbs.append(limb)
    counts = np.ones(m, np.int64)
    counts[np.frombuffer(left[: 4 * many], "<u4")] = np.frombuffer(left[4 * many : 12 * many], "<i8")
    return limbs, counts


def ordered(limbs: Sequence[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Grams in order, equal ones added up. Sorted stretches, one after the other, are merged as they are."""
    if not len(counts):
        return list(limbs), counts
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    limbs = [limb[order] for limb in limbs]
    new = np.ones(len(counts), bool)
    new[1:] = np.logical_or.reduce([limb[1:] != limb[:-1] for limb in limbs])
    first = np.flatnonzero(new)
    return [limb[first] for limb in limbs], np.add.reduceat(counts[order], first)


def merge_filters(packing: Packing, shard: int, filters: Sequence[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The grams of several filters of one shard, in order, with their counts added up."""
    read = [read_filter(packing, shard, data) for data in filters]
    limbs = [np.concatenate([found[0][ix] for found in read]) for ix in range(len(packing.limbs))]
    return ordered(limbs, np.concatenate([found[1] for found in read]))
