"""Range asymmetric numeral system (static, interleaved) over numpy lanes.

All blocks share one frequency table. Symbol i of a block belongs to lane
i % lanes; each lane has a 64-bit state in [2^31, 2^63) and gives or takes 32
bits at a time. Every few steps the decoder's states are written down, so a
block can be decoded from each of these checkpoints; each stretch between two
has a checksum of its ids.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
LANES, CHECK_STEPS = 1024, 128
TABLE_MAGIC, BLOCK_MAGIC = b"RANSTAB1", b"RANSBLK1"


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def lanes_of(n: int, lanes: int = LANES) -> int:
    """Lanes of a block of n ids: small ones have fewer."""
    return max(1, min(lanes, 1 << max(0, (n // 64).bit_length() - 1)))


def stretches(n: int, lanes: int = LANES, check_steps: int = CHECK_STEPS) -> tuple[int, int]:
    """(how many stretches between checkpoints a block of n ids has, ids of each but the last)."""
    lanes = lanes_of(n, lanes)
    steps = -(-n // lanes)
    return max(1, -(-steps // check_steps)), check_steps * lanes


@dataclass(frozen=True)
class Table:
    """Frequencies that add up to 2 ** bits; a symbol without any cannot be encoded."""

    bits: int
    freq: np.ndarray  # uint64

    @classmethod
    def of(cls, counts: np.ndarray, bits: int = 20) -> Table:
        """Scale counts down to the sum 2 ** bits, at least 1 for each that occurs."""
        counts = np.asarray(counts, dtype=np.float64)
        used = np.nonzero(counts)[0]
        total = 1 << bits
        if len(used) > total:
            raise ValueError(f"{len(used)} symbols need more than {bits} bits")
        freq = np.zeros(max(1, len(counts)), dtype=np.int64)
        if not len(used):
            freq[0] = total
            return cls(bits, freq.astype(np.uint64))
        freq[used] = np.maximum(1, np.floor(counts[used] * (total / counts.sum()))).astype(np.int64)
        short = total - int(freq.sum())
        order = used[np.argsort(-freq[used], kind="stable")]
        if short > 0:
            freq[order[0]] += short
        for k in order:  # the largest give first
            if short >= 0:
                break
            give = min(int(freq[k]) - 1, -short)
            freq[k] -= give
            short += give
        return cls(bits, freq.astype(np.uint64))

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)

    @property
    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def to_bytes(self) -> bytes:
        body = struct.pack("<BI", self.bits, len(self.freq)) + self.freq.astype("<u4").tobytes()
        return TABLE_MAGIC + body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        body, crc = data[8:-4], data[-4:]
        if data[:8] != TABLE_MAGIC or struct.unpack("<I", crc)[0] != zlib.crc32(body):
            raise ValueError("damaged frequency table")
        bits, n = struct.unpack_from("<BI", body)
        return cls(bits, np.frombuffer(body, "<u4", n, 5).astype(np.uint64))


class Coder:
    def __init__(self, table: Table):
        self.bits = _u(table.bits)
        self.freq, self.start, self.symbol = table.freq, table.starts, table.symbols
        self.mask = _u((1 << table.bits) - 1)

    def encode(self, ids: np.ndarray, lanes: int = LANES, check_steps: int = CHECK_STEPS) -> bytes:
        """A block: header, lane states, checkpoints, checksums of the stretches' ids, words, and a checksum of all."""
        n = len(ids)
        lanes = lanes_of(n, lanes)
        steps = -(-n // lanes)
        f_all, c_all = self.freq[ids], self.start[ids]
        if n and not f_all.all():
            raise ValueError("a symbol without frequency")
        x = np.full(lanes, LOW, dtype=np.uint64)
        top = _u(31 + 32) - self.bits
        out: list[np.ndarray] = []
        marks: list[tuple[int, bytes]] = []
        words = 0
        for step in range(steps - 1, -1, -1):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            f, c, s = f_all[a:b], c_all[a:b], x[: b - a]
            over = s >= f << top
            if over.any():
                out.append((s[over] & _u(0xFFFFFFFF)).astype("<u4"))
                words += len(out[-1])
                s[over] >>= WORD
            q = s // f
            s[:] = (q << self.bits) + (s - q * f) + c
            if step and step % check_steps == 0:
                marks.append((words, x.astype("<u8").tobytes()))
        raw, span = ids.astype("<u4"), check_steps * lanes
        sums = [zlib.crc32(raw[k * span : (k + 1) * span].tobytes()) for k in range(len(marks) + 1)]
        body = [x.astype("<u8").tobytes(), *(struct.pack("<I", words - w) + state for w, state in reversed(marks)), np.array(sums, dtype="<u4").tobytes(), *(w.tobytes() for w in reversed(out))]
        head = struct.pack("<IIIII", n, lanes, check_steps, len(marks), words)
        payload = head + b"".join(body)
        return BLOCK_MAGIC + struct.pack("<II", len(payload), zlib.crc32(payload)) + payload

    def decode(self, block: bytes, checkpoint: int = 0, until: int | None = None) -> np.ndarray:
        """The ids from a checkpoint (0: the beginning) to another (None: the end), held against their checksums."""
        size, crc = struct.unpack_from("<II", block, 8)
        payload = block[16 : 16 + size]
        if block[:8] != BLOCK_MAGIC or len(payload) != size or zlib.crc32(payload) != crc:
            raise ValueError("damaged block")
        n, lanes, check_steps, marks, words = struct.unpack_from("<IIIII", payload)
        at = 20 + 8 * lanes
        state, pos = payload[20:at], 0
        if checkpoint:
            if checkpoint > marks:
                raise ValueError(f"the block has {marks} checkpoints")
            here = at + (checkpoint - 1) * (4 + 8 * lanes)
            (pos,) = struct.unpack_from("<I", payload, here)
            state = payload[here + 4 : here + 4 + 8 * lanes]
        x = np.frombuffer(state, "<u8").astype(np.uint64)
        at += marks * (4 + 8 * lanes)
        sums = np.frombuffer(payload, "<u4", marks + 1, at)
        last_mark = marks + 1 if until is None else min(until, marks + 1)
        begin, behind = at + 4 * (marks + 1), words
        if last_mark <= marks:
            (behind,) = struct.unpack_from("<I", payload, 20 + 8 * lanes + (last_mark - 1) * (4 + 8 * lanes))
        stream = np.frombuffer(payload, "<u4", behind - pos, begin + 4 * pos).astype(np.uint64)
        pos = 0
        first, last = checkpoint * check_steps, min(last_mark * check_steps, -(-n // lanes))
        out = np.empty(max(0, min(n, last * lanes) - first * lanes), dtype=np.uint32)
        base = first * lanes
        for step in range(first, last):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            s = x[: b - a]
            slot = s & self.mask
            sym = self.symbol[slot]
            out[a - base : b - base] = sym
            s[:] = self.freq[sym] * (s >> self.bits) + slot - self.start[sym]
            low = s < LOW
            k = int(np.count_nonzero(low))
            if k:
                s[low] = (s[low] << WORD) | stream[pos : pos + k]
                pos += k
        raw, span = out.astype("<u4"), check_steps * lanes
        for k in range(checkpoint, last_mark):
            if zlib.crc32(raw[k * span - base : (k + 1) * span - base].tobytes()) != sums[k]:
                raise ValueError("the ids do not have the block's checksum")
        return out
