"""Canonical length-limited Huffman codes of numbers, in numpy."""

from __future__ import annotations

import numpy as np

#: Longest code; decoding tables have two to this power entries.
MAX_LENGTH = 16
#: Numbers between two checkpoints.
STRIDE = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} numbers need codes of over {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    level, leaves = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        order = np.argsort(np.concatenate([weights, pairs]), kind="stable")
        level = np.concatenate([weights, pairs])[order]
        leaves.append(order < n)
    take = 2 * n - 2
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        lengths[used[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Codebook:
    """Canonical codes for given lengths: by length, then by number."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.flatnonzero(lengths)
        order = order[np.argsort(lengths[order], kind="stable")]
        sizes = self.lengths[order]
        self.top = int(sizes.max(initial=1))
        spans = np.left_shift(1, self.top - sizes)
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = starts >> (self.top - sizes)
        table = 1 << self.top
        self.symbol, self.size = np.zeros(table, np.uint32), np.ones(table, np.uint8)
        self.symbol[: spans.sum()] = np.repeat(order, spans)
        self.size[: spans.sum()] = np.repeat(sizes, spans)

    def encode(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Codes of consecutive runs of ``counts`` numbers, each run in bytes of its own.

        Also the bit offset within its run of every STRIDE-th number of each run.
        """
        sizes = self.lengths[numbers]
        if len(sizes) and sizes.min() == 0:
            raise ValueError("a number without a code")
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(sizes)])
        bits = total[ends] - total[ends - counts]
        lengths = (bits + 7) // 8
        byte_starts = np.cumsum(lengths) - lengths
        offset = total[:-1] + np.repeat(byte_starts * 8 - total[ends - counts], counts)
        # Codes that start in one 32-bit word lie in its 64-bit window without touching: they add up.
        word = offset >> 5
        value = self.codes[numbers].astype(np.uint64) << (64 - (offset & 31) - sizes).astype(np.uint64)
        out = np.zeros(int(lengths.sum()) // 4 + 2, np.uint64)
        if len(word):
            first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
            window = np.add.reduceat(value, first)
            out[word[first]] += window >> np.uint64(32)
            out[word[first] + 1] += window & np.uint64(0xFFFFFFFF)
        data = out.astype(">u4").tobytes()
        run_start = np.repeat(ends - counts, counts)
        marked = (np.arange(len(numbers)) - run_start) % STRIDE == 0
        checkpoints = (offset - np.repeat(byte_starts * 8, counts))[marked]
        return [data[a : a + n] for a, n in zip(byte_starts.tolist(), lengths.tolist())], checkpoints

    def decode(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers from ``counts`` codes at each of the bit offsets ``starts``, all side by side."""
        raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
        window = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        place, at, left = ends - counts, starts.astype(np.int64), counts.copy()
        order = np.argsort(-left, kind="stable")
        place, at, left = place[order], at[order], left[order]
        mask, spare = (1 << self.top) - 1, 24 - self.top
        step, live = 0, int((left > 0).sum())
        while live:
            at, place = at[:live], place[:live]
            code = window[at >> 3] >> (spare - (at & 7)) & mask
            out[place + step] = self.symbol[code]
            at = at + self.size[code]
            step += 1
            live = int(np.searchsorted(-left, -step, side="left"))
        return out
