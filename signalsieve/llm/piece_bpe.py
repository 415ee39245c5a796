"""One SentencePiece BPE vocabulary: marked words of a text, their pieces, and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import numpy as np
from sentencepiece import sentencepiece_model_pb2

# --- Fixed values: the white-space marker and the piece types of the model format ---

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

# --- End of fixed values ---


class PieceBpe:
    """A vocabulary from the bytes of its model file.

    Taken are BPE models with byte fallback that leave texts as they are but for the marker, and whose
    pieces have markers at their beginning only: then no piece reaches from one marked word into
    the next, and each word's pieces do not depend on its neighbours.
    """

    def __init__(self, model: bytes):
        parsed = sentencepiece_model_pb2.ModelProto()
        parsed.ParseFromString(model)
        trainer, normalizer = parsed.trainer_spec, parsed.normalizer_spec
        if (
            trainer.model_type != trainer.BPE
            or not trainer.byte_fallback
            or trainer.treat_whitespace_as_suffix
            or normalizer.precompiled_charsmap
            or not normalizer.add_dummy_prefix
            or normalizer.remove_extra_whitespaces
            or not normalizer.escape_whitespaces
            or any(p.type in (USER_DEFINED, UNUSED) for p in parsed.pieces)
        ):
            raise ValueError("not a BPE model with byte fallback and unchanged texts")
        self.pieces = {p.piece: (-p.score, i) for i, p in enumerate(parsed.pieces) if p.type == NORMAL}
        if any(MARKER in p.lstrip(MARKER) for p in self.pieces):
            raise ValueError("a piece of this model reaches across a white-space marker")
        self.unknown = next((i for i, p in enumerate(parsed.pieces) if p.type == UNKNOWN), 0)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(parsed.pieces) if p.type == BYTE}
        if len(self.bytes) < 256:
            raise ValueError("byte pieces are missing")
        self.size = len(parsed.pieces)
        self._text = {i: p.replace(MARKER, " ").encode() for p, (_, i) in self.pieces.items()}
        self._text.update({i: bytes([b]) for b, i in self.bytes.items()})
        # A line end that only stands alone is a word of its own, as no piece joins it to another.
        line = "" if any("\n" in p and len(p) > 1 for p in self.pieces) else "\n"
        self._words = re.compile(f" *[^ {line}]+| +|{line}" if line else " *[^ ]+| +")

    def words(self, text: str | None) -> list[str]:
        """Marked words of a text, each with a space for every marker; joined they are the marked text."""
        return self._words.findall(" " + text.replace(MARKER, " ")) if text else []

    def encode_word(self, word: str) -> list[int]:
        """Ids of one marked word: the best-scored adjacent pair first, the leftmost of equal ones."""
        symbols = list(word.replace(" ", MARKER))
        n, pieces = len(symbols), self.pieces
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is stale unless the two symbols at its place still make its piece.
        queue = [(pieces[p][0], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in pieces]
        heapify(queue)
        while queue:
            _, i, piece = heappop(queue)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := piece + symbols[k]) in pieces:
                    heappush(queue, (pieces[p][0], i, p))
            h = before[i]
            if h >= 0 and (p := symbols[h] + piece) in pieces:
                heappush(queue, (pieces[p][0], h, p))
        ids: list[int] = []
        for symbol in symbols:
            if symbol in pieces:
                ids.append(pieces[symbol][1])
            elif symbol:
                ids += [self.bytes[b] for b in symbol.encode("utf-8")]
        return ids

    def decode_word(self, ids: Sequence[int]) -> bytes:
        """UTF-8 of one marked word's ids, with a space for every marker."""
        return b"".join([self._text[i] for i in ids])

    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids' pieces one after the other, and where each begins and ends."""
        parts = [self._text.get(i, b"") for i in range(self.size)]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_models: dict[str, PieceBpe] = {}


def piece_model(model: bytes) -> PieceBpe:
    """The vocabulary with these bytes; a worker keeps the latest one."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = PieceBpe(model)
    return _models[key]
