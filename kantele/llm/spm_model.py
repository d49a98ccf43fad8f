"""Reader of SentencePiece model files (protocol buffer wire format)."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Piece types of the file format: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The mark that stands for a space: a fixed value.
SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def wire_fields(data: bytes):
    """(field number, value) pairs of one message; sub-messages stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class SpmModel:
    """What a model file states of pieces and normalisation."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    algorithm: int = 1
    byte_fallback: bool = False
    unknown_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    mark_spaces: bool = True

    @classmethod
    def read(cls, path: str) -> SpmModel:
        with open(path, "rb") as file:
            data = file.read()
        model = cls()
        for number, value in wire_fields(data):
            if number == 1:
                piece = dict(wire_fields(value))
                model.pieces.append(piece.get(1, b"").decode())
                model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                model.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(wire_fields(value))
                model.algorithm = spec.get(3, 1)
                model.byte_fallback = bool(spec.get(35, 0))
                model.unknown_surface = spec[44].decode() if 44 in spec else model.unknown_surface
            elif number == 3:
                spec = dict(wire_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix = bool(spec.get(3, 1))
                model.strip_spaces = bool(spec.get(4, 1))
                model.mark_spaces = bool(spec.get(5, 1))
        return model
