"""Decoding of SentencePiece model files: the protobuf wire format, for the few fields the engine uses."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..errors import TokenizerFileNotFound, VocabularyParsingError

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class Piece:
    text: str
    score: float = 0.0
    kind: int = NORMAL


@dataclass
class ModelFile:
    pieces: list[Piece] = field(default_factory=list)
    model_type: int = 1
    byte_fallback: bool = False
    normalizer: str = ""
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise VocabularyParsingError("a number runs past the end")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: numbers for varints, bytes for the rest."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield number, value
            continue
        if kind == 2:
            size, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise VocabularyParsingError(f"wire type {kind} is not supported")
        if at + size > len(data):
            raise VocabularyParsingError("a field runs past the end")
        yield number, data[at : at + size]
        at += size


def _piece(data: bytes) -> Piece:
    text, score, kind = "", 0.0, NORMAL
    for number, value in fields(data):
        if number == 1:
            text = value.decode("utf-8")
        elif number == 2:
            score = struct.unpack("<f", value)[0]
        elif number == 3:
            kind = value
    return Piece(text, score, kind)


def parse_model(data: bytes) -> ModelFile:
    model = ModelFile()
    for number, value in fields(data):
        if number == 1:
            model.pieces.append(_piece(value))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.model_type = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 1:
                    model.normalizer = v.decode("utf-8")
                elif n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
    return model


def read_model(path: str) -> ModelFile:
    try:
        with open(path, "rb") as f:
            return parse_model(f.read())
    except FileNotFoundError:
        raise TokenizerFileNotFound(path) from None


def _encode_varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes(out + bytes([value]))


def encode_model(pieces: list[Piece], model_type: int = 1) -> bytes:
    """A minimal model file of these pieces; used by tests and to save derived vocabularies."""
    out = b""
    for p in pieces:
        raw = p.text.encode("utf-8")
        body = b"\x0a" + _encode_varint(len(raw)) + raw + b"\x15" + struct.pack("<f", p.score) + b"\x18" + _encode_varint(p.kind)
        out += b"\x0a" + _encode_varint(len(body)) + body
    trainer = b"\x18" + _encode_varint(model_type)
    return out + b"\x12" + _encode_varint(len(trainer)) + trainer
