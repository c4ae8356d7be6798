"""SentencePiece encoding and decoding: the best path over scored pieces, in batched numpy.

Spaces become markers and cut a text into words, each with its leading markers (no piece has a marker after
another character; this is checked at load). Line breaks that no piece holds cut them as well. The distinct new words of a batch are
grouped by length, and all words of a length advance together: hashes of all their substrings probe the sorted hashes of the pieces,
and at each end position one vectorised maximum over the piece lengths stores the back-pointers (``operators.lattice``). Words of hundreds of
characters, as in texts without spaces, are looked up in blocks and walked from start to start, so time and memory stay in
proportion to their length. Equal sums go to the earliest start. A character that no piece covers costs the least score minus ``UNKNOWN``
and is written as its byte pieces. Any model file of the library can be read; scores are taken as they are, so a BPE
file's merge ranks act as scores.

Null and empty texts have no ids. Decoding gives the text back exactly for models that do not normalise.
Repeated rows and null ids change nothing; texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import VocabularyParsingError
from ..operators.lattice import Lattice
from ..sources import protowire as W
from .common import short_batches

MARK = "▁"
UNKNOWN = 10.0
#: Words, of SHORT characters at most, that a worker remembers; longer ones are encoded where they stand.
CACHE = 200_000
SHORT = 64
MODEL = "piece_bpe_32k.model"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Model:
    def __init__(self, path: str):
        file = W.read_model(path)
        if file.charsmap or file.remove_extra_whitespaces:
            raise VocabularyParsingError("models that normalise texts are not supported")
        self.dummy_prefix = file.add_dummy_prefix
        self.bytes_of = {int(p.text[3:5], 16): i for i, p in enumerate(file.pieces) if p.kind == W.BYTE}
        self.unk = next((i for i, p in enumerate(file.pieces) if p.kind == W.UNKNOWN), 0)
        usable = {p.text: i for i, p in enumerate(file.pieces) if p.kind in (W.NORMAL, W.USER_DEFINED) and p.text}
        if any(MARK in t.lstrip(MARK) for t in usable):
            raise VocabularyParsingError("a piece has a marker inside")
        self.lines_apart = not any("\n" in t for t in usable)
        scores = [file.pieces[i].score for i in usable.values()] or [0.0]
        self.unk_score = min(scores) - UNKNOWN
        top = max(scores)
        value = {t: len(t) * top - 0.1 if file.pieces[i].kind == W.USER_DEFINED else file.pieces[i].score for t, i in usable.items()}
        self.lattice = Lattice(list(usable), [value[t] for t in usable], list(usable.values()), unknown=self.unk_score, missing=-1)
        self.surface = [
            bytes([int(p.text[3:5], 16)]) if p.kind == W.BYTE else b" \xe2\x81\x87 " if p.kind == W.UNKNOWN else b"" if p.kind == W.CONTROL else p.text.replace(MARK, " ").encode()
            for p in file.pieces
        ]
        self.known: dict[str, bytes] = {}

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, -1 - code point for unknown characters; where each word's begin."""
        edges, starts, _, ids, _ = self.lattice.paths(words)
        for i in np.flatnonzero(ids < 0).tolist():
            w = words[int(np.searchsorted(edges, i, side="right")) - 1]
            ids[i] = -1 - ord(w[starts[i]])
        return ids, edges

    def pack(self, words: list[str]) -> list[bytes]:
        """Ids of words as little-endian uint32."""
        flat, edge = self.best(words)
        blob, ends = flat.astype("<i4").tobytes(), (4 * edge).tolist()
        out = [blob[a:b] for a, b in zip(ends, ends[1:])]
        for i in np.unique(np.searchsorted(edge, np.flatnonzero(flat < 0), side="right") - 1).tolist():
            out[i] = self._with_bytes(flat[edge[i] : edge[i + 1]])
        return out

    def _with_bytes(self, ids: np.ndarray) -> bytes:
        out = []
        for i in ids.tolist():
            raw = chr(-1 - i).encode("utf-8", "replace") if i < 0 else b""
            out += [i] if i >= 0 else [self.bytes_of.get(b, self.unk) for b in raw] if self.bytes_of else [self.unk]
        return np.array(out, dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list(words)
        self.known.update(zip(new, self.pack(new)))

    def words(self, text: str) -> list[str]:
        """Parts of the marked text that no piece reaches across: cut before markers and, if no piece has one, line breaks."""
        if self.dummy_prefix and MARK not in text and text[0] not in " \n" and text[-1] != " " and "  " not in text:
            if not self.lines_apart or " \n" in text:
                return [MARK + w for w in text.split(" ")]
            return [w if w[0] == "\n" else MARK + w for w in text.replace("\n", " \n").split(" ")]
        return _WORD.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        split = [self.words(t) if t else [] for t in texts]
        out, at = [], 0
        while at < len(split):  # so many texts at once that the cache holds their words
            words: set[str] = set()
            first = at
            while at < len(split) and (at == first or len(words) + len(split[at]) <= CACHE):
                words.update(w for w in split[at] if len(w) <= SHORT)
                at += 1
            self.learn(words)
            get = self.known.get
            out += [b"".join([get(x) or self.pack([x])[0] for x in w]) for w in split[first:at]]
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return (raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """All columns of docs in the struct ``row``, and ids: array<int>; null texts give an empty array."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = model(path).encode(b.column(1).to_pylist())
            edges = np.cumsum([0] + [len(x) // 4 for x in ids])
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat)], names=["row", "ids"])

    short_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """All columns of rows in the struct ``row``, and text; a null array gives a null text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else model(path).decode(np.array(x, dtype="<u4").tobytes()) for x in b.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    short_batches(rows.sparkSession)
    own = rows.select(F.struct("*").alias("row"), F.col(ids).alias("i"))
    return own.mapInArrow(run, f"row {own.schema['row'].dataType.simpleString()}, text string")


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every document, decode the ids again, and return the digests of both."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = model(path).encode(texts)
            back = [model(path).decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
                    pa.array([x == (t or "") for x, t in zip(back, texts)], pa.bool_()),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"],
            )

    short_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
