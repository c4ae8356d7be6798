"""Vector bin packing of examples into fixed-length sequences.

A piece asks for a vector: tokens, segments (always 1) and loss-bearing tokens. A sequence has a limit on
each. The open sequence takes the piece whose vector, in units of the limits, has the largest dot product with what is left
in the sequence, until none fits; then, where examples may be cut, a piece is cut to fill the rest.

Which tokens bear loss: a column of spans (half-open ranges of code points, as chat formatting gives them for assistant
turns) says so; a token counts if it begins in a span, and the end mark counts if the text's last token does. Without the column a
document is taken as an instruction, its first line, and a response, the rest: a first line of at most ``PROMPT`` characters with
more text after it bears no loss, everything else does.

Examples are packed where they lie: each partition works through blocks of at most ``BLOCK`` pieces, so
memory is bounded, nothing is shuffled, and a lost executor costs one partition. Sequence ids hold the
partition number in their upper bits.

Null and empty texts are one token (the end mark). Rows are independent, so repeated rows and null ids are
packed like any others. Columns other than id, text and spans are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Limits of a sequence: tokens, segments and loss-bearing tokens.
LENGTH = 2048
SEGMENTS = 12
LOSS = 1920
END = 1
#: Characters that a first line may have to be an instruction.
PROMPT = 2000
BLOCK = 2048
#: Tokens left in a sequence for which a piece is cut.
LEAST_CUT = 8
CACHE = 150_000
#: What keeps a text from being cut at its white space: any but single spaces and line breaks.
_MEET = ["  ", "\n\n", " \n", "\n ", *(chr(c) for c in range(0x3001) if (chr(c).isspace() or re.match(r"\s", chr(c))) and c not in (0x0A, 0x20))]
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_of_symbol() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def engine(path: str):
    """An encoding with the ids of a byte-level BPE file, by a library that is about five times as fast as the file's own.

    It needs ids in the order of the merges, which is checked, and the pattern of such files. Added tokens are
    found in texts, as the file's own library does by default.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, byte = file["model"], byte_of_symbol()
    added = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file.get("added_tokens", ())):
        raise ValueError("added tokens that take in what is around them are not supported")
    ranks = {}
    for token, i in model["vocab"].items():
        if all(c in byte for c in token):
            ranks[bytes(byte[c] for c in token)] = i
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])):
        raise ValueError("the ids of this file do not follow its merges")
    merged = set(made)
    ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i in merged}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


class Encoder:
    """Token ids of texts as bytes of little-endian uint32, by a byte-level BPE with spaces in front of words.

    Such a tokenizer always starts a token at a single space or line break between two other characters, so
    a text is the concatenation of its pieces between them; pieces are encoded once and kept, the last used
    ``CACHE`` to 2 * ``CACHE`` of them. Texts where white space meets white space are encoded in one go.
    """

    def __init__(self, path: str):
        self.engine = engine(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line = self.engine.encode_ordinary("\n")
        self.added = sorted(self.engine.special_tokens_set)
        self.size = np.zeros(self.engine.n_vocab, dtype=np.int32)  # bytes of each token
        for i in range(self.engine.n_vocab):
            try:
                self.size[i] = len(self.engine.decode_single_token_bytes(i))
            except KeyError:  # a hole in the ids
                continue

    def whole(self, text: str) -> bytes:
        return np.asarray(self.engine.encode(text, allowed_special="all"), dtype="<u4").tobytes()

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins."""
        ends = np.cumsum(self.size[ids], dtype=np.int64)
        return ends - self.size[ids]

    def _pieces(self, text: str) -> list[str] | None:
        """The text's pieces, each with the line break before it; None if that is not how it is built."""
        if not text or text[0].isspace() or text[-1].isspace() or any(x in text for x in _MEET) or any(x in text for x in self.added):
            return None
        return text.replace("\n", " \n").split(" ")

    def _learn(self, words: list[str]) -> None:
        """Encodes pieces in one call, a line break between them; it is a token of its own before a non-space."""
        broken = [w[1:] if w[0] == "\n" else " " + w for w in words]
        ids = np.asarray(self.engine.encode_ordinary("\n".join(broken)), dtype="<u4")
        cuts = np.flatnonzero(ids == self.line[0])
        raw, line = ids.tobytes(), np.asarray(self.line, dtype="<u4").tobytes()
        starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]
        self.known.update((w, line + raw[a:b] if w[0] == "\n" else raw[a:b]) for w, a, b in zip(words, starts, ends))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self._pieces(t) for t in texts]
        used = set()
        for p in split:
            if p:
                used.update(p[1:])
        new = [w for w in used if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.older, self.known, new = self.known, {}, list(used)
        if len(new) > CACHE:  # an unusually rich batch: nothing is kept
            return [self.whole(t) for t in texts]
        fresh = []
        for w in new:
            old = self.older.get(w)
            if old is None:
                fresh.append(w)
            else:
                self.known[w] = old
        if fresh:
            self._learn(fresh)
        get = self.known.__getitem__
        return [self.whole(t) if p is None else self.whole(p[0]) + b"".join(map(get, p[1:])) for t, p in zip(texts, split)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bearing(encode: Encoder, text: str, ids: np.ndarray, spans: list | None) -> np.ndarray:
    """How many of the first k ids bear loss, for each k up to all; ids end with the end mark."""
    if spans is None:
        line = text.find("\n") + 1
        if not 0 < line <= PROMPT or line == len(text):
            return np.arange(len(ids) + 1)
        x = len(text[:line].encode("utf-8", "replace"))
        first = np.searchsorted(encode.starts(ids[: min(x + 1, len(ids) - 1)]), x)  # a token has a byte at least
        return np.maximum(np.arange(len(ids) + 1) - first, 0)
    begins = encode.starts(ids[:-1])
    plain = text.isascii()
    inside = np.zeros(len(ids), dtype=bool)
    for a, b in spans:
        x, y = (a, b) if plain else (len(text[:a].encode("utf-8", "replace")), len(text[:b].encode("utf-8", "replace")))
        inside[np.searchsorted(begins, x) : np.searchsorted(begins, y)] = True
    inside[-1] = len(ids) < 2 or inside[-2]
    return np.append(0, np.cumsum(inside))


def place(loss: list[np.ndarray], limit: np.ndarray, least_cut: int = 0, carry: bool = False) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Dot-product packing under limit (tokens, segments, loss-bearing tokens) of pieces.

    loss has for each piece how many of its first k tokens bear loss, for k from 0 to its size. Returns the
    sequences, each a list of (piece, from, to), and, if carry is set, what is left for later, the last sequence, apart. With
    least_cut, when nothing fits and at least so many tokens can be taken, a piece is cut to fill the rest.
    Ties go to the earlier piece; without cuts every piece must fit alone.
    """
    start = np.zeros(len(loss), dtype=np.int64)
    size = np.array([len(x) - 1 for x in loss], dtype=np.int64)
    bears = np.array([x[-1] for x in loss], dtype=np.int64)
    rows, done = np.arange(len(loss)), []
    own: list[tuple[int, int, int]] = []
    while len(rows):
        left, own = limit.astype(np.int64), []
        while len(rows) and left[1] >= 1:
            fits = (size[rows] <= left[0]) & (bears[rows] <= left[2])
            if fits.any():
                rest = left / limit
                score = size[rows] * (rest[0] / limit[0]) + rest[1] / limit[1] + bears[rows] * (rest[2] / limit[2])
                at = int(np.argmax(np.where(fits, score, -1.0)))
                r = int(rows[at])
                take = int(size[r])
                rows = np.delete(rows, at)
            else:
                most = lambda r: min(left[0], int(np.searchsorted(loss[r], loss[r][start[r]] + left[2], side="right")) - 1 - start[r], size[r])
                r = int(rows[-1])
                take = int(most(r))
                if take < left[0] and least_cut:  # the loss-bearing tokens bind: look for one that does not bear so much
                    r = int(rows[np.argmin(bears[rows] / size[rows])])
                    take = int(most(r))
                if not least_cut or take < least_cut:
                    break
            own.append((r, int(start[r]), int(start[r]) + take))
            cost = loss[r][start[r] + take] - loss[r][start[r]]
            left -= (take, 1, cost)
            start[r] += take
            size[r] -= take
            bears[r] -= cost
            if not size[r]:
                rows = rows[rows != r]
        if not own:
            raise ValueError("a piece exceeds the limits by itself")
        done.append(own)
    return (done[:-1], own) if carry and done else (done, [])


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    spans: str | None = None,
    vocabulary: str | None = None,
    length: int = LENGTH,
    segments: int = SEGMENTS,
    loss: int = LOSS,
    least_cut: int = LEAST_CUT,
) -> DataFrame:
    """One row per piece (SCHEMA). loss limits the loss-bearing tokens of a sequence; least_cut 0 keeps examples that fit whole.

    spans names a column of loss-bearing ranges, array<struct<start, end>>; a null or empty one bears none.
    """
    path = vocabulary or default_vocabulary()
    limit = np.array([length, segments, loss], dtype=float)
    cap = min(length, loss)
    own_spans = docs[spans].cast("array<struct<start:bigint,end:bigint>>").alias("spans") if spans else F.lit(None).cast("int").alias("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        made, rest = 0, []  # pieces to place: id, place in the example, bytes, tokens of the example, how much of them bears loss
        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] if found else [[]] * 8, schema=schema)

        def flush(last: bool) -> list[tuple]:
            nonlocal made, rest
            bins, over = place([p[4] for p in rest], limit, least_cut, carry=not last)
            out = []
            for own in bins:
                offset = 0
                for i, a, b in own:
                    doc, at, ids, n, bears = rest[i]
                    piece = ids[4 * a : 4 * b]
                    out.append((doc, at + a, b - a, zlib.crc32(piece), n, (part << 40) + made, offset, int(bears[b] - bears[a])))
                    offset += b - a
                made += 1
            rest = [(rest[i][0], rest[i][1] + a, rest[i][2][4 * a : 4 * b], rest[i][3], rest[i][4][a : b + 1] - rest[i][4][a]) for i, a, b in over]
            return out

        for batch in batches:
            out = []
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            given = [[(x["start"], x["end"]) for x in one or ()] for one in batch.column(2).to_pylist()] if spans else [None] * len(texts)
            for doc, t, one, ranges in zip(batch.column(0).to_pylist(), texts, encode(texts), given):
                one += END.to_bytes(4, "little")
                bears = bearing(encode, t, np.frombuffer(one, dtype="<u4"), ranges)
                n = len(one) // 4
                for start in range(0, n, cap):
                    end = min(start + cap, n)
                    rest.append((doc, start, one[4 * start : 4 * end], n, bears[start : end + 1] - bears[start]))
                if len(rest) >= BLOCK:
                    out += flush(False)
            yield rows(out)
        yield rows(flush(True))

    short_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text"), own_spans).mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
