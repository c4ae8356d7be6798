"""Line dedup by a deletion-neighbourhood join.

Lines (cut at line breaks) are compared as sequences of words, lower-cased in A-Z. A line with a word is removed if an earlier
line, in the order of (id, line number), is equal, or if both have at least ``NEAR`` words and are within one word edit
(insertion, deletion, substitution): one edit is then a fifth of a line at most, a similarity of 0.8 or more. Lines without
words always stay. Words are cut at white space, so a line of a text without spaces is one word: it goes if it is repeated exactly.

The deletion neighbourhood of a line is the line itself and the line without each of its words. Two lines
are within one edit exactly if they share a variant that either is one of the lines itself or lacks the word at the same
place of both; the join on the variants' hashes keeps the place. Nothing is paired within a group of equal variants: each line
meets the earliest one there, by a minimum that is combined before the shuffle, and the edit distance of the two is then verified on their
words.

Variants of long lines are only made where there can be a partner. If two lines differ by one edit, they share their
first or their last k words, k being the largest power of two with 2k at most the shorter length; so a line of more than ``SHORT`` words
goes on only if another, different line has the same first or last words. In shorter ones these would be two words, which lines share by
chance the more often the more there are; they have few variants and all go on. A variant goes on only if another line has it. Both tests are exact aggregations; bit sets, as large as the keys need, carry their results back to the texts, and what
passes them by chance changes nothing. Where the keys are too many for a broadcast, joins do it.

Line hashes have 96 bits. Null texts have no lines and stay null; empty tables give empty results; rows with a
null id are compared with each other and the rest, and come first; rows that agree in id and text are one
document, each returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, bit_filter, cut, drop, may_hold, release, short_batches
from .hashing import mix, text_words

LEAST = 1
NEAR = 5
#: Lines of at most so many words have all their variants made.
SHORT = 8
#: Lines that a task remembers having met.
MET = 1 << 17


def _line_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Word hashes of all lines, where each line's words begin, each line's text and number in it, and the lines."""
    lines = [(t or "").encode("utf-8", "replace").lower().split(b"\n") for t in texts]
    flat = [x for one in lines for x in one]
    hashes, edge = text_words(flat)
    sizes = [len(x) for x in lines]
    owner = np.repeat(np.arange(len(lines)), sizes)
    number = np.concatenate([np.arange(x) for x in sizes]) if sizes else owner
    return hashes, edge, owner, number, flat


class Ranges:
    """Hashes of any ranges of a sequence of word hashes, from prefix sums of a polynomial."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: np.ndarray, step: int):
        n = len(words) + 2
        if step not in self._powers or len(self._powers[step][0]) < n:
            size = 1 << (n - 1).bit_length()
            self._powers[step] = tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(size, x, dtype=np.uint64))) for x in (step, pow(step, -1, 1 << 64)))
        self.up, self.down = self._powers[step]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[1 : n - 1], dtype=np.uint64)])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of each words[a:b]."""
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + self.up[b - a + 1])


STEPS = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


def _without_each(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of the sequence without each of its words, as of ``Ranges``."""
    out, n = [], len(words)
    for step in STEPS:
        power = np.multiply.accumulate(np.full(n + 1, step, dtype=np.uint64))
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)])
        down = np.concatenate([np.zeros(2, np.uint64), np.cumsum(words[1:] * power[: n - 1], dtype=np.uint64)])  # each word one place lower
        out.append(mix(before[:n] + (down[n] - down[1 : n + 1]) + power[n - 1]))
    return out[0], out[1]


def _core(n: np.ndarray) -> np.ndarray:
    """The largest power of two at most n / 2."""
    return np.left_shift(1, np.floor(np.log2(np.maximum(n // 2, 1))).astype(np.int64))


def _cores(h: Ranges, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the first and last words that a line's partner may share: as the shorter line of a pair and as the longer one."""
    n = b - a
    own, less = _core(n), _core(n - 1)
    lines, found = [], []
    for k, at in ((own, np.flatnonzero(n >= SHORT)), (less, np.flatnonzero((n > SHORT) & (less != own)))):
        k, x, y = k[at], a[at], b[at]
        lines += [at, at]
        found += [h(x, x + k) ^ (2 * k).astype(np.uint64), h(y - k, y) ^ (2 * k + 1).astype(np.uint64)]
    return np.concatenate(lines), np.concatenate(found)


def _i64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=np.uint64).view(np.int64))


def _second(values: np.ndarray) -> pa.Array:
    return pa.array((values & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))


def _lists(sizes, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, key, line, h1, h2, n, cores) of each line of at least LEAST words, n being their number; docs has id, key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, edge, owner, number, _ = _line_words(b.column(2).to_pylist())
            kept = np.flatnonzero(np.diff(edge) >= LEAST)
            x, y = edge[kept], edge[kept + 1]
            one, two = (Ranges(words, step) for step in STEPS)
            lines, cores = _cores(one, x, y)
            order = np.argsort(lines, kind="stable")
            who = pa.array(owner[kept])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(who),
                    b.column(1).take(who),
                    pa.array(number[kept].astype(np.int32)),
                    _i64(one(x, y)),
                    _second(two(x, y)),
                    pa.array((y - x).astype(np.int32)),
                    _lists(np.bincount(lines, minlength=len(kept)), _i64(cores[order])),
                ],
                names=["doc", "key", "line", "h1", "h2", "n", "cores"],
            )

    short_batches(docs.sparkSession)
    return docs.select("id", "key", "text").mapInArrow(run, "doc long, key int, line int, h1 long, h2 int, n int, cores array<long>")


def variants(docs: DataFrame, cores: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, key, line, h1, h2, v1, v2, words) of short lines and of those with a core in cores: v1 and v2 hold the hashes without each word.

    A line that a task has met before comes with empty arrays and without words. cores is written, found holds the ``occurrences``.
    """
    rows = docs.select("id", "key", "text")
    bits = bit_filter(cores, "core")
    if bits is None:
        with_core = found.where(F.col("n") > SHORT).select("doc", "key", "line", F.explode("cores").alias("core")).join(cores, "core", "left_semi").select("doc", "key", "line")
        short = found.where(F.col("n").between(NEAR, SHORT)).select("doc", "key", "line")
        lines = with_core.unionByName(short).groupBy("doc", "key").agg(F.collect_set("line").alias("lines"))
        rows = rows.alias("d").join(lines.alias("l"), F.expr("d.id <=> l.doc and d.key = l.key")).select("d.*", "l.lines")
    wanted = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            words, edge, owner, number, lines = _line_words(b.column(2).to_pylist())
            one, two = (Ranges(words, step) for step in STEPS)
            if wanted.value is None:
                own = [set(x) for x in b.column(3).to_pylist()]
                kept = np.array([i for i, (o, k) in enumerate(zip(owner.tolist(), number.tolist())) if k in own[o]], dtype=np.int64)
            else:
                size = np.diff(edge)
                at = np.flatnonzero(size > SHORT)
                which, cores = _cores(one, edge[at], edge[at + 1])
                kept = np.union1d(at[which[may_hold(wanted.value, cores)]], np.flatnonzero((size >= NEAR) & (size <= SHORT)))
            x, y = edge[kept], edge[kept + 1]
            h1 = one(x, y)
            lists, sizes, texts = [np.zeros((2, 0), np.uint64)], [], []
            for i, h in enumerate(h1.tolist()):
                new = h not in met
                sizes.append(int(y[i] - x[i]) if new else 0)
                texts.append(b" ".join(lines[kept[i]].split()).decode("utf-8", "replace") if new else None)
                if new:
                    if len(met) >= MET:
                        met.clear()
                    met.add(h)
                    lists.append(np.stack(_without_each(words[x[i] : y[i]])))
            flat = np.concatenate(lists, axis=1)
            who = pa.array(owner[kept])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(who), b.column(1).take(who), pa.array(number[kept].astype(np.int32)), _i64(h1), _second(two(x, y)), _lists(sizes, _i64(flat[0])), _lists(sizes, _second(flat[1])), pa.array(texts, pa.string())],
                names=["doc", "key", "line", "h1", "h2", "v1", "v2", "words"],
            )

    short_batches(docs.sparkSession)
    out = cut(rows.mapInArrow(run, "doc long, key int, line int, h1 long, h2 int, v1 array<long>, v2 array<int>, words string"))
    wanted.destroy()
    return out


def met_variants(kept: DataFrame, shared: DataFrame) -> DataFrame:
    """(v1, v2, place, h1, h2): the variants that may be in shared (v), which is written, in long form; place -1 is the line itself."""
    bits = bit_filter(shared, "v")
    if bits is None:
        each = kept.where("size(v1) > 0").select("h1", "h2", F.posexplode(F.arrays_zip("v1", "v2")).alias("place", "x")).select("x.v1", "x.v2", "place", "h1", "h2")
        whole = kept.where("size(v1) > 0").select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), F.lit(-1).alias("place"), "h1", "h2")
        return each.unionByName(whole).join(shared.select(F.col("v").alias("v1")), "v1", "left_semi").select("v1", "v2", "place", "h1", "h2")
    wanted = kept.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v1, v2 = (b.column(k).flatten().to_numpy() for k in (2, 3))
            edge = b.column(2).offsets.to_numpy()
            edge = edge - edge[0]
            own = np.repeat(np.arange(b.num_rows), np.diff(edge))
            place = np.arange(len(v1)) - edge[own]
            hit = may_hold(wanted.value, v1)
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            whole = np.flatnonzero(may_hold(wanted.value, h1) & (np.diff(edge) > 0))
            who = np.concatenate([own[hit], whole])
            cols = (np.concatenate([v1[hit], h1[whole]]), np.concatenate([v2[hit], h2[whole]]), np.concatenate([place[hit], np.full(len(whole), -1)]).astype(np.int32), h1[who], h2[who])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["v1", "v2", "place", "h1", "h2"])

    return kept.select("h1", "h2", "v1", "v2").mapInArrow(run, "v1 long, v2 int, place int, h1 long, h2 int")


def within_one_edit(a: list, b: list) -> bool:
    """Whether the edit distance of two sequences is at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(h1, h2) of the pairs (h1, h2, p1, p2) of lines whose words (h1, h2, words) are within one edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [within_one_edit(x.split(" "), y.split(" ")) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in b.columns[:2]], names=["h1", "h2"])

    other = texts.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("words").alias("theirs"))
    both = pairs.join(texts, ["h1", "h2"]).join(other, ["p1", "p2"])
    return both.select("h1", "h2", "words", "theirs").mapInArrow(run, "h1 long, h2 int").distinct()


def near_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(h1, h2), written: the lines within one edit of an earlier one; found holds the ``occurrences``."""
    at = F.struct("doc", "key", "line")
    several = lambda rows, key: cut(rows.groupBy(key).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select(key))
    cores = several(found.select(F.explode("cores").alias("core"), "h1"), "core")
    kept = variants(docs, cores, found)
    drop(cores)
    shared = several(kept.where("size(v1) > 0").select(F.explode(F.concat("v1", F.array("h1"))).alias("v"), "h1"), "v")
    firsts = kept.groupBy("h1", "h2").agg(F.min(at).alias("first"))
    each = cut(met_variants(kept, shared).distinct().join(apart(firsts), ["h1", "h2"]))
    drop(shared)
    # the earliest line of each variant: among the lines without the word at that place, the line itself, and all
    who = F.struct("first", F.col("h1").alias("p1"), F.col("h2").alias("p2"))
    by_place = each.where("place >= 0").groupBy("v1", "v2", "place").agg(F.min(who).alias("e"))
    by_variant = each.groupBy("v1", "v2").agg(F.min(F.when(F.col("place") < 0, who)).alias("own"), F.min(who).alias("e"))
    without = each.where("place >= 0").join(apart(by_place), ["v1", "v2", "place"]).join(apart(by_variant.select("v1", "v2", "own")), ["v1", "v2"])
    pairs = without.select("h1", "h2", "first", F.explode(F.array("e", "own")).alias("x"))
    pairs = pairs.unionByName(each.where("place < 0").join(apart(by_variant.select("v1", "v2", F.col("e").alias("x"))), ["v1", "v2"]).select("h1", "h2", "first", "x"))
    pairs = cut(pairs.where(F.col("x.first") < F.col("first")).select("h1", "h2", "x.p1", "x.p2").distinct())
    drop(each)
    ends = cut(pairs.select(F.explode(F.array("h1", "p1")).alias("h1")).distinct())
    texts = _may_be(kept.where("words is not null").select("h1", "h2", "words"), bit_filter(ends, "h1"), 0).groupBy("h1", "h2").agg(F.min("words").alias("words"))
    texts = cut(texts)
    drop(kept, ends)
    out = cut(verified(pairs, texts))
    drop(pairs, texts)
    return out


def removed(docs: DataFrame) -> DataFrame:
    """(doc, key, lines), written: the numbers of the lines that go, per document."""
    at = F.struct("doc", "key", "line")
    found = cut(occurrences(docs))
    late = near_lines(docs, found)
    again = found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("c")).where("c > 1").select("h1", "h2", "first")
    gone = again.join(late.withColumn("late", F.lit(True)), ["h1", "h2"], "full")
    gone = cut(gone.select("h1", "h2", F.when(F.col("late"), F.lit(None)).otherwise(F.col("first")).alias("stays")))
    out = _may_be(found.select("doc", "key", "line", "h1", "h2"), bit_filter(gone, "h1"), 3).join(gone, ["h1", "h2"]).where(~F.coalesce(F.col("stays") == at, F.lit(False)))
    out = cut(out.groupBy("doc", "key").agg(F.array_sort(F.collect_set("line")).alias("lines")))
    drop(found, late, gone)
    release(docs.sparkSession)
    return out


def _may_be(rows: DataFrame, bits: np.ndarray | None, column: int) -> DataFrame:
    """The rows whose hash in the given column may be in a bit set."""
    wanted = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(wanted.value, b.column(column).to_numpy())))

    return rows if bits is None else rows.mapInArrow(run, rows.schema.simpleString()[len("struct<") : -1].replace(":", " "))


def _identity() -> Column:
    return F.xxhash64("id", "key")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs in the struct ``row``, the text without its removed lines, n_lines and n_removed.

    Only documents that may lose a line are shuffled to meet their line numbers.
    """
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.hash(text).alias("key"), F.col(text).alias("text"))
    gone = removed(base.select("id", "key", "text").where("text is not null"))
    bits = base.sparkSession.sparkContext.broadcast(bit_filter(gone.select(F.xxhash64("doc", "key").alias("k")), "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flag = may_hold(bits.value, b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(flag)], names=["row", "id", "key", "maybe"])

    kind = base.schema["row"].dataType.simpleString()
    marked = base.select("row", "id", "key", _identity().alias("k")).mapInArrow(run, f"row {kind}, id long, key int, maybe boolean")
    own = F.col(f"row.`{text}`")
    split = F.split(own, "\n")
    n_lines = F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines")
    some = marked.where("maybe")
    joined = some.join(gone, some["id"].eqNullSafe(gone["doc"]) & (some["key"] == gone["key"]), "left")
    less = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("lines", i)), "\n")
    changed = joined.select(
        "row", F.when(F.col("lines").isNull(), own).otherwise(less).alias("text"), n_lines, F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_removed")
    )
    return changed.unionByName(marked.where("not maybe").select("row", own.alias("text"), n_lines, F.lit(0).cast("long").alias("n_removed")))


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("row.doc_id", "text", "n_lines", "n_removed")


def keep(docs: DataFrame) -> DataFrame:
    """The documents with their new texts (and n_chars); those of which every word went, being repeated throughout, go."""
    done = dedup(docs)
    left = done.where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast("long")}
    return left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
