"""N-gram Jaccard join by multiple-global-order prefix filtering.

A document's set is its distinct n-word shingles. If two sets reach the threshold, then under any global order of the
tokens the first token that they share stands early in both: what follows it in either set must make up the overlap that
the threshold needs. So a set shows only its first tokens, fewer to sets of its own size than to smaller ones, and
candidates meet on equal tokens and size classes. Three orders are used. The first puts common tokens last and
gives the candidates; the second breaks ties otherwise, and candidates that don't share enough under it are dropped; the
third ranks by the exact frequency among the sets of crowded tokens and replaces the first for them. What
passes is verified on the whole sets.

Commonness in the first two comes from all documents: ``BUCKETS`` hashed counters of all shingles, and the counts of the
most frequent tokens of the prefixes that these counters give. Orders only decide how much is compared, never what is linked.

Groups of copies are not expanded into pairs: equal sets are one node; each node is first verified against one leader,
the smallest node of its prefix tokens with which it shares most, and components of these links are formed; then
only nodes of different components are candidates. Where more than ``CROWD`` nodes of several components meet in one token and
size class, they are compared under the third order instead, whose first tokens are the rare ones that tell near copies
apart. Crowds too are first verified against leaders, the nodes with the fewest tokens of their own, in ``ROUNDS`` rounds, and
then only nodes outside a crowd's largest component against the others. Links between different sets that would not join
components are the only ones not looked at.

Shingles are 64-bit hashes, sets are told apart by 64 bits of hashes of them. Documents without words have an empty set and link
with nothing, as do null ids; rows that repeat an id are one document, each row's set counts as an alternative. Whole texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, bit_filter, components, cut, drop, may_hold, release, short_batches
from .hashing import Sorted, mix, shingle_set, text_words

#: Hashed counters of the corpus; their classes are broadcast, so their number is fixed.
BUCKETS = 1 << 16
#: Tokens in the prefixes of at least HOT_DOCS documents are put last, the commonest at the very end; the broadcast holds at most HOT of them.
HOT = 1 << 18
HOT_DOCS = 32
#: Ids of so many documents are broadcast.
FEW = 200_000
#: More nodes than that at one token and size class are compared under their own order.
CROWD = 64
#: Rounds in which the nodes of a crowd are verified against leaders.
ROUNDS = 2
_OTHER = np.uint64(0xD1B54A32D192ED03)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def _sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    hashes, edge = text_words([(t or "").encode("utf-8", "replace").lower() for t in texts])
    return [shingle_set(hashes[a:b], n) for a, b in zip(edge, edge[1:])]


def corpus_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents' shingles fall into each of the BUCKETS counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for s in _sets(b.column(0).to_pylist(), n):
                total += np.bincount((s >> _SHIFT).astype(np.int64), minlength=BUCKETS) if len(s) > 4096 else 0
                if len(s) <= 4096:
                    np.add.at(total, (s >> _SHIFT).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])

    found = docs.select("text").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[found["b"].to_numpy()] = found["n"].to_numpy()
    return out


def classes(counts: np.ndarray) -> np.ndarray:
    """Counter -> class of commonness: 0 up to the typical counter with its spread, then one more per doubling."""
    usual = np.median(counts) + 6 * np.sqrt(np.median(counts)) + 8
    return np.ceil(np.log2(np.maximum(counts / usual, 1))).astype(np.uint8)


def index(docs: DataFrame, n: int, num: int, den: int, rank, hot, prefixes_only: bool = False) -> DataFrame:
    """Per row: id, size, g (hash of the set), p1 and p2 (prefixes under the two orders).

    rank is a broadcast of ``classes``, hot one of (sorted tokens that come after all others, their classes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, last, later = rank.value, Sorted(hot.value[0]), np.append(hot.value[1], np.uint8(0))
        for b in batches:
            sizes, g, p1, p2 = [], [], [], []
            sets = _sets(b.column(1).to_pylist(), n)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            late = common[(flat >> _SHIFT).astype(np.int64)] + later[last.find(flat)]
            other = mix(flat ^ _OTHER)
            at = 0
            for s in sets:
                k = len(s)
                keep = k - -(-num * k // den) + 1 if k else 0
                c, o = late[at : at + k], other[at : at + k]
                at += k
                p1.append(s[np.argsort(c, kind="stable")[:keep]].view(np.int64))  # s is sorted by the first hash
                if not prefixes_only:
                    p2.append(s[np.lexsort((o, c))[:keep]].view(np.int64))
                    sizes.append(k)
                    g.append(_node(o))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, p)]).astype(np.int32)), pa.array(np.concatenate([*p, np.zeros(0, np.int64)]))) for p in (p1, p2)]
            if prefixes_only:
                yield pa.RecordBatch.from_arrays(lists[:1], names=["p1"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(g, pa.int64()), *lists], names=["id", "size", "g", "p1", "p2"])

    short_batches(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(run, "p1 array<long>" if prefixes_only else "id long, size long, g long, p1 array<long>, p2 array<long>")


def _node(other: np.ndarray) -> int:
    """A hash of a set, from the second hashes of its tokens."""
    total = np.array([other.sum(dtype=np.uint64) + np.uint64(len(other)), np.bitwise_xor.reduce(mix(other))]) if len(other) else np.zeros(2, np.uint64)
    return int(mix(total[:1] ^ mix(total[1:]))[0].view(np.int64))


def ordered_index(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``index`` with both measures of commonness, written."""
    sc = docs.sparkSession.sparkContext
    rank = sc.broadcast(classes(corpus_counts(docs, n)))
    none = sc.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.uint8)))
    seen = index(docs, n, num, den, rank, none, prefixes_only=True).select(F.explode("p1").alias("t"))
    often = cut(seen.groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") >= HOT_DOCS).select("t", F.floor(F.log2("c")).cast("int").alias("k")))
    least, held = 64, 0
    for r in sorted(often.groupBy("k").agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r.n
        least = r.k if held <= HOT else least
    found = often.where(F.col("k") >= least).toArrow()
    tokens = found["t"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    hot = sc.broadcast((tokens[order], (64 + found["k"].to_numpy()[order]).astype(np.uint8)))
    out = cut(index(docs, n, num, den, rank, hot))
    drop(often)
    for b in (rank, none, hot):
        b.destroy()
    release(docs.sparkSession)
    return out


def sets_of(docs: DataFrame, idx: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(g, s), written: the sets of the nodes, made again from the text of one document each.

    Few documents are picked by a broadcast of their ids, whose number is checked; else a bit set of the ids spares the others, and a join
    removes what passes by chance.
    """
    ids = cut(idx.where("id is not null").join(nodes, "g", "left_semi").groupBy("g").agg(F.min("id").alias("id")).select(F.xxhash64("id").alias("k")).distinct())
    rows = docs.where("id is not null").select(F.xxhash64("id").alias("k"), "text")
    few = ids.count() <= FEW
    if few:
        rows = rows.join(F.broadcast(ids), "k", "left_semi")
    wanted = docs.sparkSession.sparkContext.broadcast(None if few else bit_filter(ids, "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.flatnonzero(may_hold(wanted.value, b.column(0).to_numpy()))
            if not len(hit):
                continue
            found = _sets(b.column(1).take(pa.array(hit)).to_pylist(), n)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_node(mix(s ^ _OTHER)) for s in found], pa.int64()), lists], names=["g", "s"])

    out = cut(rows.mapInArrow(run, "g long, s array<long>").join(nodes, "g", "left_semi").groupBy("g").agg(F.first("s").alias("s")))
    wanted.destroy()
    drop(ids)
    return out


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The candidate pairs (a, b) whose sets reach the threshold."""
    both = pairs.join(sets.select(F.col("g").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("g").alias("b"), F.col("s").alias("y")), "b")
    inter = F.size(F.array_intersect("x", "y"))
    sized = both.select("a", "b", inter.alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return sized.where(F.lit(den) * F.col("i") >= F.lit(num) * (F.col("n") - F.col("i"))).select("a", "b").distinct()


def enough(c: Column, nx: Column, ny: Column, num: int, den: int) -> Column:
    """Whether sets of nx and ny tokens that share c prefix tokens may reach the threshold.

    The set whose prefix ends first has all it shares with the other's prefix in c, and the rest beyond its prefix.
    """
    beyond = lambda x: F.floor((num * x + den - 1) / den) - 1  # noqa: E731  size less the prefix
    return (c + F.greatest(beyond(nx), beyond(ny))) * (den + num) >= (nx + ny) * num


def second_order(pairs: DataFrame, idx: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that share enough prefix tokens under the second order too."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct()
    p = idx.join(ends, "g", "left_semi").groupBy("g").agg(F.first("size").alias("size"), F.first("p2").alias("p2"))
    x = p.select(F.col("g").alias("a"), F.col("size").alias("nx"), F.col("p2").alias("x"))
    y = p.select(F.col("g").alias("b"), F.col("size").alias("ny"), F.col("p2").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(apart(x), "a").join(apart(y), "b").where((shared > 0) & enough(shared, F.col("nx"), F.col("ny"), num, den)).select("a", "b").distinct()


def overlap(x: Column, y: Column, num: int, den: int) -> Column:
    """The least number of shared tokens that links sets of x and y tokens."""
    return F.floor((num * (x + y) + num + den - 1) / (num + den))


def shown(tokens: DataFrame, num: int, den: int) -> DataFrame:
    """(b, own) added to the tokens (t, g, size, pos, c) that a set shows to sets of size class b.

    To the classes of sets of its own size or smaller, so many of its first tokens that the first shared one is among
    them; own marks those that it shows to sets of its size or larger.
    """
    step = max(math.log(den / num) / 2, 1e-3)
    bucket = lambda x: F.floor(F.log(x.cast("double")) / step)
    size, pos = F.col("size"), F.col("pos")
    lowest = F.floor((num * size + den - 1) / den)
    each = tokens.withColumn("b", F.explode(F.sequence(bucket(lowest), bucket(size))))
    smallest = F.greatest(lowest, F.floor(F.exp(F.col("b") * step)))
    own = (F.col("b") == bucket(size)) & (pos <= size - overlap(size, size, num, den))
    return each.where(pos <= size - overlap(F.least(smallest, size), size, num, den)).withColumn("own", own)


def mixed(rows: DataFrame) -> DataFrame:
    """The rows of ``shown`` whose token and size class hold several components, with the number n of their nodes and their largest component, home."""
    each = rows.groupBy("t", "b", "c").agg(F.count("*").alias("n"), F.max("own").alias("any"))
    groups = each.groupBy("t", "b").agg(F.sum("n").alias("n"), F.max("any").alias("any"), F.max_by("c", F.struct("n", "c")).alias("home"), F.count("*").alias("k"))
    return rows.join(apart(groups.where("k > 1 and any").select("t", "b", "n", "home")), ["t", "b"])


def met(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) of rows of ``mixed``: of different components, the shorter set's own tokens against the longer's.

    The largest component of a token and size class is only joined with the nodes outside it.
    """
    x = rows.where("own").select("t", "b", F.col("g").alias("x"), F.col("size").alias("nx"), F.col("pos").alias("px"), F.col("c").alias("cx"), (F.col("c") == F.col("home")).alias("hx"))
    y = rows.select("t", "b", F.col("g").alias("y"), F.col("size").alias("ny"), F.col("pos").alias("py"), F.col("c").alias("cy"), (F.col("c") == F.col("home")).alias("hy"))
    rest = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    fits = f"cx <> cy and (nx < ny or nx = ny and x < y) and {den} * nx >= {num} * ny"
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("t", "b")]
    pair = lambda l, r: l.alias("l").join(r.alias("r"), [*same, F.expr(fits), rest >= overlap(F.col("nx"), F.col("ny"), num, den)]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pair(x.where("not hx"), y).unionByName(pair(x.where("hx"), y.where("not hy"))).distinct()


def leaders(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) that may join components of rows of ``mixed`` with the column alone: each node outside its crowd's largest
    component, with the node of that component and the one of the others that have the fewest tokens of their own."""
    who = F.struct("alone", "g", "size", "pos", "c")
    first = rows.groupBy("t", "b").agg(F.min(F.when(F.col("c") == F.col("home"), who)).alias("x"), F.min(F.when(F.col("c") != F.col("home"), who)).alias("y"))
    near = rows.where("c <> home").join(apart(first), ["t", "b"]).select("g", "size", "pos", "c", F.explode(F.array("x", "y")).alias("x"))
    rest = F.least(F.col("size") - F.col("pos"), F.col("x.size") - F.col("x.pos"))
    fits = f"c <> x.c and {den} * least(size, x.size) >= {num} * greatest(size, x.size)"
    return near.where(F.expr(fits) & (rest >= overlap(F.col("size"), F.col("x.size"), num, den))).select(F.least("g", "x.g").alias("a"), F.greatest("g", "x.g").alias("b")).distinct()


def by_rarity(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(t, g, size, pos, alone): the prefix tokens of sets under the order of their frequency among these sets; those that stand in one set
    only come first and are but counted, in alone."""
    each = sets.select("g", F.size("s").alias("size"), F.explode("s").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    ranked = each.join(apart(often), "t").groupBy("g", "size").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("a"))
    alone = F.col("size") - F.size("a")
    prefix = F.col("size") - F.floor((num * F.col("size") + den - 1) / den) + 1
    first = ranked.where(alone < prefix).select("g", "size", alone.alias("alone"), F.posexplode(F.slice("a", F.lit(1), (prefix - alone).cast("int"))).alias("i", "x"))
    return first.select(F.col("x.t").alias("t"), "g", "size", (F.col("alone") + F.col("i")).alias("pos"), "alone")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(idx, comps): per row id, size and node g; (g, component_id) of all nodes, component_id being the smallest id reachable.

    Links: den * |A & B| >= num * |A | B|.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    idx = ordered_index(docs, n, num, den)
    known = idx.where("id is not null and size > 0")
    fits = lambda x, y: (F.lit(den) * F.least(x, y) >= F.lit(num) * F.greatest(x, y))

    def linked(pairs: DataFrame) -> DataFrame:
        passed = cut(second_order(pairs, idx, num, den))
        sets = sets_of(docs, idx, passed.select(F.explode(F.array("a", "b")).alias("g")).distinct(), n)
        out = cut(verified(passed, sets, num, den))
        drop(passed, sets, pairs)
        release(docs.sparkSession)
        return out

    tokens = known.select("g", F.col("size").cast("int").alias("size"), F.posexplode("p1").alias("pos", "t"))
    twice = cut(tokens.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("t"))  # else all tokens are on disk twice
    shared = cut(tokens.join(twice, "t").distinct())
    drop(twice)

    lead = shared.groupBy("t").agg(F.min(F.struct("g", "size")).alias("x")).select("t", F.col("x.g").alias("lead"), F.col("x.size").alias("lsize"))
    led = shared.join(apart(lead), "t").where((F.col("g") != F.col("lead")) & fits(F.col("size"), F.col("lsize")))
    votes = led.groupBy("g", "size", "lead", "lsize").agg(F.count("*").alias("c")).where(enough(F.col("c"), F.col("size"), F.col("lsize"), num, den))
    links = linked(cut(votes.groupBy("g").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("a")).select("a", F.col("g").alias("b"))))

    def members() -> DataFrame:
        return components(links).select(F.col("id").alias("g"), F.col("component_id").alias("c"))

    def placed(rows: DataFrame, now: DataFrame) -> DataFrame:
        return cut(mixed(shown(rows.join(apart(now), "g", "left").withColumn("c", F.coalesce("c", "g")), num, den)))

    now = members()
    several = placed(shared, now)
    drop(shared)
    near = met(several.where(F.col("n") <= CROWD), num, den)
    crowds = several.where(F.col("n") > CROWD).select("g").distinct()
    if not crowds.isEmpty():
        sets = sets_of(docs, idx, crowds, n)
        ranked = cut(by_rarity(sets, num, den))
        crowded = placed(ranked, now)
        for _ in range(ROUNDS):
            found = linked(cut(leaders(crowded, num, den)))
            if found.isEmpty():
                break
            links = links.unionByName(found)
            drop(crowded)
            crowded = placed(ranked, members())
        near = cut(near.unionByName(met(crowded, num, den)).distinct())
        drop(sets, ranked, crowded)
    else:
        near = cut(near)
    drop(several)
    more = linked(near)

    several = known.groupBy("id").agg(F.min("g").alias("a"), F.max("g").alias("z")).where("a < z")  # an id's sets are one document
    same = known.join(apart(several.select("id", "a")), "id").select("a", F.col("g").alias("b")).where("a <> b")
    joined = components(links.unionByName(more).unionByName(same.distinct())).select(F.col("id").alias("g"), F.col("component_id").alias("c"))
    ids = known.groupBy("g").agg(F.min("id").alias("id")).join(joined, "g", "left").select("g", "id", F.coalesce("c", "g").alias("c"))
    least = ids.groupBy("c").agg(F.min("id").alias("component_id"))
    nodes = cut(idx.select("id", "size", "g"))
    comps = cut(ids.join(apart(least), "c").select("g", "component_id"))
    drop(idx)
    return nodes, comps


def query(docs: DataFrame) -> DataFrame:
    idx, comps = groups(docs, n=3, num=90, den=100)
    found = F.when(F.col("size") > 0, F.col("component_id"))
    return idx.join(apart(comps), "g", "left").select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce(found, "id")).alias("component_id"))


def keep(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group, the one with the smallest id; documents without words or alone stay. Of rows that agree in id, null or not, and text, one stays."""
    idx, comps = groups(docs, n=n, num=num, den=den)
    few = lambda ids: F.broadcast(ids) if ids.count() <= FEW else ids
    gone = few(cut(idx.where("id is not null and size > 0").join(apart(comps), "g").where("id <> component_id").select("id").distinct()))
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["id"], "left_anti")
    repeated = cut(idx.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    drop(idx, comps)
    if repeated.isEmpty():
        return left
    repeated = few(repeated)
    again = left["doc_id"].cast("long").eqNullSafe(repeated["id"])
    return left.join(repeated, again, "left_anti").unionByName(left.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.c + y.c - i)),
"""
SQL = (
    SQL.replace("WITH w", "WITH RECURSIVE w")
    + r"""r AS (SELECT doc_id AS a, doc_id AS b FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, CAST(m.c AS BIGINT) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
)
