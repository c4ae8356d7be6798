"""Language identification by character language models.

One interpolated Kneser-Ney model per language over lower-cased letters, where every run of other
characters is one boundary symbol. The models share sorted hash arrays: for each order, the union of the
languages' n-grams with a row of log-probabilities, one per language, and the union of contexts with their
back-off weights. A text gets the language of the lowest cross-entropy per symbol.

Rejection is calibrated on labelled rows that the models have not seen. A text's excess over its language's mean
cross-entropy, divided by the spread that such an excess has at its length, is its strangeness; a text is rejected
if it is stranger than all but the share ``FALSE_REJECTIONS`` of the calibration rows, and than a normal law would let that share be.

The models are fitted on about ``TRAIN_ROWS`` labelled rows of every label and calibrated on ``CALIBRATION_ROWS`` more, of
``TRAIN_BYTES`` of text at most, so their size grows with the number of labels but not with the rows; prediction reads every
whole text, in blocks. Null texts and texts without a letter are ``und`` with score 0 and count as rejected; without any labelled
row every text is. Ties go to the first label in sorted order. Rows are judged one by one, so repeated rows and null ids change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, short_batches, unit
from .hashing import Sorted, mix

ORDER = 4
TRAIN_ROWS = 200
#: Labelled rows per label that only calibrate the rejection, and the share of them that it may reject.
CALIBRATION_ROWS = 300
FALSE_REJECTIONS = 0.005
#: A label with fewer rows that the model has not seen rejects nothing.
LEAST_HELD = 5
#: Bytes of text that a label's rows together have at most, as expected; longer single texts are not drawn.
TRAIN_BYTES = 4 << 20
#: Symbols that are looked up at once.
BLOCK = 1 << 17
SYMBOLS = 1024
UND = "und"
SCORED = 20.0
_STEP = 0x100000001B3 * 0x10001 | 1
_lower = None


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters as code points; each run of other characters, and the start, is one 0."""
    global _lower
    if _lower is None:
        _lower = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                _lower[c] = ord(low) if len(low) == 1 else c
    found = _lower[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    letters = found != 0
    found = found[letters | np.append(True, letters[:-1])] if len(found) else found
    return np.append(np.uint32(0), found) if len(found) and found[0] else found


def gram_hashes(seq: np.ndarray, order: int) -> np.ndarray:
    """Unmixed hashes of the n-grams that end at each position; before the start there are zeros."""
    c = seq.astype(np.uint64) + np.uint64(1)
    out = c.copy()
    for k in range(1, order):
        power = np.uint64(pow(_STEP, k, 1 << 64))
        out[k:] += c[:-k] * power
        out[:k] += power
    return out


class Counts:
    """Kneser-Ney counts of one language: per order, distinct n-grams with (context, suffix) hashes and counts."""

    def __init__(self, texts: list[np.ndarray]):
        cols = {k: [] for k in range(1, ORDER + 1)}
        for s in texts:
            for k in cols:
                cols[k].append(gram_hashes(s, k)[1:] if len(s) else s.astype(np.uint64))
        before = {k: [gram_hashes(s, k)[:-1] if len(s) else s.astype(np.uint64) for s in texts] for k in range(1, ORDER)}
        self.grams, self.count, self.context, self.suffix = {}, {}, {}, {}
        for k in range(ORDER, 0, -1):
            flat = np.concatenate(cols[k]) if cols[k] else np.zeros(0, np.uint64)
            keys, at, n = np.unique(flat, return_index=True, return_counts=True)
            self.grams[k] = keys
            self.suffix[k] = np.concatenate(cols[k - 1])[at] if k > 1 else np.zeros(len(keys), np.uint64)
            self.context[k] = np.concatenate(before[k - 1])[at] if k > 1 else np.zeros(len(keys), np.uint64)
            if k == ORDER:
                self.count[k] = n.astype(float)
            else:  # below the highest order an n-gram counts once for each symbol before it
                self.count[k] = np.bincount(np.searchsorted(keys, self.suffix[k + 1]), minlength=len(keys)).astype(float)


class Model:
    """The shared arrays of all languages."""

    def __init__(self, texts: dict[str, list[str]], calibration: dict[str, list[str]] | None = None, false_rejections: float = FALSE_REJECTIONS):
        self.langs = sorted(texts)
        known = lambda found: [s for s in map(symbols, found) if len(s) > 1]
        fit, held = {}, {}
        for lang in self.langs:
            fit[lang], held[lang] = known(texts[lang]), known((calibration or {}).get(lang, []))
            if not held[lang] and len(fit[lang]) >= 5 * LEAST_HELD:
                held[lang], fit[lang] = fit[lang][::5], [s for i, s in enumerate(fit[lang]) if i % 5]
        counts = [Counts(fit[lang]) for lang in self.langs]
        n = len(self.langs)
        self.keys, self.logp, self.contexts, self.backoff = {}, {}, {}, {}
        lower = np.full((1, n), 1.0 / SYMBOLS)
        lower_keys = np.zeros(1, np.uint64)
        for k in range(1, ORDER + 1):
            raw, first = np.unique(np.concatenate([c.grams[k] for c in counts]), return_index=True) if n else (np.zeros(0, np.uint64), [])
            suffix = np.concatenate([c.suffix[k] for c in counts])[first] if n else raw
            context = np.concatenate([c.context[k] for c in counts])[first] if n else raw
            ctx = np.unique(context)
            weight = np.ones((len(ctx), n))
            prob = np.zeros((len(raw), n))
            for j, c in enumerate(counts):
                n1, n2 = (c.count[k] == 1).sum(), (c.count[k] == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 else 0.5
                d = min(max(d, 0.1), 0.95)
                own = np.searchsorted(ctx, c.context[k])
                total = np.bincount(own, weights=c.count[k], minlength=len(ctx))
                kinds = np.bincount(own, minlength=len(ctx))
                seen = total > 0
                weight[seen, j] = d * kinds[seen] / total[seen]
                prob[np.searchsorted(raw, c.grams[k]), j] = np.maximum(c.count[k] - d, 0) / total[own]
            base = lower[np.searchsorted(lower_keys, suffix)] if k > 1 else lower[np.zeros(len(raw), int)]
            prob += weight[np.searchsorted(ctx, context)] * base
            lower, lower_keys = prob, raw
            order = np.argsort(mix(raw))
            self.keys[k], self.logp[k] = Sorted(mix(raw)[order]), np.log(prob[order]).astype(np.float32)
            order = np.argsort(mix(ctx))
            self.contexts[k], self.backoff[k] = Sorted(mix(ctx)[order]), np.log(weight[order]).astype(np.float32)
        self.calibrate(held, false_rejections)

    def calibrate(self, held: dict[str, list[np.ndarray]], false_rejections: float) -> None:
        """Mean and spreads of the cross-entropy of each language's rows, and the strangeness that the given share of them exceeds."""
        n = len(self.langs)
        self.mean, self.spread, self.between, self.limit = np.zeros(n), np.ones(n), np.full(n, np.inf), np.inf
        strange = []
        for j, lang in enumerate(self.langs):
            each = [self.steps(s)[:, j] for s in held[lang]]
            if len(each) < LEAST_HELD:
                continue
            ce, size = np.array([-x.mean() for x in each]), np.array([len(x) for x in each])
            long = size >= np.median(size)
            self.mean[j] = np.median(ce[long])
            self.spread[j] = np.std(np.concatenate(each)) + 1e-3
            self.between[j] = np.median(np.abs(ce - self.mean[j])[long]) / 0.6745  # of documents, robustly
            strange += [self.strangeness(c, k, j) for c, k in zip(ce, size)]
        if strange:
            strange, m = np.sort(strange), len(strange)
            usual = NormalDist().inv_cdf(1 - false_rejections) * (1 + 3 / np.sqrt(m))  # few rows say little about the spreads
            at = int(np.ceil((1 - false_rejections) * (m + 1))) - 1
            self.limit = max(usual, float(strange[min(at, m - 1)]))

    def strangeness(self, entropy: float, n: int, j: int) -> float:
        """Excess of a cross-entropy over n symbols, in its standard deviations for texts of the language."""
        return (entropy - self.mean[j]) / float(np.sqrt(self.spread[j] ** 2 / n + self.between[j] ** 2))

    def steps(self, seq: np.ndarray) -> np.ndarray:
        """Log-probability of each symbol after the first, per language."""
        out = np.zeros((len(seq) - 1, len(self.langs)), dtype=np.float32)
        todo = np.arange(len(out))
        for k in range(ORDER, 0, -1):
            at = self.keys[k].find(mix(gram_hashes(seq, k)[1:][todo]))
            hit = at >= 0
            out[todo[hit]] += self.logp[k][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if k > 1:
                at = self.contexts[k].find(mix(gram_hashes(seq, k - 1)[:-1][todo]))
            else:
                at = np.zeros(len(todo), np.int32) if len(self.contexts[1].keys) else np.full(len(todo), -1, np.int32)
            known = at >= 0
            out[todo[known]] += self.backoff[k][at[known]]
        out[todo] += np.float32(-np.log(SYMBOLS))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool], list[float | None]]:
        """Language, score, whether rejected, and cross-entropy of each text."""
        lang, score, rejected, entropy = [], [], [], []
        seqs = [symbols(t) if t else np.zeros(0, np.uint32) for t in texts]
        sums = self._sums(seqs)
        for s, total in zip(seqs, sums):
            n = len(s) - 1
            if n < 1 or not self.langs:
                lang.append(UND), score.append(0.0), rejected.append(True), entropy.append(None)
                continue
            ce = -total / n
            j = int(np.argmin(ce))
            share = np.exp(-(ce - ce[j]) * min(n, SCORED))
            lang.append(self.langs[j])
            score.append(float(1.0 / share.sum()))
            entropy.append(float(ce[j]))
            rejected.append(bool(self.strangeness(ce[j], n, j) > self.limit))
        return lang, score, rejected, entropy

    def _sums(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Summed log-probabilities per text; blocks of texts, each with the symbols before it, go through ``steps`` joined."""
        out = np.zeros((len(seqs), len(self.langs)))
        group: list[tuple[int, np.ndarray, int]] = []
        size = 0

        def flush() -> None:
            if not group:
                return
            steps = self.steps(np.concatenate([x for _, s, _ in group for x in (np.zeros(ORDER, np.uint32), s)]))
            at = -1
            for i, s, take in group:
                at += ORDER + len(s)
                out[i] += steps[at - take : at].sum(axis=0, dtype=np.float64)
            group.clear()

        for i, s in enumerate(seqs):
            for a in range(1, len(s), BLOCK):
                b = min(a + BLOCK, len(s))
                if size + b - a > BLOCK:
                    flush()
                    size = 0
                group.append((i, s[max(0, a - ORDER) : b], b - a))
                size += b - a + 2 * ORDER
        flush()
        return out


def train(rows: DataFrame, text: str = "text", lang: str = "lang", seed: str | None = "doc_id", per_lang: int = TRAIN_ROWS, calibration: int = CALIBRATION_ROWS, false_rejections: float = FALSE_REJECTIONS) -> Model:
    """A model from about per_lang + calibration labelled rows of each label, drawn by a hash of the seed column."""
    drawn = unit(F.col(seed) if seed else F.xxhash64(text), F.lit(71))
    base = rows.select(F.col(text).alias("t"), F.col(lang).alias("l"), drawn.alias("s"), F.octet_length(text).alias("b")).where("t is not null and l is not null").where(F.col("b") <= TRAIN_BYTES)
    most = F.least(F.lit(1.0), F.lit(float(per_lang + calibration)) / F.count("*"), F.lit(float(TRAIN_BYTES)) / F.greatest(F.sum("b"), F.lit(1)))
    fit: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    part = F.least(F.lit(0.8), F.lit(float(per_lang)) / F.count("*") / most) * most
    shares = base.groupBy("l").agg(most.alias("share"), part.alias("part"))
    found = base.join(F.broadcast(shares), "l").where(F.col("s") < F.col("share")).select("l", "t", (F.col("s") < F.col("part")).alias("fit")).toArrow()
    for b in found.to_batches():
        for label, t, first in zip(*(c.to_pylist() for c in b.columns)):
            (fit if first else held).setdefault(label, []).append(t)
    for lang in held:  # a label whose few rows all came out for calibration
        fit.setdefault(lang, held[lang])
    model = Model({k: sorted(v) for k, v in fit.items()}, {k: sorted(v) for k, v in held.items()}, false_rejections)
    del found, fit, held
    release(rows.sparkSession)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, rejected and cross_entropy; all columns of docs in the struct ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = shared.value.predict(b.column(1).to_pylist())
            made = [pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.float64(), pa.bool_(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["row", "lang_pred", "score", "rejected", "cross_entropy"])

    short_batches(docs.sparkSession)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double, rejected boolean, cross_entropy double")


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


def query(docs: DataFrame) -> DataFrame:
    rest = remainder(F.col("doc_id"))
    model = train(docs.where(rest != 1))
    return identify(docs.select("doc_id", "text"), model).select(
        "row.doc_id", F.coalesce(remainder(F.col("row.doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy"
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected; the models are fitted on the documents' own labels."""
    return identify(docs, train(docs)).where("not rejected").select("row.*")
