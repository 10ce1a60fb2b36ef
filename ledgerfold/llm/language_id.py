"""Language identification in two steps: the family first, then the language inside it.

A text becomes the relative frequencies of its hashed byte trigrams (A-Z lower-cased, digits, signs and white space
folded into one blank). Families are told apart, and then the languages within the family that won, by one linear
support vector machine for each pair (one-versus-one), whose votes decide; ties go to the larger sum of margins.
Prediction is a lookup of one weight per trigram and machine, summed over the whole text.

The machines are fitted on the driver from a sample of ``per_language`` labelled documents of each language at most
(the smallest hashes of doc_id); the sample's features are made by the executors and have ``BUCKETS`` entries at most,
whatever the length of a text. Every labelled language is learned; the sample stays sparse, so that many languages fit on the driver.

Defined results: a null text or one without a letter is ``und`` with score 0; without any labelled row every text is.
Repeated rows give repeated results; only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import Texts, bounded_batches, chunks, map_arrow, release

UNDETERMINED = "und"
BUCKETS = 1 << 13
#: Families of ISO 639-1 codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi fo",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky",
    "indo_aryan": "hi ur bn pa mr gu ne",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "sinitic": "zh",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(65), *range(91, 97), *range(123, 128)]] = 32


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def trigrams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram that starts at each byte, and where those of each document end; a text is framed by blanks."""
    c = _FOLD[t.buf[: t.size]]
    before = np.concatenate([[np.uint32(32)], c[:-1]])
    after = np.concatenate([c[1:], [np.uint32(32)]])
    filled = np.flatnonzero(np.diff(t.offs))
    before[t.offs[filled]] = 32
    after[t.offs[filled + 1] - 1] = 32
    h = (before << np.uint32(16) | c << np.uint32(8) | after) * np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - 13), filled


@dataclass
class Sparse:
    """Rows of features: those of row k are idx[ends[k]:ends[k + 1]] with val there."""

    ends: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.ends)[rows]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.ends[:-1][rows] - ends[:-1], size) + np.arange(ends[-1])
        return Sparse(ends, self.idx[at], self.val[at])

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.val * w[self.idx])])
        return sums[self.ends[1:]] - sums[self.ends[:-1]]


def fit_svm(x: Sparse, y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent; the last one is the bias."""
    w, bias, a = np.zeros(BUCKETS), 0.0, np.zeros(y.size)
    rows = [(x.idx[p:q], x.val[p:q].astype(np.float64)) for p, q in zip(x.ends[:-1], x.ends[1:])]
    norm = [float(v @ v) + 1 + 0.5 / c for _, v in rows]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(y.size):
            at, v = rows[i]
            g = y[i] * (float(v @ w[at]) + bias) - 1 + a[i] * 0.5 / c
            new = max(a[i] - g / norm[i], 0.0)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[at] += step * v
                bias += step
                a[i] = new
    return np.append(w, bias)


def fit_sigmoid(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope under which 1 / (1 + exp(-slope * margin)) fits the labels best."""
    slopes = np.geomspace(0.25, 16, 25)
    return float(min(slopes, key=lambda s: np.logaddexp(0, -s * margin * y).sum()))


@dataclass
class Level:
    """The machines that tell classes apart; machine k decides between the classes of pairs[k]."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    slopes: np.ndarray

    @classmethod
    def fit(cls, x: Sparse, labels: np.ndarray) -> Level:
        classes = sorted(set(labels))
        pairs = list(combinations(range(len(classes)), 2))
        weights, slopes = np.zeros((len(pairs), BUCKETS + 1)), np.ones(len(pairs))
        for k, (a, b) in enumerate(pairs):
            mine = np.flatnonzero(np.isin(labels, [classes[a], classes[b]]))
            y, own = np.where(labels[mine] == classes[a], 1.0, -1.0), x.take(mine)
            weights[k] = fit_svm(own, y)
            slopes[k] = fit_sigmoid(own.dot(weights[k]) + weights[k, -1], y)
        return cls(classes, pairs, weights, slopes)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winning class of each row, and the least certainty of the machines that it won."""
        n, m = len(margins), len(self.classes)
        if m == 1:
            return np.zeros(n, dtype=int), np.ones(n)
        votes, sums, sure = np.zeros((n, m)), np.zeros((n, m)), np.ones((n, m))
        for k, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(self.slopes[k] * margins[:, k], -50, 50)))
            votes[:, a] += margins[:, k] >= 0
            votes[:, b] += margins[:, k] < 0
            sums[:, a] += margins[:, k]
            sums[:, b] -= margins[:, k]
            sure[:, a] = np.minimum(sure[:, a], p)
            sure[:, b] = np.minimum(sure[:, b], 1 - p)
        best = np.argmax(votes * 1e6 + np.tanh(sums / 1e3), axis=1)
        return best, sure[np.arange(n), best]


@dataclass
class Hierarchy:
    families: Level
    inside: dict[str, Level]

    @classmethod
    def fit(cls, x: Sparse, langs: np.ndarray) -> Hierarchy:
        fams = np.array([family(v) for v in langs])
        return cls(Level.fit(x, fams), {f: Level.fit(x.take(np.flatnonzero(fams == f)), langs[fams == f]) for f in sorted(set(fams))})

    def levels(self) -> list[Level]:
        return [self.families, *self.inside.values()]

    def table(self) -> np.ndarray:
        """Weights of all machines side by side: a row for each bucket, and the biases."""
        return np.ascontiguousarray(np.vstack([lv.weights for lv in self.levels()]).T, dtype=np.float32)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = len(self.families.pairs)
        fam, sure = self.families.decide(margins[:, :at])
        lang = np.empty(len(margins), dtype=object)
        for name, level in self.inside.items():
            mine = np.flatnonzero(fam == self.families.classes.index(name))
            best, p = level.decide(margins[mine, at : at + len(level.pairs)])
            lang[mine] = np.array(level.classes, dtype=object)[best]
            sure[mine] = np.minimum(sure[mine], p)
            at += len(level.pairs)
        return lang, sure


def _features(batch: pa.RecordBatch):
    for t in chunks(batch.column("text")):
        h, filled = trigrams(t)
        idx, val = [], []
        for k in range(t.offs.size - 1):
            count = np.bincount(h[t.offs[k] : t.offs[k + 1]], minlength=1)
            at = np.flatnonzero(count)
            idx.append(at.astype(np.int32))
            val.append((count[at] / max(1, count.sum())).astype(np.float32))
        yield {"lang": batch.column("lang")[t.rows], "idx": pa.array(idx, pa.list_(pa.int32())), "val": pa.array(val, pa.list_(pa.float32()))}


SCALE = 20.0


def fit(docs: DataFrame, per_language: int = 400) -> Hierarchy | None:
    """Learns from doc_id, text and lang of rows whose lang is not null; None if there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return None
    # a hash threshold that keeps about twice the sample of each language, so that the ranking sees few rows
    share = {row["lang"]: 2.0 * (per_language + 50) / row["count"] for row in counts}
    some = [F.lit(v) for lang, x in share.items() if x < 1 for v in (lang, x)]
    bound = F.coalesce(F.element_at(F.create_map(*some), F.col("lang")), F.lit(1.0)) if some else F.lit(1.0)
    h = F.xxhash64(F.col("doc_id").cast("string"))
    few = known.where((F.pmod(h, F.lit(1 << 30)) / float(1 << 30)) <= bound).select("doc_id", "text", "lang", h.alias("h"))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")))).where(F.col("r") <= per_language)
    rows = map_arrow(few.select("lang", "text"), _features, "lang string, idx array<int>, val array<float>").toArrow().combine_chunks()
    langs = np.array(rows["lang"].to_pylist())
    parts = [rows[c].combine_chunks() for c in ("idx", "val")]
    ends = np.concatenate([[0], np.cumsum(parts[0].value_lengths().to_numpy())])
    x = Sparse(ends, *(v.flatten().to_numpy() for v in parts))
    key = lambda k: (langs[k], *(v[ends[k] : ends[k + 1]].astype(kind).tobytes() for v, kind in ((x.idx, ">i4"), (x.val, ">f4"))))
    order = np.array(sorted(range(langs.size), key=key))
    x = x.take(order)
    model = Hierarchy.fit(Sparse(x.ends, x.idx, x.val * np.float32(SCALE)), langs[order])
    del rows, parts, x
    release()
    return model


def predict(docs: DataFrame, model: Hierarchy | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, lang_pred and score (0 to 1)."""
    bounded_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", lang_pred string, score double"
    table = model.table() if model else None

    def run(batch: pa.RecordBatch):
        for t in chunks(batch.column("__text")):
            n = t.offs.size - 1
            lang, sure = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
            letter = batch.column("__letter")[t.rows].fill_null(False).to_numpy(zero_copy_only=False)
            if table is not None and letter.any():
                h, filled = trigrams(t)
                margins = np.tile(table[-1].astype(np.float64), (n, 1))
                if table.shape[1]:
                    for m in range(table.shape[1]):  # one machine at a time: a column of weights stays in cache
                        total = np.add.reduceat(np.ascontiguousarray(table[:-1, m])[h], t.offs[filled], dtype=np.float64)
                        margins[filled, m] += SCALE * total / np.diff(t.offs)[filled]
                lang, sure = model.decide(margins)
                lang[~letter], sure[~letter] = UNDETERMINED, 0.0
            yield {**{c: batch.column(c)[t.rows] for c in keep}, "lang_pred": pa.array(lang, pa.string()), "score": sure}

    text = F.col("text")
    return map_arrow(docs.select(*keep, text.alias("__text"), text.rlike(r"\p{L}").alias("__letter")), run, schema)


def held_out(fold: int = 1, folds: int = 3):
    """Whether a document is of the fold that is not learned from; a null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from the documents that are not held out."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), per_language)
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, ("doc_id", "held_out"))
