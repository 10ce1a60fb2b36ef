"""Maximal periodic runs of words, found by string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and ``POWER`` periods long, that no neighbouring word extends.

Periods up to ``LEAST / POWER`` are detected directly: one comparison of the words with themselves q places on. Longer periods are found scale by scale. A
scale a (a power of two, and one and a half of it) is for the periods above a and up to 1.5 a. Its synchronising set has the places i whose window of a words hashes to
the least of the windows that begin at i to i + a/2, or whose last such window does. Whether a place belongs to it is decided by the 1.5 a words from i on alone, so places recur with the period
of the run they stand in. Windows that lie in a run of a period up to a third of the window are left out of the minimum, or such regions would be all
places; these runs are known by then, from the direct detection or a smaller scale.

Why none is missed: let a run have the smallest period q, a < q <= 1.5 a. The 2 a - 1 words from its start on can't all lie in windows of a period below a / 3 (the run would have a
smaller period), so its first a / 2 places hold a place i of the set; i + q + 1.5 a words are inside the run, so i + q is in the set too, with the same context of 1.5 a words.
No place between has this context, as it is a whole rotation of a primitive word. The nearest earlier place with an equal context therefore proposes q.

Proposals are extended to both sides by prefix hashes of two moduli, and what comes out is compared word by word. All documents of a chunk are searched at once, with a word between
them that occurs nowhere else.

Defined results: a null or empty text has no words and no run; rows are independent, so repeated, null or tied ids make no difference; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import Texts, binaries, bounded_batches, chunks, map_arrow, mix

LEAST, POWER = 24, 3
_U = np.uint64
_TOP = ~_U(0)
_K = _U(0x9E3779B97F4A7C15)
_MODULI = ((2147483647, 1287643211), (2147483629, 912837465))


def joined_hash(left: np.ndarray, right: np.ndarray, at: int) -> np.ndarray:
    """Hashes of windows made of one of left and the one of right that begins at words later."""
    n = max(right.size - at, 0)
    return mix(left[:n] * _K ^ right[at:])


def stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    step = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    m = x
    while 2 * size <= width:
        m = np.minimum(m[: m.size - size], m[size:])
        size *= 2
    return np.minimum(m[: x.size - width + 1], m[width - size : x.size - size + 1]) if size < width else m


class Extensions:
    """How far two places of a sequence agree, to both sides."""

    def __init__(self, x: np.ndarray):
        self.n, self.parts = x.size, []
        for p, base in _MODULI:
            power = np.ones(x.size + 1, dtype=_U)
            known, step = 1, _U(base)
            while known <= x.size:
                more = min(known, x.size + 1 - known)
                power[known : known + more] = power[:more] * step % _U(p)
                step, known = step * step % _U(p), 2 * known
            sums = np.zeros(x.size + 1, dtype=_U)
            np.cumsum(x % _U(p) * power[:-1] % _U(p), out=sums[1:])
            self.parts.append((_U(p), power, sums))

    def same(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether size words from a and from b on (a < b, both inside) are equal."""
        ok = np.ones(a.size, dtype=bool)
        for p, power, sums in self.parts:
            ok &= (sums[a + size] - sums[a]) % p * power[b - a] % p == (sums[b + size] - sums[b]) % p
        return ok

    def reach(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs a < b, the words that agree before them and from them on."""
        left, right = np.zeros(a.size, dtype=np.int64), np.zeros(a.size, dtype=np.int64)
        step = 1 << max(self.n - 1, 0).bit_length()
        while step:
            k = np.flatnonzero(b + right + step <= self.n)
            k = k[self.same(a[k] + right[k], b[k] + right[k], step)]
            right[k] += step
            k = np.flatnonzero(a - left - step >= 0)
            k = k[self.same(a[k] - left[k] - step, b[k] - left[k] - step, step)]
            left[k] += step
            step //= 2
        return left, right


def runs_of(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, length, period) rows, by start and period, of the runs of a sequence of word hashes. ends: the end of each document, in the order of their places;
    documents are kept apart by words of their own."""
    found = [np.zeros((0, 3), dtype=np.int64)]

    def keep(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        ok = end - start >= np.maximum(LEAST, POWER * period)
        rows = np.unique(np.stack([start, end - start, period], axis=1)[ok], axis=0)
        exact = [bool((x[s : s + n - q] == x[s + q : s + n]).all()) for s, n, q in rows.tolist()]
        found.append(rows[np.array(exact, dtype=bool)])

    for q in range(1, LEAST // POWER + 1):
        s, e = stretches(x[:-q] == x[q:])
        keep(s, e + q, np.full(s.size, q))
    longest = int(np.diff(ends, prepend=0).max())
    h = {1: mix(x.copy())}
    reach, size = None, 1
    while POWER * size < longest:
        h[2 * size] = joined_hash(h[size], h[size], size)
        size *= 2
        h.pop(size // 16, None)
        octave = size // 2  # the octave below has its windows by now, those of size too
        if octave < LEAST // POWER:
            continue
        half, quarter = octave // 2, octave // 4
        for a, window, context in (
            (octave, h[octave], joined_hash(h[octave], h[half], octave)),
            (octave + half, joined_hash(h[octave], h[half], octave), joined_hash(h[size], h[quarter], size)),
        ):
            if POWER * a >= longest:
                break
            if a >= LEAST:
                known = np.concatenate(found)
                few = known[(POWER * known[:, 2] <= a) & (known[:, 1] >= a)]
                if few.size:
                    window = np.where(covered(window.size, few[:, 0], few[:, 0] + few[:, 1] - a + 1), _TOP, window)
            gap = a // 2
            least = sliding_min(window, gap + 1)
            n = min(least.size, context.size)
            place = np.flatnonzero(((least[:n] == window[:n]) | (least[:n] == window[gap : gap + n])) & (least[:n] != _TOP))
            doc = np.searchsorted(ends, place, side="right")
            inside = place + a + gap <= ends[doc]
            place, doc = place[inside], doc[inside]
            key = mix(context[place] ^ mix(doc.astype(_U) + _K))
            order = np.argsort(key, kind="stable")
            first, second = place[order[:-1]], place[order[1:]]
            period = second - first
            ok = (key[order[1:]] == key[order[:-1]]) & (period > a) & (2 * period <= 3 * a)
            if ok.any():
                reach = reach or Extensions(x)
                first, second, period = first[ok], second[ok], period[ok]
                left, right = reach.reach(first, second)
                keep(first - left, second + right, period)
    rows = np.unique(np.concatenate(found), axis=0)  # of one stretch the smallest period comes first
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_documents(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document of each run, ascending, and its (start, length, period). Words of document k are bounds[k] to bounds[k + 1]. Documents of about one length are
    searched together, so a short one isn't carried through the scales of a long one."""
    size = np.diff(bounds)
    owner, rows = [np.zeros(0, dtype=np.int64)], [np.zeros((0, 3), dtype=np.int64)]
    level = np.where(size >= LEAST, np.log2(np.maximum(size, 1) / LEAST).astype(np.int64) // 2, -1)
    for k in range(int(level.max(initial=-1)) + 1):
        docs = np.flatnonzero(level == k)
        if not docs.size:
            continue
        count = size[docs]
        first = np.cumsum(count + 1) - count - 1  # a word stands after each document
        place = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        x = mix(np.arange(int((count + 1).sum()), dtype=_U) + _U(0xD1B54A32D192ED03))
        x[place] = words[np.repeat(bounds[docs], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        found = runs_of(x, first + count)
        at = np.searchsorted(first, found[:, 0], side="right") - 1
        found[:, 0] -= first[at]
        owner.append(docs[at])
        rows.append(found)
    doc, row = np.concatenate(owner), np.concatenate(rows)
    order = np.lexsort((row[:, 2], row[:, 0], doc))
    return doc[order], row[order]


def joined_words(t: Texts, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: bytes on end, and where each document's begin."""
    start, end = (side[keep] for side in t.words)
    doc = t.owner[keep]
    size = end - start + 1  # with a space behind
    after = np.cumsum(size)
    out = t.buf[np.repeat(start - after + size, size) + np.arange(size.sum())]
    out[after - 1] = 0x20
    last = np.ones(doc.size, dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    drop = after[last] - 1  # no space behind the last word of a document
    count = np.bincount(doc, weights=size, minlength=t.offs.size - 1).astype(np.int64) - (np.bincount(doc, minlength=t.offs.size - 1) > 0)
    return np.delete(out, drop), np.concatenate([[0], np.cumsum(count)])


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and then period) and kept_text of every row of documents (doc_id, text): the words joined by one
    space, without those that some run contains after its first period."""
    bounded_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch):
        for t in chunks(batch.column("text")):
            doc, rows = runs_of_documents(t.word_hashes, t.bounds)
            first = t.bounds[doc] + rows[:, 0]
            gone = covered(t.word_hashes.size, first + rows[:, 2], first + rows[:, 1])
            text, offs = joined_words(t, ~gone)
            items = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
            yield {
                "doc_id": batch.column("doc_id")[t.rows],
                "n_words": np.diff(t.bounds),
                "runs": pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(t.offs.size)), pa.int32()), items),
                "kept_text": binaries(text, offs).cast(pa.string()),
            }

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string")
