"""Removal of word passages that stood earlier, by fixed-block anchors.

A repeat of ``width`` words holds, in its earlier copy, one whole block of the grid of ``width // 2`` words laid over each document.
So the index has the non-overlapping blocks of every document and nothing else, and is probed with every rolling window of
a block's length. Hits are anchors: a block of the grid, and windows elsewhere that equal it. Around anchors, and only there,
hits are extended to ``width`` words by fingerprints of the whole windows (96 bits); windows after the first of their kind are
repeats, and overlapping ones are maximal repeats together.

Three passes over one exchange of the texts: probes to the index, windows around anchors to their first owner, removal.
The index keeps 24 bits of a block's hash beside the group of keys it went to: a false hit costs an extension and no more.

Defined results: a null or blank text has no words; rows equal in doc_id and text count once and are all treated like the one; different
texts under one doc_id are ordered by text; a null doc_id comes first (of texts without one, that of the document group with the smallest number).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import Group, answer, ask, bits, by_target, dealt, kept_bytes, n_groups, pack_docs, planes, result_schema, told, unbits, unpack_docs, unplanes
from .textops import Texts

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _blocks(g: Group, block: int) -> tuple[np.ndarray, np.ndarray, list[tuple[Texts, np.ndarray]]]:
    """Of all rolling windows of a group: hash, whether on the grid; and the chunks with the word that each window starts at."""
    hashes, grid, where = [], [], []
    for t in g.chunks():
        h, whole = t.windows(block)
        at = np.flatnonzero(whole)
        hashes.append(h[at])
        grid.append((at - t.bounds[t.owner[at]]) % block == 0)
        where.append((t, at))
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(grid or [np.zeros(0, bool)]), where


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each kind of hash its first place, for each place its kind, and how many of each kind there are."""
    _, first, kind, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    return first, kind, count


def _probes(g: Group, block: int, groups: int):
    h, grid, where = _blocks(g, block)
    first, kind, count = _distinct(h)
    on_grid = np.bincount(kind[grid], minlength=first.size) > 0
    return h, where, first, kind, count, on_grid, by_target((h[first] % np.uint64(groups)).astype(np.int64), groups)


def _anchors(g: Group, block: int, groups: int, got: dict) -> list[tuple[Texts, np.ndarray]]:
    """The chunks of a group with a mask of the words at which a window around an anchor may start."""
    h, where, first, kind, count, on_grid, targets = _probes(g, block, groups)
    hit = count > 1
    for p, idx in targets:
        hit[idx] |= unbits(got[(1, p)], idx.size)
    out, at = [], 0
    for t, starts in where:
        mine = starts[hit[kind[at : at + starts.size]]]
        at += starts.size
        near = np.zeros(t.words[0].size + 1, dtype=np.int32)
        np.add.at(near, np.maximum(mine - block, t.bounds[t.owner[mine]] if mine.size else 0), 1)
        np.add.at(near, mine + 1, -1)
        out.append((t, np.cumsum(near[:-1]) > 0))
    return out


def _windows(g: Group, width: int, groups: int, got: dict):
    """Windows of the full width around anchors: a 96-bit fingerprint, the document, and the chunks they are in."""
    parts, where, base = [], [], 0
    for t, near in _anchors(g, width // 2, groups, got):
        h, whole = t.windows(width)
        at = np.flatnonzero(whole & near[: h.size])
        low = t.windows(width, seed=1)[0][at].astype(np.uint32) if at.size else np.zeros(0, np.uint32)
        parts.append((h[at], low, t.owner[at] + base))
        where.append((t, at))
        base += t.offs.size - 1
    h, low, owner = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, d) for k, d in enumerate((np.uint64, np.uint32, np.int64)))
    both = np.empty(h.size, dtype=[("h", "<u8"), ("low", "<u4")])
    both["h"], both["low"] = h, low
    order = np.lexsort((np.arange(h.size), low, h))
    s = both[order]
    new = np.ones(h.size, dtype=bool)
    new[1:] = s[1:] != s[:-1]
    first = np.sort(order[new])  # windows come in the order of documents and places, so these are the earliest
    return h, low, owner, where, first, by_target((h[first] >> np.uint64(40)).astype(np.int64) % groups, groups)


def dedup(docs: DataFrame, width: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row, and the columns of docs that keep names."""
    groups, block = n_groups(docs), width // 2
    texts = dealt(docs, groups, keep)

    def probe(g: Group) -> list[tuple[int, bytes]]:
        h, _, first, _, count, on_grid, targets = _probes(g, block, groups)
        part = (h[first] >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFF)
        flags = np.stack([on_grid, count > 1], 1)
        return [(p, np.array([idx.size], "<i8").tobytes() + planes(part[idx])[: 3 * idx.size] + bits(flags[idx].reshape(-1))) for p, idx in targets]

    def lookup(payloads: list[bytes]) -> list[bytes]:
        sizes = [int(np.frombuffer(x, "<i8", 1)[0]) for x in payloads]
        keys = np.concatenate([unplanes(x[8 : 8 + 3 * n] + bytes(n), "<u4", n, 0)[0] for x, n in zip(payloads, sizes)])
        flags = np.concatenate([unbits(x[8 + 3 * n :], 2 * n).reshape(n, 2) for x, n in zip(payloads, sizes)])
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(start, s.size))
        indexed = np.logical_or.reduceat(flags[order, 0], start)
        several = (size > 1) | np.logical_or.reduceat(flags[order, 1], start)
        hit = np.empty(s.size, dtype=bool)
        hit[order] = np.repeat(indexed & several, size)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return [bits(hit[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def extend(q: int, g: Group, got: dict) -> pa.Table:
        from .exchange import messages

        h, low, owner, _, first, targets = _windows(g, width, groups, got)
        rows = [(q, p, 0, pack_docs(g.order, owner[first[idx]]) + planes(h[first[idx]]) + planes(low[first[idx]])) for p, idx in targets]
        return messages(rows)

    def earliest(payloads: list[bytes]) -> list[bytes]:
        parts = []
        for x in payloads:
            ids, at = unpack_docs(x)
            h, at = unplanes(x, "<u8", ids.size, at)
            parts.append((ids, h, unplanes(x, "<u4", ids.size, at)[0]))
        ids, h, low = (np.concatenate([x[k] for x in parts]) for k in range(3))
        order = np.lexsort((ids, low, h))
        later = np.zeros(ids.size, dtype=bool)
        a, b = order[1:], order[:-1]
        later[a] = (h[a] == h[b]) & (low[a] == low[b])  # an equal window of a smaller doc_id: one group asks of a kind once
        ends = np.concatenate([[0], np.cumsum([x[0].size for x in parts])])
        return [bits(later[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def remove(q: int, g: Group, got: dict) -> pa.Table:
        h, low, owner, where, first, targets = _windows(g, width, groups, got)
        repeat = np.ones(h.size, dtype=bool)
        repeat[first] = False
        for p, idx in targets:
            repeat[first[idx]] = unbits(got[(2, p)], idx.size)
        cols: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept_text")}
        at = 0
        for t, starts in where:
            mine = starts[repeat[at : at + starts.size]]
            at += starts.size
            n = t.words[0].size
            cover = np.zeros(n + 1, dtype=np.int32)
            np.add.at(cover, mine, 1)
            np.add.at(cover, np.minimum(mine + width, n), -1)
            keep = np.cumsum(cover[:-1]) == 0
            for raw in joined(t, keep):
                cols["kept_sha256"].append(hashlib.sha256(raw).hexdigest())
                cols["kept_text"].append(raw)
            cols["n_words"].append(np.diff(t.bounds))
            cols["n_removed"].append(np.diff(np.concatenate([[0], np.cumsum(~keep)])[t.bounds]))
        ints = lambda xs: pa.array(np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64))
        table = pa.table({"doc_id": g.ids, "n_words": ints(cols["n_words"]), "n_removed": ints(cols["n_removed"]), "kept_sha256": pa.array(cols["kept_sha256"], pa.string()), "kept_text": pa.array(cols["kept_text"], pa.binary()).cast(pa.string())})
        return g.every_row(table)

    first_round = answer(ask(texts, probe), 1, lookup)
    second_round = answer(told(texts, first_round, extend, "q int, p int, kind int, payload binary"), 2, earliest)
    return told(texts, first_round.unionByName(second_round), remove, result_schema(docs, keep, RESULT))


def joined(t: Texts, keep: np.ndarray) -> list[bytes]:
    """The kept words of each document with one blank between."""
    start, end = t.words
    s, e = start[keep], end[keep]
    owner = t.owner[keep]
    inner = np.zeros(s.size, dtype=bool)
    inner[:-1] = owner[1:] == owner[:-1]
    buf = t.buf.copy()
    buf[e[inner]] = 0x20
    edge = np.zeros(t.size + 2, dtype=np.int32)
    np.add.at(edge, s, 1)
    np.add.at(edge, e + inner, -1)
    return kept_bytes(Texts(t.rows, buf, t.offs), np.cumsum(edge[: t.size]) > 0)
