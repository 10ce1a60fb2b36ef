"""Removal of byte passages that start in an earlier document, by suffix sorting of shards.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller doc_id. Strings
that are equal are brought to one shard: each window of ``length`` bytes belongs to the anchor in it, its k-gram with the
smallest hash, and windows of one anchor make a phrase (a run of up to length - k + 1 windows). Then

1. phrases are named: of equal phrases in one document group, and then in all, the one in the smallest doc_id stands for the others,
   which are repeats as a whole; anchors that no other document has, and those whose phrases are all equal, are settled by that;
2. of the others one copy of each phrase goes to its anchor's shard, where external induced sorting (induced_sort) brings
   their suffixes and common prefixes in order: windows with a common prefix of ``length`` bytes or more are equal, and those
   outside the smallest doc_id of their run are repeats. An anchor with more than ``hot`` distinct phrases (a passage that very
   many documents have, each with other neighbours) is split: its phrases fall into single windows, which go to shards by a hash of
   the whole window, so equal ones still meet and no anchor is one shard's;
3. repeats are removed from the texts.

Sorting a phrase once and not once a copy is what keeps shards small on a corpus of copies. Sorting takes about 80 bytes of memory
a symbol of the shard (the README has the figures). Phrase names compare 78 bits and more.

Defined results: a null text is empty; documents are judged by doc_id alone, so rows that share one don't repeat each other; a null doc_id is
smaller than any; texts are bytes, so a removal may cut a character (kept_text leaves such a piece out).
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import induced_sort
from .bpe import ramp
from .exchange import Group, answer, ask, bits, by_target, dealt, kept_bytes, messages, n_groups, pack_docs, planes, result_schema, told, unbits, unpack_docs, unplanes
from .textops import Texts, loads, mix, span_hashes

GRAM = 24
IN_MEMORY = 64 << 20
HOT = 1 << 15  # phrases of one anchor in one shard: 2.5 million symbols, some 200 MB
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
_U = np.uint64


def phrases_of(t: Texts, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of the documents: first window, number of windows, anchor's hash, document."""
    n, span = t.size, length - gram + 1
    long_enough = np.diff(t.offs) >= length
    if not long_enough.any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, _U), np.zeros(0, np.int64))
    at8 = loads(t.buf)
    h = mix(at8[:n] * _U(0x9E3779B97F4A7C15) + at8[8 : n + 8] * _U(0xD6E8FEB86659FD93) + at8[16 : n + 16] * _U(0xA0761D6478BD642F))
    least = (h & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)  # leftmost of the smallest
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[: least.size - width], least[width:])
        width *= 2
    if width < span:
        rest = span - width
        least = np.minimum(least[: least.size - rest], least[rest:])
    docs = np.flatnonzero(long_enough)
    count = np.diff(t.offs)[docs] - length + 1
    start = np.repeat(t.offs[docs], count) + ramp(count)
    owner = np.repeat(docs, count)
    anchor = (least[start] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(start.size, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return start[first], np.diff(np.append(first, start.size)), h[anchor[first]], owner[first]


class Named:
    """The phrases of a group, named: kinds of equal phrases, the first document of each, and which phrases repeat one."""

    def __init__(self, g: Group, length: int, groups: int):
        self.length, self.groups = length, groups
        self.chunks, parts, base = [], [], 0
        for t in g.chunks():
            start, windows, anchor, owner = phrases_of(t, length)
            self.chunks.append((t, start, windows))
            parts.append((anchor, span_hashes(t.buf, start, start + windows + length - 1), owner + base, windows))
            base += t.offs.size - 1
        cat = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        self.anchor, self.name, self.owner, self.windows = cat(0, _U), cat(1, _U), cat(2, np.int64), cat(3, np.int64)
        _, self.first, self.kind = np.unique(self.name, return_index=True, return_inverse=True)
        self.first_owner = self.owner[self.first]
        doc = g.order
        self.copied = doc[self.owner] > doc[self.first_owner][self.kind] if self.owner.size else np.zeros(0, bool)
        # an anchor is the least of many hashes: its upper bits are anything but even
        self.spread_anchor = mix(self.anchor * _U(0xC2B2AE3D27D4EB4F))
        # questions in the order of documents
        order = np.argsort(self.first, kind="stable")
        self.targets = [(p, order[idx]) for p, idx in by_target((self.spread_anchor[self.first][order] % _U(groups)).astype(np.int64), groups)]

    def verdicts(self, got: dict) -> np.ndarray:
        """Rows of three: kinds that an earlier document has, kinds that are to be sorted, and those of them whose anchor is hot."""
        flags = np.zeros((3, self.first.size), dtype=bool)
        for p, idx in self.targets:
            flags[:, idx] = unbits(got[(1, p)], 3 * idx.size).reshape(-1, 3).T
        return flags

    def units(self, wanted: np.ndarray, hot: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is to be sorted, in the order of the texts: kind, window it begins with, number of windows, first byte in its chunk; before these the units of each shard.
        A kind is one unit, or one a window if its anchor is hot."""
        kind = np.flatnonzero(wanted)
        kind = kind[np.argsort(self.first[kind], kind="stable")]
        single = hot[kind]
        count = np.where(single, self.windows[self.first[kind]], 1)
        kind, skip = np.repeat(kind, count), ramp(count)
        single = np.repeat(single, count)
        at = self.first[kind]
        size = np.where(single, 1, self.windows[at])
        target = (self.spread_anchor[at] % _U(self.groups)).astype(np.int64)
        start = np.zeros(at.size, dtype=np.int64)
        base = 0
        for t, begin, _ in self.chunks:
            here = np.flatnonzero((at >= base) & (at < base + begin.size))
            start[here] = begin[at[here] - base] + skip[here]
            base += begin.size
            one = here[single[here]]
            if one.size:
                target[one] = (mix(span_hashes(t.buf, start[one], start[one] + self.length)) % _U(self.groups)).astype(np.int64)
        return by_target(target, self.groups), kind, skip, size, start


def sort_shard(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> np.ndarray:
    """Phrases (doc_id, size, bytes on end) in; for all windows, phrase by phrase, whether an earlier document has them."""
    doc, size, data = (np.concatenate([p[k] for p in parts]) for k in range(3))
    ends = np.cumsum(size + 1)
    n = int(ends[-1])
    room = n + length + 64
    text = np.zeros(room, dtype=np.uint16) if 2 * room <= IN_MEMORY else np.memmap(tempfile.TemporaryFile(), np.uint16, "w+", shape=(room,))
    fill = np.ones(n, dtype=bool)
    fill[ends - 1] = False
    text[:n][fill] = data.astype(np.uint16) + 1
    owner = np.repeat(np.arange(doc.size, dtype=np.int32), size + 1)
    repeat = np.zeros(n, dtype=bool)

    def visit(place: np.ndarray, start: np.ndarray) -> None:
        mine = doc[owner[place]]
        least = np.minimum.reduceat(mine, start)
        repeat[place] = mine > np.repeat(least, np.diff(np.append(start, place.size)))

    induced_sort.equal_prefix_groups(text, n, length, visit)
    windows = size - length + 1
    return repeat[np.repeat(ends - size - 1, windows) + ramp(windows)]


def dedup(docs: DataFrame, length: int = 50, keep: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of every row, and the columns of docs that keep names."""
    groups = n_groups(docs)
    texts = dealt(docs, groups, keep)

    def name(g: Group) -> list[tuple[int, bytes]]:
        x = Named(g, length, groups)
        out = []
        for p, idx in x.targets:
            at = x.first[idx]
            key = (x.spread_anchor[at] >> _U(32)).astype(np.uint32)
            out.append((p, pack_docs(g.order, x.owner[at]) + planes(key) + planes(x.name[at])[: 5 * idx.size]))
        return out

    def settle(payloads: list[bytes]) -> list[bytes]:
        parts = []
        for raw in payloads:
            ids, at = unpack_docs(raw)
            n = ids.size
            key, at = unplanes(raw, "<u4", n, at)
            parts.append((ids, key, unplanes(raw[at : at + 5 * n] + bytes(3 * n), "<u8", n, 0)[0]))
        ids, key, label = (np.concatenate([x[k] for x in parts]) for k in range(3))
        order = np.lexsort((ids, label, key))
        k, s, d = key[order], label[order], ids[order]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        new = new_key | np.concatenate([[True], s[1:] != s[:-1]])
        starts = np.flatnonzero(new_key)
        sizes = np.diff(np.append(starts, k.size))
        distinct = np.add.reduceat(new.astype(np.int64), starts)
        spread = np.maximum.reduceat(d, starts) > np.minimum.reduceat(d, starts)
        first = np.flatnonzero(new)
        earlier = d > np.repeat(d[first], np.diff(np.append(first, k.size)))
        flags = np.empty((k.size, 3), dtype=bool)
        flags[order, 0] = earlier
        flags[order, 1] = new & np.repeat((distinct > 1) & spread, sizes)
        flags[order, 2] = np.repeat(distinct > hot, sizes)
        ends = np.concatenate([[0], np.cumsum([x[0].size for x in parts])])
        return [bits(flags[a:b].reshape(-1)) for a, b in zip(ends[:-1], ends[1:])]

    def send(q: int, g: Group, got: dict) -> pa.Table:
        x = Named(g, length, groups)
        _, wanted, split = x.verdicts(got)
        targets, kind, _, windows, start = x.units(wanted, split)
        base = np.cumsum([0, *(s.size for _, s, _ in x.chunks)])
        rows = []
        for p, idx in targets:
            at, size = x.first[kind[idx]], windows[idx] + length - 1
            data = []
            for (t, _, _), lo, hi in zip(x.chunks, base[:-1], base[1:]):  # at ascends, chunk by chunk
                here = np.flatnonzero((at >= lo) & (at < hi))
                data.append(t.buf[np.repeat(start[idx[here]], size[here]) + ramp(size[here])])
            rows.append((q, p, 0, pack_docs(g.order, x.owner[at]) + size.astype(np.uint8 if length + 200 < 256 else np.uint16).tobytes() + np.concatenate(data).tobytes()))
        return messages(rows)

    def shard(payloads: list[bytes]) -> list[bytes]:
        kind = np.uint8 if length + 200 < 256 else np.uint16
        parts = []
        for raw in payloads:
            ids, at = unpack_docs(raw)
            size = np.frombuffer(raw, kind, ids.size, at).astype(np.int64)
            parts.append((ids, size, np.frombuffer(raw, np.uint8, -1, at + ids.size * np.dtype(kind).itemsize)))
        repeat = sort_shard(parts, length)
        ends = np.concatenate([[0], np.cumsum([int((s - length + 1).sum()) for _, s, _ in parts])])
        return [bits(repeat[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def remove(q: int, g: Group, got: dict) -> pa.Table:
        x = Named(g, length, groups)
        copied, wanted, split = x.verdicts(got)
        n_windows = np.where(wanted, x.windows[x.first], 0)
        at_kind = np.cumsum(n_windows) - n_windows  # where the windows of a sorted kind are among the flags
        flags = np.zeros(int(n_windows.sum()), dtype=bool)
        targets, kind, skip, size, _ = x.units(wanted, split)
        for p, idx in targets:
            place = np.repeat(at_kind[kind[idx]] + skip[idx], size[idx]) + ramp(size[idx])
            flags[place] = unbits(got[(2, p)], place.size)
        whole = x.copied | copied[x.kind]
        sorted_at = np.where(whole | ~wanted[x.kind], -1, at_kind[x.kind])
        cols: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        base = 0
        for t, start, windows in x.chunks:
            mine = slice(base, base + start.size)
            base += start.size
            cover = np.zeros(t.size + 1, dtype=np.int32)
            w = whole[mine]
            np.add.at(cover, start[w], 1)
            np.add.at(cover, start[w] + windows[w] + length - 1, -1)
            some = np.flatnonzero(sorted_at[mine] >= 0)
            step = ramp(windows[some])
            hit = flags[np.repeat(sorted_at[mine][some], windows[some]) + step]
            place = (np.repeat(start[some], windows[some]) + step)[hit]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = t.offs[1:-1][t.offs[1:-1] < t.size]
            opens[inner] = gone[inner]  # a run ends with its document
            per = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[t.offs])
            cols["n_bytes"].append(np.diff(t.offs))
            cols["n_removed"].append(per(gone))
            cols["n_spans"].append(per(opens))
            for raw in kept_bytes(t, ~gone):
                cols["kept_sha256"].append(hashlib.sha256(raw).hexdigest())
                cols["kept_text"].append(raw.decode("utf-8", errors="ignore"))
        ints = lambda k: pa.array(np.concatenate(cols[k]).astype(np.int64) if cols[k] else np.zeros(0, np.int64))
        table = pa.table({"doc_id": g.ids, "n_bytes": ints("n_bytes"), "n_removed": ints("n_removed"), "n_spans": ints("n_spans"), "kept_sha256": pa.array(cols["kept_sha256"], pa.string()), "kept_text": pa.array(cols["kept_text"], pa.string())})
        return g.every_row(table)

    named = answer(ask(texts, name), 1, settle)
    sorted_ = answer(told(texts, named, send, "q int, p int, kind int, payload binary"), 2, shard)
    return told(texts, named.unionByName(sorted_), remove, result_schema(docs, keep, RESULT))
