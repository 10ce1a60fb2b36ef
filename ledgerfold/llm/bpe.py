"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

A text is cut into pretokens as the byte-level tokenizer does; each distinct pretoken is merged once. Its symbols' adjacent
pairs are the leaves of a segment tree whose nodes hold the smallest (rank, position), so the root names the leftmost
pair of lowest rank. A merge rewrites one symbol and updates three leaves (the merged pair's, its left neighbour's and the
one that it swallowed) with their ancestors, in logarithmic time, until the root holds no mergeable pair. The trees of many
pretokens of a like length stand side by side in one array and step together; a pretoken of more than ``LONG`` bytes has a tree of
its own (some 30 bytes of memory a byte), in which all pairs of the root's rank are merged at once.

Encoded pretokens are kept in a table of bounded size, keyed by a 64-bit hash and the length in bytes.
Defined results: a null text is empty (no ids); the added special token's string becomes its id, as in the tokenizers library's
default; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textops import PAD, Texts, bounded_batches, chunks, map_arrow, span_hashes

_NONE = np.int64(1) << 62
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_APOSTROPHE, _BLANK = 0x27, 0x20
#: Pretokens of more bytes are merged one by one.
LONG = 512


def byte_symbols() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    kind = np.full(0x110000, _OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, value in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(every[m.start()]), ord(every[m.end() - 1])
            kind[lo : hi + 1] = np.where(np.arange(lo, hi + 1) // 0x800 == 0x1B, _OTHER, value)
    return kind


class PairRanks:
    """Rank and result of a pair of symbols, by open addressing; arrays in, arrays out."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(left) * 6 + 16))))
        size = 1 << self.bits
        self.keys, self.rank = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.merged = merged.astype(np.int32)
        keys = left.astype(np.int64) << 32 | right
        # of a pair that is listed twice the last rank counts, as in a dictionary
        _, last = np.unique(keys[::-1], return_index=True)
        todo = np.sort(len(keys) - 1 - last)
        slot = self._slot(keys[todo])
        while todo.size:
            free = self.keys[slot] < 0
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(todo.size, dtype=bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.rank[slot[take]] = keys[todo[take]], todo[take]
            todo, slot = todo[~take], (slot[~take] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it isn't mergeable."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.rank[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & (self.keys.size - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def merge_all(symbols: np.ndarray, length: np.ndarray, ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Merges rows of symbols (rows x width, width a power of two; row k uses the first length[k]) until no pair
    is left. Returns symbols, -1 where one was swallowed."""
    rows, width = symbols.shape
    sym = symbols.astype(np.int32)
    at = np.arange(width)
    nxt = np.where(at[None, :] + 1 < length[:, None], at[None, :] + 1, -1).astype(np.int32)
    prv = np.tile(at.astype(np.int32) - 1, (rows, 1))
    tree = np.full((rows, 2 * width), _NONE, dtype=np.int64)
    r, c = np.nonzero(nxt >= 0)
    rank = ranks(sym[r, c], sym[r, c + 1])
    tree[r, width + c] = np.where(rank >= 0, rank * width + c, _NONE)
    level = width // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2

    flat, span = tree.reshape(-1), 2 * width

    def update(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        base, node = row * span, leaf + width
        flat[base + node] = value
        for _ in range(width.bit_length() - 1):
            node >>= 1
            below = base + 2 * node
            flat[base + node] = np.minimum(flat[below], flat[below + 1])

    def pair(row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = ranks(sym[row, left], sym[row, right])
        return np.where((rank >= 0) & (right >= 0), rank * width + left, _NONE)

    live = np.arange(rows)
    while live.size:
        root = tree[live, 1]
        live, root = live[root < _NONE], root[root < _NONE]
        if not live.size:
            break
        pos, rank = root % width, root // width
        gone = nxt[live, pos]
        after = nxt[live, gone]
        sym[live, pos], sym[live, gone] = ranks.merged[rank], -1
        nxt[live, pos] = after
        more = after >= 0
        prv[live[more], after[more]] = pos[more]
        update(live, gone.astype(np.int64), np.full(live.size, _NONE))
        update(live, pos, pair(live, pos, after))
        before = prv[live, pos]
        has = before >= 0
        if has.any():
            update(live[has], before[has].astype(np.int64), pair(live[has], before[has], pos[has]))
    return sym, sym >= 0


def merge_long(symbols: np.ndarray, ranks: PairRanks) -> np.ndarray:
    """Merges one long row of symbols. All pairs of the root's rank are merged from left to right in one step, with their leaves updated
    together; if a merge would make a pair that has to come before the others of that rank, the leftmost alone is merged."""
    n = symbols.size
    width = 1 << max(1, (n - 1).bit_length())
    none = np.int32((1 << 31) - 1)
    sym = symbols.astype(np.int32)
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    nxt[-1] = -1
    tree = np.full(2 * width, none, dtype=np.int32)
    for lo in range(0, n - 1, 1 << 20):
        rank = ranks(sym[lo : min(lo + (1 << 20), n - 1)], sym[lo + 1 : lo + 1 + (1 << 20)])
        tree[width + lo : width + lo + rank.size] = np.where(rank >= 0, rank, none)
    level = width // 2
    while level:
        np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2], out=tree[level : 2 * level])
        level //= 2

    def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of symbols of places left and right, none where one is missing."""
        rank = ranks(sym[left], sym[right])
        return np.where((rank >= 0) & (left >= 0) & (right >= 0), rank, none).astype(np.int32)

    while (rank := tree[1]) < none:
        node = np.ones(1, dtype=np.int64)
        while node[0] < width:
            node = np.stack([2 * node, 2 * node + 1], 1).reshape(-1)
            node = node[tree[node] == rank]
        at = node - width
        # of pairs that overlap every other one, from the left
        chain = np.concatenate([[True], at[1:] != nxt[at[:-1]]])
        first = np.flatnonzero(chain)
        at = at[(np.arange(at.size) - np.repeat(first, np.diff(np.append(first, at.size)))) % 2 == 0]
        while True:
            gone = nxt[at].astype(np.int64)
            after, before = nxt[gone].astype(np.int64), prv[at].astype(np.int64)
            old, old_gone = sym[at].copy(), sym[gone].copy()
            merged = ranks.merged[rank]
            early = [ranks(np.where(before >= 0, sym[before], -1), np.full(at.size, merged)), ranks(np.full(at.size, merged), np.where(after >= 0, sym[after], -1))]
            sym[at], sym[gone] = merged, -1
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at].astype(np.int64)
            left, right = pair(before, at), pair(at, after)
            if at.size == 1 or not any(((e >= 0) & (e < rank)).any() for e in (*early, left, right)):
                break
            sym[at], sym[gone], nxt[at] = old, old_gone, gone
            prv[after[after >= 0]] = gone[after >= 0]
            at = at[:1]
        tree[width + gone] = none
        tree[width + at] = right
        some = before >= 0
        tree[width + before[some]] = left[some]
        node = np.concatenate([gone, at, before[some]]) + width
        while node[0] > 1:
            node = np.unique(node >> 1)
            tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
    return sym[sym >= 0]


class Encoder:
    """A byte-level vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str, max_entries: int = 1 << 19):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], byte_symbols()
        vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = PairRanks(*(np.array([vocab[x] for x in xs], dtype=np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])))
        self.of_byte = np.zeros(256, dtype=np.int32)
        for ch, b in of.items():
            self.of_byte[b] = vocab[ch]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        pieces = {i: bytes(of[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.piece_len = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        self.max_entries = max_entries
        self._reset()

    def _reset(self) -> None:
        size = 4 * self.max_entries
        self.key, self.entry = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        self.count, self.stored = 0, 0
        self.start, self.ids = np.zeros(self.max_entries + 1, dtype=np.int64), np.zeros(4 * self.max_entries, dtype=np.int32)

    # pretokens

    def pretokens(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte positions where pretokens start and end, and the special id of each or -1."""
        n = t.size
        body = t.buf[:n]
        lead = np.flatnonzero((body & 0xC0) != 0x80)
        if lead.size == n:
            cp = body.astype(np.uint32)
        else:
            cp = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        m = cp.size
        if not m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        kind = char_classes()[cp]
        # where a text or what lies between special tokens begins: nothing is matched across
        border = np.zeros(m + 1, dtype=bool)
        doc = np.searchsorted(lead, t.offs)
        border[doc] = True
        forced, ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        inside = None
        if self.special:
            spans = self._specials(t)
            if spans:
                forced = np.searchsorted(lead, np.array([s for s, _, _ in spans]))
                stops = np.searchsorted(lead, np.array([e for _, e, _ in spans]))
                ids = np.array([i for _, _, i in spans])
                border[forced] = True
                border[stops] = True
                inside = np.zeros(m + 1, dtype=np.int32)
                np.add.at(inside, forced, 1)
                np.add.at(inside, stops, -1)
                inside = np.cumsum(inside[:-1]) > 0
        first = np.empty(m, dtype=bool)  # a run of one kind starts
        first[0] = True
        first[1:] = (kind[1:] != kind[:-1]) | border[1:m]
        start = first.copy()
        # white space: the last one of a run that a word follows stands apart; if it is a blank, it joins the word
        space = kind == _SPACE
        final = np.zeros(m, dtype=bool)
        final[:-1] = space[:-1] & ~space[1:] & ~border[1:m]
        start |= final
        joins = final & (cp == _BLANK)
        start[1:][joins[:-1]] = False
        # contractions: an apostrophe that begins a token, and one of these endings
        quote = np.flatnonzero(start & (cp == _APOSTROPHE))
        if quote.size:
            wide = np.concatenate([cp, np.zeros(2, np.uint32)])
            stop = np.concatenate([border[:m], [True, True, True]])
            one, two = wide[quote + 1], wide[np.minimum(quote + 2, m + 1)]
            fits1 = ~stop[quote + 1]
            fits2 = fits1 & ~stop[np.minimum(quote + 2, m + 1)]
            single = fits1 & np.isin(one, [ord(x) for x in "stmd"])
            double = fits2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            size = np.where(single, 2, np.where(double, 3, 0))
            hit = size > 0
            q, size = quote[hit], size[hit]
            start[q + 1] = False
            # what follows inside the same run of letters is a token of its own
            end = q + size
            start[end[end < m]] = True
        if inside is not None:
            start[inside] = False
            start[forced] = True
        at = np.flatnonzero(start)
        begin = lead[at]
        ends = np.append(begin[1:], n)
        special = np.full(at.size, -1, dtype=np.int32)
        if forced.size:
            special[np.searchsorted(at, forced)] = ids
        return begin, ends, special

    def _specials(self, t: Texts) -> list[tuple[int, int, int]]:
        whole, out = t.buf[: t.size].tobytes(), []
        if not any(s.encode() in whole for s in self.special):
            return out
        pattern = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True)))
        for k in range(t.offs.size - 1):
            base = int(t.offs[k])
            out += [(base + m.start(), base + m.end(), self.special[m[0].decode()]) for m in pattern.finditer(whole[base : t.offs[k + 1]])]
        return out

    # the table of encoded pretokens

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each key or -1, and the slot where the search ended."""
        mask = self.key.size - 1
        slot = (keys >> np.uint64(20)).astype(np.int64) & mask
        out = np.full(keys.size, -1, dtype=np.int64)
        todo = np.arange(keys.size)
        while todo.size:
            entry = self.entry[slot[todo]]
            hit = (entry >= 0) & (self.key[slot[todo]] == keys[todo])
            out[todo[hit]] = entry[hit]
            todo = todo[~hit & (entry >= 0)]
            slot[todo] = (slot[todo] + 1) & mask
        return out, slot

    def _insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = self.key.size - 1
        slot = (keys >> np.uint64(20)).astype(np.int64) & mask
        todo = np.arange(keys.size)
        while todo.size:
            free = self.entry[slot[todo]] < 0
            _, first = np.unique(slot[todo], return_index=True)
            take = np.zeros(todo.size, dtype=bool)
            take[first] = True
            take &= free
            done = todo[take]
            self.key[slot[done]], self.entry[slot[done]] = keys[done], entries[done]
            todo = todo[~take]
            slot[todo] = (slot[todo] + 1) & mask

    def _encode_new(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens, on end, and how many each has."""
        length = end - start
        counts = np.zeros(start.size, dtype=np.int64)
        flat: list[tuple[np.ndarray, np.ndarray]] = []
        power = np.where(length <= 1, 1, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
        for k in np.flatnonzero(power > LONG):
            out = merge_long(self.of_byte[buf[start[k] : end[k]]], self.ranks)
            counts[k] = out.size
            flat.append((np.array([k]), out))
        for width in np.unique(power[power <= LONG]):
            group = np.flatnonzero(power == width)
            step = max(1, (1 << 15) // int(width))
            for lo in range(0, group.size, step):
                g = group[lo : lo + step]
                at = start[g][:, None] + np.arange(width)
                sym = self.of_byte[buf[np.minimum(at, buf.size - 1)]]
                out, kept = merge_all(sym, length[g], self.ranks)
                kept &= np.arange(width) < length[g][:, None]
                counts[g] = kept.sum(1)
                flat.append((g, out[kept]))
        offs = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(offs[-1], dtype=np.int32)
        for g, values in flat:
            ids[spread(offs[g], counts[g])] = values
        return ids, counts

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the documents on end, and where those of each document start and the last one's end."""
        start, end, special = self.pretokens(t)
        if not start.size:
            return np.zeros(0, np.uint32), np.zeros(t.offs.size, np.int64)
        keys = span_hashes(t.buf, start, end) ^ (end - start).astype(np.uint64)
        entry, _ = self._find(keys)
        missing = np.flatnonzero((entry < 0) & (special < 0))
        extra_ids, extra_start = None, None
        if missing.size:
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            where = missing[first]
            ids, counts = self._encode_new(t.buf, start[where], end[where])
            if self.count + new.size > self.max_entries or self.stored + ids.size > self.ids.size:
                self._reset()
                entry[:] = -1  # what was found is encoded anew below
                if new.size > self.max_entries // 2 or ids.size > self.ids.size // 2 or special.size > new.size:
                    every = np.flatnonzero(special < 0)
                    new, first, back = np.unique(keys[every], return_index=True, return_inverse=True)
                    missing, where = every, every[first]
                    ids, counts = self._encode_new(t.buf, start[where], end[where])
            if new.size <= self.max_entries and ids.size <= self.ids.size:
                base = self.count
                self.start[base : base + new.size + 1] = self.stored + np.concatenate([[0], np.cumsum(counts)])
                self.ids[self.stored : self.stored + ids.size] = ids
                self._insert(new, np.arange(base, base + new.size, dtype=np.int32))
                self.count, self.stored = base + new.size, self.stored + ids.size
                entry[missing] = base + back
            else:  # one text with more distinct pretokens than the table holds
                extra_ids, extra_start = ids, np.concatenate([[0], np.cumsum(counts)])
                entry[missing] = back
        store, offs = (self.ids, self.start) if extra_ids is None else (extra_ids, extra_start)
        entry = np.maximum(entry, 0)
        counts = np.where(special >= 0, 1, offs[entry + 1] - offs[entry])
        out = store[np.minimum(np.repeat(offs[entry], counts) + ramp(counts), max(store.size - 1, 0))].astype(np.uint32)
        ends = np.cumsum(counts)
        if (special >= 0).any():
            at = np.flatnonzero(special >= 0)
            out[ends[at] - 1] = special[at]
        return out, np.concatenate([[0], ends])[np.searchsorted(start, t.offs)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        ids = ids.astype(np.int64)
        length = self.piece_len[ids]
        return self.piece_bytes[np.repeat(self.piece_at[ids], length) + ramp(length)].tobytes().decode("utf-8", errors="replace")


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, on end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if ends.size else 0) - np.repeat(ends - counts, counts)


def spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(start, counts) + ramp(counts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


def texts_of(strings: list[str]) -> Texts:
    """A Texts over Python strings, for small uses."""
    raw = [s.encode() for s in strings]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    buf = np.full(int(offs[-1]) + PAD, 0x20, dtype=np.uint8)
    buf[: offs[-1]] = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return Texts(slice(0, len(raw)), buf, offs)


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def run(batch: pa.RecordBatch):
        for t in chunks(batch.column("text")):
            ids, offs = encoder(tokenizer).encode(t)
            yield {"doc_id": batch.column("doc_id")[t.rows], "ids": pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32)))}

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def run(batch: pa.RecordBatch):
        coder = encoder(tokenizer)
        for t in chunks(batch.column("text")):
            ids, offs = coder.encode(t)
            docs_ids = [ids[offs[k] : offs[k + 1]] for k in range(offs.size - 1)]
            yield {
                "doc_id": batch.column("doc_id")[t.rows],
                "n_tokens": np.diff(offs),
                "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in docs_ids],
                "decoded_sha256": [hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in docs_ids],
            }

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
