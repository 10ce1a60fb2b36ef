"""External suffix sorting by induction, with common-prefix lengths.

The text is a sequence of symbols in which 0 ends each string. Suffixes are of type S or L (smaller or larger than their
right neighbour); the leftmost S of each run (LMS) are sorted first, all others follow from them:

* popped in ascending order, a suffix names its left neighbour if that is of type L, which goes to the end of its symbol's
  queue; popped in descending order, likewise for type S. The queue of all pending tuples (symbol, place, common prefix) is a
  priority queue: the smallest (or largest) symbol comes first, and of one symbol the tuple that was pushed first. It keeps
  a bounded number of tuples in memory and writes full blocks to a temporary file of the task.
* a tuple's common prefix with the one pushed before it to the same symbol is one more than the smallest of those popped
  between their two sources; blocks are popped as arrays, and the minima over ranges of a block come from a sparse table.
* LMS suffixes are sorted by the same induction over their substrings, which names equal ones alike, and by recursion over the
  string of names, one level for each doubling of the names that are compared.

Only prefixes of ``cap`` symbols matter to the caller, so recursion ends when names cover them and lengths are counted up to cap.
The text can be an array on disk (numpy.memmap).
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

from .textops import loads, span_hashes

SYMBOLS = 257
MEMORY_TUPLES = 8_000_000


class TupleQueue:
    """Tuples (place, common prefix) by symbol; first in, first out within a symbol. Blocks go to disk beyond a number of tuples."""

    def __init__(self, limit: int = MEMORY_TUPLES):
        self.blocks: list[list] = [[] for _ in range(SYMBOLS)]
        self.limit, self.held, self.file = limit, 0, None

    def push(self, symbol: int, place: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[symbol].append((place, lcp))
        self.held += place.size
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for blocks in self.blocks:
            for k, b in enumerate(blocks):
                if len(b) == 2:
                    at = self.file.seek(0, 2)
                    self.file.write(b[0].tobytes())
                    self.file.write(b[1].tobytes())
                    blocks[k] = (at, b[0].size, b[0].dtype)
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that is pending for a symbol, in order; None if nothing is."""
        if not self.blocks[symbol]:
            return None
        out, self.blocks[symbol] = [self._load(b) for b in self.blocks[symbol]], []
        if len(out) == 1:
            return out[0]
        return np.concatenate([b[0] for b in out]), np.concatenate([b[1] for b in out])

    def _load(self, b):
        if len(b) == 2:
            self.held -= b[0].size
            return b
        at, n, kind = b
        self.file.seek(at)
        place = np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind)
        return place, np.frombuffer(self.file.read(n), np.uint8)


class RangeMin:
    """Minima over ranges of a small-number array."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        step = 1
        while 2 * step <= x.size:
            below = self.levels[-1]
            self.levels.append(np.minimum(below[: x.size - 2 * step + 1], below[step : x.size - step + 1]))
            step *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The minimum of x[lo:hi] for each pair, lo < hi."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(lo.size, dtype=self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            x = self.levels[k]
            out[at] = np.minimum(x[lo[at]], x[hi[at] - (1 << int(k))])
        return out


class Induction:
    """Pushes the left neighbours of popped blocks to their symbols, in order, with common prefixes."""

    def __init__(self, text: np.ndarray, small: np.ndarray, type_s: bool, cap: int, queue: TupleQueue):
        self.text, self.small, self.type_s, self.cap, self.queue = text, small, type_s, cap, queue
        self.low = np.full(SYMBOLS, cap, dtype=np.uint8)  # smallest common prefix popped since the last push to a symbol
        self.seen = np.zeros(SYMBOLS, dtype=bool)

    def feed(self, place: np.ndarray, lcp: np.ndarray) -> None:
        left = place - 1
        t = np.flatnonzero((left >= 0) & (self.small[left] == self.type_s))
        if not t.size:
            np.minimum(self.low, lcp.min(), out=self.low)
            return
        left = left[t]
        symbol = self.text[left]
        order = np.argsort(symbol, kind="stable")
        t, left, symbol = t[order], left[order], symbol[order]
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        ends = np.append(first[1:], t.size)
        minima = RangeMin(lcp)
        own = np.zeros(t.size, dtype=np.uint8)
        inner = np.ones(t.size, dtype=bool)
        inner[first] = False
        inner = np.flatnonzero(inner)
        if inner.size:
            own[inner] = np.minimum(minima(t[inner - 1] + 1, t[inner] + 1), self.cap - 1) + 1
        heads = symbol[first]
        lead = np.minimum(self.low[heads], minima(np.zeros(first.size, np.int64), t[first] + 1))
        own[first] = np.where(self.seen[heads], np.minimum(lead, self.cap - 1) + 1, 0)
        whole = lcp.min()
        np.minimum(self.low, whole, out=self.low)
        tail = t[ends - 1] + 1
        self.low[heads] = self.cap
        some = tail < lcp.size
        if some.any():
            self.low[heads[some]] = minima(tail[some], np.full(int(some.sum()), lcp.size))
        self.seen[heads] = True
        for a, b in zip(first.tolist(), ends.tolist()):
            self.queue.push(int(symbol[a]), left[a:b], own[a:b])


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S; the last one is."""
    n = text.size
    small = np.empty(n, dtype=bool)
    small[-1] = True
    step = np.sign(np.diff(text.astype(np.int16)))
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    small[:-1] = np.where(following < n, step[np.minimum(following, n - 2)] > 0, False) if n > 1 else True
    return small


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffix pairs up to cap, by direct comparison (text is padded by cap + 8 symbols)."""
    at8 = loads(text.view(np.uint8))
    out = np.full(a.size, cap, dtype=np.uint8)
    todo = np.arange(a.size)
    for k in range(0, cap, 4):
        x = at8[2 * (a[todo] + k)] ^ at8[2 * (b[todo] + k)]
        end = np.flatnonzero(x)
        if end.size:
            bit = x[end] & (~x[end] + np.uint64(1))
            out[todo[end]] = np.minimum(cap, k + (np.log2(bit.astype(np.float64)).astype(np.int64) >> 4))
            todo = np.delete(todo, end)
        if not todo.size:
            break
    return out


def induce(text: np.ndarray, n: int, small: np.ndarray, lms: np.ndarray, lms_lcp: np.ndarray, cap: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, a symbol at a time: places, and the common prefix of each with the one before it."""
    bounds = np.searchsorted(text[lms], np.arange(SYMBOLS + 1))
    queue, larger = TupleQueue(limit), TupleQueue(limit)
    step = Induction(text, small, False, cap, queue)

    def joint(last: int, first: int) -> np.uint8:
        return common_prefix(text, np.array([last]), np.array([first]), cap)[0]

    for c in range(SYMBOLS):
        last = None
        while (block := queue.pop(c)) is not None:
            place, lcp = block
            larger.push(c, place, lcp)
            step.feed(place, lcp)
            last = int(place[-1])
        if bounds[c] < bounds[c + 1]:
            place, lcp = lms[bounds[c] : bounds[c + 1]], lms_lcp[bounds[c] : bounds[c + 1]].copy()
            lcp[0] = 0 if last is None else joint(last, int(place[0]))
            step.feed(place, lcp)
    queue = TupleQueue(limit)
    step = Induction(text, small, True, cap, queue)
    end = np.array([n - 1])
    for c in range(SYMBOLS - 1, -1, -1):
        places, lcps, last = [], [], None
        while (block := queue.pop(c)) is not None:
            place, lcp = block
            step.feed(place, lcp)
            places.append(place)
            lcps.append(lcp)
            last = int(place[-1])
        if (block := larger.pop(c)) is not None:
            place, lcp = block[0][::-1], np.append(block[1][1:], np.uint8(0))[::-1].copy()
            lcp[0] = 0 if last is None else joint(last, int(place[0]))
            step.feed(place, lcp)
            places.append(place)
            lcps.append(lcp)
        if c == 0:  # the last suffix has no right neighbour that could name it
            places.append(end)
            lcps.append(np.zeros(1, np.uint8))
        if places:
            yield np.concatenate(places), np.concatenate(lcps)


def sort_names(names: np.ndarray, span: int, cap: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names, compared over the first names that cover cap symbols; span: symbols that a name covers at least."""
    if span >= cap or names.size < 2 or names.max() == names.size - 1:
        return names
    return _double(names, 1, span, cap)


def _double(names: np.ndarray, width: int, span: int, cap: int) -> np.ndarray:
    after = np.zeros_like(names)
    after[:-width] = names[width:] + 1
    pairs, ranks = np.unique(names << 32 | after, return_inverse=True)
    if 2 * width * span >= cap or pairs.size == names.size or 2 * width >= names.size:
        return ranks
    return _double(ranks, 2 * width, span, cap)


def sorted_suffixes(text: np.ndarray, n: int, cap: int, limit: int = MEMORY_TUPLES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of text[:n] (its last symbol is 0, more zeros follow) in descending order of their first cap symbols, as blocks of one leading symbol:
    places, and the common prefix (up to cap) of each with the one before it; 0 for the first of a block."""
    body = text[:n]
    small = types(body)
    lms = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]]))
    by_symbol = lms[np.argsort(body[lms], kind="stable")]
    none = np.zeros(lms.size, dtype=np.uint8)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = np.concatenate([place[is_lms[place]] for place, _ in induce(text, n, small, by_symbol, none, cap, limit)])[::-1]
    nxt = np.append(lms[1:], n - 1)
    number = np.zeros(n, dtype=np.int32)
    number[lms] = np.arange(lms.size)
    digest = span_hashes(text.view(np.uint8), 2 * lms, 2 * (nxt + 1))
    d = digest[number[ordered]]
    new = np.concatenate([[0], np.cumsum(d[1:] != d[:-1])])
    names = np.empty(lms.size, dtype=np.int64)
    names[number[ordered]] = new
    ranks = sort_names(names, 2, cap + 2)
    order = lms[np.argsort(ranks, kind="stable")]
    lcp = np.zeros(order.size, dtype=np.uint8)
    lcp[1:] = common_prefix(text, order[:-1], order[1:], cap)
    yield from induce(text, n, small, order, lcp, cap, limit)


def equal_prefix_groups(text: np.ndarray, n: int, cap: int, visit: Callable[[np.ndarray, np.ndarray], None], limit: int = MEMORY_TUPLES) -> None:
    """Calls visit with places of suffixes and where each group of equal first cap symbols starts among them; groups of one are left out."""
    for place, lcp in sorted_suffixes(text, n, cap, limit):
        same = lcp >= cap
        member = same.copy()
        member[:-1] |= same[1:]
        if member.any():
            visit(place[member], np.flatnonzero(~same[member]))
