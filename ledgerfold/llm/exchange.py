"""Questions and answers between groups of documents and groups of keys.

The substring operators ask, of each of many small things in a text (an anchor, a window), what other texts have of it.
Documents are dealt to groups of about ``GROUP_BYTES`` of text by a hash of doc_id. A group packs its questions to each group of keys
into one binary row; the answer is a binary row with some bits for each question in the order asked. As a group's rows are
put in a fixed order first, no question has to carry its place in a text, and re-run tasks ask the same.

Before asking, a group settles what it can by itself, so a key that a third of all documents have is asked about
once a group and not once an occurrence. All passes over the texts read one exchange of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Texts, bounded_batches, chunks, release

GROUP_BYTES = 6 << 20
MESSAGE = "q int, p int, kind int, payload binary"


def n_groups(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(12, -(-total // GROUP_BYTES))


def dealt(docs: DataFrame, groups: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns of keep as one (only if there are any) and the group q. Rows without a doc_id are dealt by text."""
    bounded_batches(docs.sparkSession)
    key = F.coalesce(F.xxhash64("doc_id"), F.xxhash64("text"))
    rest = [F.struct(*keep).alias("keep")] if keep else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *rest, F.pmod(key, F.lit(groups)).cast("int").alias("q"))


def result_schema(docs: DataFrame, keep: tuple[str, ...], columns: str) -> str:
    return ", ".join([columns, *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)])


class Group:
    """The documents of a group ordered by doc_id and text (nulls first); equal ones stand once."""

    def __init__(self, table: pa.Table):
        table = table.select([c for c in ("doc_id", "text", "keep") if c in table.column_names]).combine_chunks()
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        table = table.take(order).combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        text = table.column("text").combine_chunks()
        n = len(ids)
        new = np.ones(n, dtype=bool)
        if n > 1:
            filled = np.asarray(ids.fill_null(-(1 << 63)))
            near = np.flatnonzero(filled[1:] == filled[:-1])
            for k in near:
                new[k + 1] = text[k + 1] != text[k]
        first = np.flatnonzero(new)
        self.rest = table.column("keep").combine_chunks() if "keep" in table.column_names else None
        self.back = np.cumsum(new) - 1  # of each row, its place among the different ones
        self.ids, self.text = ids.take(pa.array(first)), text.take(pa.array(first))
        self.order = np.asarray(self.ids.fill_null(-(1 << 63)))

    def chunks(self):
        return chunks(self.text, 1 << 20)

    def every_row(self, table: pa.Table) -> pa.Table:
        """A table of the different rows, for all rows and with the columns that were kept."""
        if self.back.size > len(table):
            table = table.take(pa.array(self.back))
        for k in range(self.rest.type.num_fields if self.rest is not None else 0):
            table = table.append_column(self.rest.type.field(k).name, pc.struct_field(self.rest, k))
        return table


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all lowest ones first: what varies little is compressed away."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(a.size, a.itemsize).T.tobytes()


def unplanes(raw: bytes, kind, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n), at + n * size


def pack_docs(ids: np.ndarray, owner: np.ndarray) -> bytes:
    """The doc_id of each question, as the documents that ask and how often each does; owner ascends."""
    at, counts = np.unique(owner, return_counts=True)
    some = ids[at]
    return np.array([at.size, owner.size], dtype="<i8").tobytes() + planes(np.diff(some, prepend=0)) + planes(counts.astype("<i4"))


def unpack_docs(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    docs, n = np.frombuffer(raw, "<i8", 2, at)
    delta, at = unplanes(raw, "<i8", int(docs), at + 16)
    counts, at = unplanes(raw, "<i4", int(docs), at)
    return np.repeat(np.cumsum(delta), counts), at


def by_target(target: np.ndarray, groups: int) -> list[tuple[int, np.ndarray]]:
    """For each group of keys that is asked, the questions to it, in order."""
    order = np.argsort(target, kind="stable")
    ends = np.searchsorted(target[order], np.arange(groups + 1))
    return [(p, order[ends[p] : ends[p + 1]]) for p in range(groups) if ends[p] < ends[p + 1]]


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    q, p, kind, data = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"q": pa.array(q, pa.int32()), "p": pa.array(p, pa.int32()), "kind": pa.array(kind, pa.int32()), "payload": pa.array(data, pa.binary())})


def ask(docs: DataFrame, fn: Callable[[Group], list[tuple[int, bytes]]]) -> DataFrame:
    """fn gives (group of keys, payload) pairs."""

    def run(key, table):
        q = key[0].as_py()
        out = messages([(q, p, 0, data) for p, data in fn(Group(table))])
        release()
        return out

    return docs.groupBy("q").applyInArrow(run, MESSAGE)


def answer(asked: DataFrame, kind: int, fn: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """fn answers all payloads of a group of keys at once, in order."""

    def run(key, table):
        table = table.sort_by("q")
        p, q = key[0].as_py(), table.column("q").to_pylist()
        out = messages([(a, p, kind, data) for a, data in zip(q, fn(table.column("payload").to_pylist()))])
        release()
        return out

    return asked.groupBy("p").applyInArrow(run, MESSAGE)


def told(docs: DataFrame, answers: DataFrame, fn: Callable[[int, Group, dict], pa.Table], schema: str) -> DataFrame:
    """fn gets the group's number, the group, and answers as payloads by (kind, p)."""

    def run(key, left, right):
        got = {(k, p): data for k, p, data in zip(*(right.column(c).to_pylist() for c in ("kind", "p", "payload")))}
        out = fn(key[0].as_py(), Group(left), got)
        release()
        return out

    return docs.groupBy("q").cogroup(answers.groupBy("q")).applyInArrow(run, schema)


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def kept_bytes(t: Texts, keep: np.ndarray) -> list[bytes]:
    """Of each text the bytes where keep holds."""
    ends = np.concatenate([[0], np.cumsum(keep)])[t.offs]
    data = t.buf[: t.size][keep].tobytes()
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
