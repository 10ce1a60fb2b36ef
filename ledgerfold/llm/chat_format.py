"""Chat formatting of typed content parts, with a loss mask.

``Flattener`` visits the parts of a message (text, image, audio, document) in order and gives one ordered text, in which
an attachment is a placeholder, the attachments referred to, and the tokens that the placeholders expand to. The
template marks turns as ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. Whatever looks like a control string in a
text or a role (``<|``, or one that is escaped already) gets one more backslash, ``<\\|``, so texts can't forge turns and
the output can be read back; a role's line breaks are escaped too.

Each turn is rendered on its own. Turns of one conversation are put together as a stream in turn order, one turn in memory
at a time, so a conversation of any length is handled; its digest is sequential by nature, its rendering is not.

Defined results: a null text or role is empty; parts, where they are given, stand for the text; null turns come first; equal turns are ordered by role and text, repeated
rows stay repeated; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, isfinite

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@dataclass
class Flattened:
    text: str = ""
    refs: list[tuple[int, str, str, int]] = field(default_factory=list)  # order, kind, reference, tokens

    @property
    def expanded_tokens(self) -> int:
        return sum(r[3] for r in self.refs)


class Flattener:
    """Visits parts, dictionaries with a type. A part of another type, or without one, is an attachment of kind unknown and no tokens; a null part is left out;
    a size that is no number above zero is taken as missing."""

    def __init__(self, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.visits = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}

    def flatten(self, parts: list[dict | None]) -> Flattened:
        out = Flattened()
        for part in parts:
            if part is not None:
                self.visits.get(part.get("type"), self.visit_unknown)(part, out)
        return out

    def visit_text(self, part: dict, out: Flattened) -> None:
        out.text += escape(part.get("text") or "")

    def visit_image(self, part: dict, out: Flattened) -> None:
        across, down = (-(-int(_number(part, k, self.patch)) // self.patch) for k in ("width", "height"))
        self._attach("image", part, max(across, 1) * max(down, 1), out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self._attach("audio", part, ceil(_number(part, "seconds", 0) * self.audio_rate - 1e-9), out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self._attach("document", part, int(_number(part, "pages", 1)) * self.page_tokens, out)

    def visit_unknown(self, part: dict, out: Flattened) -> None:
        self._attach("unknown", part, 0, out)

    def _attach(self, kind: str, part: dict, tokens: int, out: Flattened) -> None:
        out.text += f"<|{kind}_{len(out.refs)}|>"
        out.refs.append((len(out.refs), kind, str(part.get("ref") or ""), min(tokens, (1 << 62) - 1)))


def _number(part: dict, key: str, default: float) -> float:
    try:
        x = float(part.get(key) or default)
    except (TypeError, ValueError):
        return default
    return x if isfinite(x) and x > 0 else default


def render(role: str, flat: Flattened) -> str:
    return f"{START}{escape_role(role)}\n{flat.text}{END}\n"


def read_turn(rendered: str) -> tuple[str, str]:
    """The role and text of one rendered turn."""
    role, body = _TURN.fullmatch(rendered).groups()
    return unescape_role(role), unescape(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(role), unescape(body)) for role, body in _TURN.findall(formatted)]


def format_turns(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds to rows of conv_id, turn, role and text or parts: rendered, loss_from and loss_to (code points inside
    rendered that carry loss, null if none), refs and expanded_tokens."""
    parts = F.col("parts") if "parts" in turns.columns else F.lit(None).cast("array<map<string,string>>")
    src = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), parts.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Flattener()
        for b in batches:
            cols: dict[str, list] = {k: [] for k in ("rendered", "loss_from", "loss_to", "refs", "expanded_tokens")}
            for role, text, given in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), b.column("parts").to_pylist()):
                flat = visitor.flatten([None if p is None else dict(p) for p in given] if given is not None else [{"type": "text", "text": text}])
                cols["rendered"].append(render(role, flat))
                lead = len(START) + len(escape_role(role)) + 1
                trained = role in trained_roles
                cols["loss_from"].append(lead if trained else None)
                cols["loss_to"].append(lead + len(flat.text) if trained else None)
                cols["refs"].append([{"ordinal": o, "kind": k, "ref": r, "tokens": n} for o, k, r, n in flat.refs])
                cols["expanded_tokens"].append(flat.expanded_tokens)
            ref = pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
            kinds = {"rendered": pa.string(), "loss_from": pa.int64(), "loss_to": pa.int64(), "refs": ref, "expanded_tokens": pa.int64()}
            yield pa.RecordBatch.from_pydict({"conv_id": b.column("conv_id"), "turn": b.column("turn"), **{k: pa.array(v, kinds[k]) for k, v in cols.items()}})

    kinds = dict(turns.select("conv_id", "turn").dtypes)
    return src.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, rendered string, loss_from long, loss_to long, refs array<struct<ordinal:int,kind:string,ref:string,tokens:long>>, expanded_tokens long")


def digest(formatted: DataFrame) -> DataFrame:
    """Reads the formatted turns of each conversation back, as a stream in order, into the digest columns."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        for b in batches:
            for conv, rendered, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_from", "loss_to"))):
                if state is None or state[0] != conv:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(rendered)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    trained = unescape(rendered[lo:hi])
                    state[3] += len(trained)
                    state[4].update(trained.encode())
                state[5] += len(rendered)
            if len(done) >= 1000:
                yield table(done)
                done = []
        yield table(done + ([state] if state else []))

    def table(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 6
        hexes = lambda xs: pa.array([x.hexdigest() for x in xs], pa.string())
        ints = lambda xs: pa.array(list(xs), pa.int64())
        return pa.RecordBatch.from_pydict({"conv_id": ints(cols[0]), "n_turns": ints(cols[1]), "turns_sha256": hexes(cols[2]), "loss_chars": ints(cols[3]), "loss_sha256": hexes(cols[4]), "formatted_chars": ints(cols[5])})

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return ordered.select("conv_id", "rendered", "loss_from", "loss_to").mapInArrow(run, out)
