"""Chat formatting on ids: segments encoded apart, reserved ids spliced in, loss masks (operator 2).

A turn becomes ``START role \\n text END \\n``. Role and text are encoded each by itself, so no token
spans a border, and START and END are ids outside the vocabulary that no text can produce. Control
strings in a text are escaped besides (a backslash goes between ``<`` and ``|``), so the formatted
string is unambiguous too. The loss mask is the prefix sum of +1 where an assistant's text
starts and -1 where it ends.

Turns are encoded where they lie; only then they meet their conversation, sorted, and stream past
one at a time, so a conversation of any length needs the memory of one batch. Null role or text:
empty. Turns with the same number: by role, then ids; a null number comes first. Null conversation
ids form one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm import bpe, frames

# The strings that stand for the reserved ids in a formatted text.
START, END = "<|im_start|>", "<|im_end|>"
_BAR = re.compile(r"<(\\*)\|")
_ESCAPED_BAR = re.compile(r"<\\(\\*)\|")
_NAME = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
_ESCAPED_NAME = {v: k for k, v in _NAME.items()}


def escape(text: str) -> str:
    """Put one backslash more between ``<`` and ``|``: the result holds no control string."""
    return _BAR.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED_BAR.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n|]", lambda m: _NAME[m[0]], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\np]", lambda m: _ESCAPED_NAME[m[0]], role)


def encode_turns(df: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """One row per turn, in order within its conversation, conversations not torn apart.

    Columns: ``conv``, ``turn``, ``start`` (ids of the conversation before this turn), ``ids`` and
    ``loss`` (1 where the id is learned). Reserved ids are the two after the vocabulary's last.
    """
    ranks = df.sparkSession.sparkContext.broadcast(bpe.read_ranks(path))
    keys = [df.schema[conv], df.schema[turn], df.schema[role]]
    packed = T.StructType([*keys, T.StructField("_ids", T.BinaryType()), T.StructField("_from", T.IntegerType()), T.StructField("_to", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(ranks.value)
        kind = np.uint16 if vocab.size + 2 <= 1 << 16 else np.uint32
        line = vocab.encode(frames.Texts(pa.array(["\n"])))[0]
        ends = np.concatenate([[vocab.size + 1], line])
        for batch in batches:
            for part in frames.slices(batch, text):
                heads = [escape_role(x or "") for x in part.column(role).to_pylist()]
                bodies = [escape(x or "") for x in part.column(text).to_pylist()]
                head, a = vocab.encode(frames.Texts(pa.array(heads, pa.string())))
                body, b = vocab.encode(frames.Texts(pa.array(bodies, pa.string())))
                spliced, first, last = [], [], []
                for i in range(part.num_rows):
                    own = [[vocab.size], head[a[i] : a[i + 1]], line, body[b[i] : b[i + 1]], ends]
                    spliced.append(np.concatenate(own).astype(kind).tobytes())
                    first.append(int(a[i + 1] - a[i]) + 1 + len(line))
                    last.append(first[-1] + int(b[i + 1] - b[i]))
                columns = [part.column(c) for c in (conv, turn, role)]
                columns += [pa.array(spliced, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, packed.names)

    lists = T.ArrayType(T.IntegerType(), False)
    out = T.StructType([*keys[:2], T.StructField("start", T.LongType(), False), T.StructField("ids", lists, False), T.StructField("loss", lists, False)])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if bpe.vocabulary(ranks.value).size + 2 <= 1 << 16 else np.uint32
        before, position = object(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                raw = frames.Texts(part.column("_ids"))
                ids = raw.raw.view(kind).astype(np.int32)
                bounds = raw.bounds // kind(0).itemsize
                starts = []
                for c, n in zip(part.column(conv).to_pylist(), np.diff(bounds).tolist(), strict=True):
                    if c != before:
                        before, position = c, 0
                    starts.append(position)
                    position += n
                says = np.array([x == learned for x in part.column(role).to_pylist()], np.int32)
                delta = np.zeros(len(ids) + 1, np.int32)
                np.add.at(delta, bounds[:-1] + part.column("_from").to_numpy(), says)
                np.subtract.at(delta, bounds[:-1] + part.column("_to").to_numpy(), says)
                n = np.diff(bounds)
                columns = [part.column(conv), part.column(turn), pa.array(starts, pa.int64())]
                columns += [frames.list_array(x, n, pa.int32()) for x in (ids, np.cumsum(delta[:-1], dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    turns = df.select(conv, turn, role, text).mapInArrow(run, packed)
    return turns.repartition(conv).sortWithinPartitions(conv, turn, role, "_ids").mapInArrow(assemble, out)


def read_back(turns: DataFrame, path: str, conv: str = "conv_id") -> DataFrame:
    """Per conversation what its ids say: turns, their digest, the text under the loss mask, the size.

    Reads the rows of ``encode_turns`` (or of a table written from them partition by partition):
    the turns of a conversation must follow one another.
    """
    ranks = turns.sparkSession.sparkContext.broadcast(bpe.read_ranks(path))
    names = {"n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long"}
    schema = T.StructType([turns.schema[conv], *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in names.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(ranks.value)
        marks = [START.encode(), END.encode()]
        counts = np.append(vocab.count, [len(m) for m in marks])
        begins = np.cumsum(counts) - counts
        data = np.concatenate([vocab.bytes, np.frombuffer(b"".join(marks), np.uint8)])
        open_, done = None, []

        def flush() -> pa.RecordBatch:
            rows = [[c, n, said.hexdigest(), chars, learned.hexdigest(), size] for c, n, said, chars, learned, size in done]
            done.clear()
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=_arrow(schema))

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids, before = bpe.list_values(part.column("ids"))
                loss, _ = bpe.list_values(part.column("loss"))
                size = counts[ids]
                at = np.concatenate([[0], np.cumsum(size)])
                raw = data[frames.ranges(begins[ids], size)].tobytes()
                under = np.concatenate([[0], np.cumsum(size * (loss > 0))])
                masked = data[frames.ranges(begins[ids[loss > 0]], size[loss > 0])].tobytes()
                for i, c in enumerate(part.column(conv).to_pylist()):
                    a, b = before[i], before[i + 1]
                    if open_ is None or open_[0] != c:
                        if open_ is not None:
                            done.append(open_)
                        open_ = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    whole = raw[at[a] : at[b]].decode()
                    name, _, text = whole[len(START) : -len(END) - 1].partition("\n")
                    open_[1] += 1
                    open_[2].update(f"{unescape_role(name)}\n{unescape(text)}\n".encode())
                    said = unescape(masked[under[a] : under[b]].decode())
                    open_[3] += len(said)
                    open_[4].update(said.encode())
                    open_[5] += len(whole)
                if len(done) >= 1000:
                    yield flush()
        if open_ is not None:
            done.append(open_)
        yield flush()

    return turns.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(schema[0].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.schema(list(zip(schema.names, kinds, strict=True)))
