"""Cost-balanced packing of tokenised documents into training sequences.

A document is its ids and an end id.  A task packs its documents in groups of a bounded
number of tokens, so nothing is shuffled and no group grows with the input.  In a group,
pieces of full length are sequences of their own; the rest is dealt, longest first, to the
sequence of the lowest estimated cost (linear plus quadratic in the piece) with capacity left; all
sequences of the group are looked at.  Where none has capacity, the piece is cut at the largest room.
Capacities add up to the group's tokens, and what does not fill a sequence goes on to the
task's next group.  A task's last remainder becomes sequences whose lengths are powers of
two (eleven at most), so that no padding is needed at all.  Small inputs are read by few tasks, as each leaves such a remainder.

Null and empty texts are the end id alone.  Repeated rows and ids are packed row by row.  An
empty table gives no sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from ._common import lean, quoted

#: Bytes of input for which a task is worth its remainder.
TASK_BYTES = 4 << 20


def pack_group(lengths: list[int], size: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048, starts: list[int] | None = None, last: bool = True) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """(document, start, length, sequence, offset) of every piece, and (document, start, length) of what is left over.

    Sequences are numbered from 0.  ``starts``: where each document's tokens begin, if not at 0.  Only
    if this is not the ``last`` group is anything left over, less than ``size`` tokens in all.
    """
    out, rest, over, n = [], [], [], 0
    for d, total in enumerate(lengths):
        begin = starts[d] if starts else 0
        whole = total - total % size
        for s in range(0, whole, size):
            out.append((d, begin + s, size, n, 0))
            n += 1
        if total > whole:
            rest.append((total - whole, d, begin + whole))
    rest.sort(key=lambda r: (-r[0], r[1]))
    extra = sum(r[0] for r in rest) % size
    room = [size] * (sum(r[0] for r in rest) // size)
    if last:
        room += [1 << b for b in range(size.bit_length() - 1, -1, -1) if extra >> b & 1]
    else:
        while extra:  # the shortest pieces wait, the last of them in part
            length, d, start = rest.pop()
            wait = min(length, extra)
            over.append((d, start + length - wait, wait))
            extra -= wait
            if wait < length:
                rest.append((length - wait, d, start))
    capacity = np.array(room, np.int64)
    free, cost = capacity.copy(), np.zeros(len(room))
    for length, d, start in rest:
        while length:
            fits = free >= length
            if fits.any():
                k = int(np.argmin(np.where(fits, cost, np.inf)))
                cut = length
            else:
                k = int(np.argmax(free))
                cut = int(free[k])
            out.append((d, start, cut, n + k, int(capacity[k] - free[k])))
            free[k] -= cut
            cost[k] += linear * cut + quadratic * cut * cut
            start, length = start + cut, length - cut
    return out, over


def pack(lengths: list[int], size: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a single group."""
    return pack_group(lengths, size, linear, quadratic)[0]


def _few_tasks(docs: DataFrame) -> DataFrame:
    """``docs`` in no more partitions than there are ``TASK_BYTES`` in it by Spark's estimate."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = max(1, -(-estimate // TASK_BYTES))
    return docs.coalesce(most) if most < 10_000 else docs


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, vocabulary: str | None = None, group_tokens: int = 2 << 20
) -> DataFrame:
    """One row per piece: id, start, ids (little-endian unsigned 32-bit, as binary), doc_tokens, sequence_id, offset."""
    path = vocabulary or tokens.default_path()
    source = _few_tasks(docs).select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", source.schema["id"].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def run(batches):
        encode = tokens.encoder(path).encode
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        names, held, starts, totals, count = [], [], [], [], 0
        id_type = None

        def flush(last: bool):
            nonlocal base, names, held, starts, totals, count
            pieces, over = pack_group([len(x) for x in held], size, starts=starts, last=last)
            pieces.sort(key=lambda p: (p[3], p[4]))
            sequences = max((p[3] for p in pieces), default=-1) + 1
            columns = [
                pa.array([names[p[0]] for p in pieces], id_type),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([held[p[0]][p[1] - starts[p[0]] : p[1] - starts[p[0]] + p[2]].astype("<u4").tobytes() for p in pieces], pa.binary()),
                pa.array([totals[p[0]] for p in pieces], pa.int64()),
                pa.array([base + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ]
            base, count = base + sequences, sum(x[2] for x in over)
            waiting = [held[d][at - starts[d] : at - starts[d] + length].copy() for d, at, length in over]
            names, held, starts, totals = [names[d] for d, _, _ in over], waiting, [at for _, at, _ in over], [totals[d] for d, _, _ in over]
            return pa.RecordBatch.from_arrays(columns, ["id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids = batch.column(0).to_pylist()
            for first, end, texts in tokens.text_groups(batch.column(1)):
                for name, x in zip(ids[first:end], encode(texts)):
                    names.append(name)
                    held.append(np.append(x, np.uint32(end_id)))
                    starts.append(0)
                    totals.append(len(held[-1]))
                    count += len(held[-1])
                    if count >= group_tokens:
                        yield flush(False)
        if held:
            yield flush(True)

    return source.mapInArrow(lean(run, tokens.ENCODERS), schema).withColumnRenamed("id", id_col)
