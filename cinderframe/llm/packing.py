"""Operator 1, packing: cost-balanced sequences.

Attention over a piece of n tokens costs about ``linear * n + quadratic * n * n``. Documents are laid
out in windows of an input split. Of each document, pieces of a full sequence's length are sequences of
their own; the rests are taken in descending order of cost, each to the sequence of lowest cost that
still has room for it. A rest that fits nowhere is cut over the sequences with the most room. A window
opens just the sequences that its tokens fill; what is left over is laid into sequences of
power-of-two lengths, which need no padding.

Windows never span tasks, so nothing is shuffled, and a lost task repeats alone: ids of sequences
come from the split's number and a counter, both the same on a retry.

A null or empty text is one end token. Repeated documents are packed each by itself; ties in cost go
by place in the split. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import coder
from .common import only, tune

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
END_TOKEN = np.array([1], "<u4").tobytes()


def cost_of(n, linear: float, quadratic: float):
    return linear * n + quadratic * n * n


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Lay rests, each shorter than ``capacity``, into sequences.

    Returns pieces (rest, start in the rest, length, sequence, offset) and each sequence's room as opened.
    """
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    left, cost, pieces = np.array(rooms, np.int64), np.zeros(len(rooms)), []

    def put(rest: int, start: int, n: int, s: int) -> None:
        pieces.append((rest, start, n, s, int(rooms[s] - left[s])))
        left[s] -= n

    cut = []
    for rest in sorted(range(len(lengths)), key=lambda r: (-lengths[r], r)):
        n = lengths[rest]
        s = int(np.where(left >= n, cost, np.inf).argmin())  # the first of equal costs
        if left[s] >= n:
            put(rest, 0, n, s)
            cost[s] += cost_of(n, linear, quadratic)
        else:
            cut.append(rest)
    left = left.tolist()
    roomy = [(-room, s) for s, room in enumerate(left) if room]
    heapq.heapify(roomy)
    for rest in cut:
        start = 0
        while start < lengths[rest]:
            s = heapq.heappop(roomy)[1]
            n = min(left[s], lengths[rest] - start)
            put(rest, start, n, s)
            start += n
            if left[s]:
                heapq.heappush(roomy, (-left[s], s))
    return pieces, rooms


def pack(documents: DataFrame, vocabulary: str, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 1024, window: int = 4096) -> DataFrame:
    """One row per piece: its document, place, CRC-32 of its ids, sequence, offset there, and cost.

    ``capacity``: tokens a sequence, a power of two. ``window``: documents balanced together; it bounds
    a task's memory to ``window * capacity`` rest tokens (32 MB at 4096 and 2048).
    """
    tune(documents.sparkSession)

    def run(batches):
        c, sequence = coder(vocabulary), TaskContext.get().partitionId() << 33
        columns: list[list] = [[] for _ in range(7)]
        rests: list[tuple[int, int, int, bytes]] = []  # document, start, its tokens, ids

        def row(doc: int, start: int, ids: bytes, tokens: int, s: int, offset: int) -> None:
            for column, value in zip(columns, (doc, start, len(ids) // 4, zlib.crc32(ids), tokens, s, offset)):
                column.append(value)

        def rows():
            arrays = [pa.array(x, pa.int64()) for x in columns]
            n = np.array(columns[2], np.float64)
            for x in columns:
                x.clear()
            return pa.RecordBatch.from_arrays([*arrays, pa.array(cost_of(n, linear, quadratic))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])

        def close() -> None:
            nonlocal sequence
            pieces, rooms = balance([len(r[3]) // 4 for r in rests], capacity, linear, quadratic)
            for rest, start, n, s, offset in pieces:
                doc, first, tokens, ids = rests[rest]
                row(doc, first + start, ids[4 * start : 4 * (start + n)], tokens, sequence + s, offset)
            sequence += len(rooms)
            rests.clear()

        for batch in batches:
            ids_of = c.encode_all([t or "" for t in batch.column(1).to_pylist()])
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of):
                ids += END_TOKEN
                tokens = len(ids) // 4
                full = tokens // capacity * capacity
                for start in range(0, full, capacity):
                    row(doc, start, ids[4 * start : 4 * (start + capacity)], tokens, sequence, 0)
                    sequence += 1
                if tokens > full:
                    rests.append((doc, full, tokens, ids[4 * full :]))
                if len(rests) >= window:
                    close()
                if len(columns[0]) >= 20_000:
                    yield rows()
            del ids_of
        close()
        c.shrink()
        yield rows()

    return only(documents, doc_id="long", text="string").mapInArrow(run, SCHEMA)
