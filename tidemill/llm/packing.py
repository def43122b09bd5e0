"""Cost-balanced packing of documents into fixed-length training sequences.

Attention makes a piece of n tokens cost ``linear * n + quadratic * n * n``. Within a window of documents the pieces
go, in descending length, to the sequence that is cheapest so far among those with room. A window has exactly as much
capacity as tokens: full sequences, and one sequence for each power of two in the rest, which needs no padding. What
fits nowhere is cut at the room that is left, and the rest of it goes when its length's turn comes.

Windows never leave their task: nothing is shuffled, and a lost task's windows are packed again, alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import END_ID, encoded, word_tokenizer, word_tokenizer_path

CAPACITY = 2048
#: Cost of a token, and of a pair of tokens of one piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens gathered before a window is packed; documents stay whole, so a long one can exceed it.
WINDOW_TOKENS = 1 << 22
#: Pieces of a record batch that leaves a worker.
PIECES = 512

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document's position, start, length, sequence, offset) that hold every token exactly once.

    Sequences are full, or full at a power of two below ``capacity`` (at most one of each).
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    total = sum(lengths)
    whole, rest = divmod(total, capacity)
    used = 0
    items = []
    for i, n in enumerate(lengths):
        full, tail = divmod(n, capacity)
        for k in range(full):
            pieces.append((i, k * capacity, capacity, used, 0))
            used += 1
        if tail:
            items.append((-tail, i, full * capacity))
    room = [0] * used + [capacity] * (whole - used) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    size = list(room)
    cost = [0.0] * len(room)
    open_, parked = [(0.0, s) for s in range(used, len(room))], []  # parked: too little room for the present length
    heapq.heapify(items)

    def put(i: int, start: int, n: int, s: int) -> None:
        pieces.append((i, start, n, s, size[s] - room[s]))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
        if room[s]:
            heapq.heappush(open_, (cost[s], s))

    while items:
        n, i, start = heapq.heappop(items)
        n = -n
        while parked and -parked[0][0] >= n:
            _, s = heapq.heappop(parked)
            heapq.heappush(open_, (cost[s], s))
        while open_ and room[open_[0][1]] < n:
            _, s = heapq.heappop(open_)
            heapq.heappush(parked, (-room[s], s))
        if open_:
            put(i, start, n, heapq.heappop(open_)[1])
        else:  # cut: fill the sequence with the most room; the rest waits until it is the longest
            _, s = heapq.heappop(parked)
            part = room[s]
            put(i, start, part, s)
            heapq.heappush(items, (part - n, i, start + part))
    return pieces


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, linear: float, quadratic: float) -> Iterator[pa.RecordBatch]:
    tokenizer, base = word_tokenizer(path), TaskContext.get().partitionId() << 36
    docs: list = []
    ids: list[np.ndarray] = []
    tokens = 0

    def packed() -> Iterator[pa.RecordBatch]:
        nonlocal base
        pieces = assign([len(x) for x in ids], capacity, linear, quadratic)
        for at in range(0, len(pieces), PIECES):
            part = pieces[at : at + PIECES]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([docs[i] for i, *_ in part], pa.int64()),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([len(ids[p[0]]) for p in part], pa.int64()),
                    pa.array([base + p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                    pa.array([ids[i][s : s + n].astype("<u4").tobytes() for i, s, n, _, _ in part], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
        base += 1 + max((p[3] for p in pieces), default=0)
        docs.clear()
        ids.clear()

    for batch in batches:
        for doc, found in encoded(batch, tokenizer):
            docs.append(doc)
            ids.append(np.append(found, np.uint32(END_ID)).astype(np.uint32))
            tokens += len(ids[-1])
            if tokens >= WINDOW_TOKENS:
                yield from packed()
                tokens = 0
    if docs:
        yield from packed()


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece, with its ids (little-endian uint32) and place.

    Null and empty texts are the end id alone. Repeated rows are packed each for itself; an empty table gives no rows;
    a null id stays null. Columns besides the two named are ignored. sequence_id is unique, not gapless.
    """
    common.ship(df.sparkSession)
    path = tokenizer_path or word_tokenizer_path()
    rows = common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _pack_batches(common.trimmed(it), path, capacity, linear, quadratic), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces. Null and empty texts are the end id alone; repeated rows are packed each for itself, null ids stay null."""
    return digest(pack(common.table(spark, sf_dir, "documents")))
