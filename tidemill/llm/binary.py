"""Token ids as binary training files: best-fit-decreasing packing, written and read as matrices.

A window of documents is packed by best fit: pieces in descending length, each into the sequence whose remaining room is the
smallest that holds it, found in a segment tree over the possible rooms. Documents longer than a sequence are split without
loss. A file holds, for its sequences, the id matrix (uint16, or uint32 where an id needs it; padded), cumulative segment lengths, and a bit for every place
where positions start again from 0.

Tasks write files of their own names into the shared folder; the manifest (a written table) names only those of committed
tasks. Nothing is shuffled before the files are written.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import END_ID, encoded, word_tokenizer, word_tokenizer_path

CAPACITY, PAD_ID = 2048, 0
#: Tokens gathered before a window is packed and written as one file.
WINDOW_TOKENS = 1 << 22
MAGIC = b"TMPACK01"

MANIFEST = "file string, row int, offset int, doc_id long, start long, length int, doc_tokens long"


class Rooms:
    """Sequences by remaining room, with a segment tree that finds the smallest room of at least n."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.leaves)  # how many rooms below a node hold a sequence
        self.by_room: list[list[int]] = [[] for _ in range(self.leaves)]

    def _count(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.some[i] += by
            i >>= 1

    def add(self, room: int, sequence: int) -> None:
        if room:
            if not self.by_room[room]:
                self._count(room, 1)
            self.by_room[room].append(sequence)

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, sequence) of the best fit, removed; None if no sequence has room."""
        i = n + self.leaves
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):  # up, until a right sibling holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.leaves
        sequence = self.by_room[room].pop()
        if not self.by_room[room]:
            self._count(room, -1)
        return room, sequence


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document's position, start, length, sequence, offset) and the number of sequences."""
    items = [(min(capacity, n - s), i, s) for i, n in enumerate(lengths) for s in range(0, n, capacity)]
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    rooms, pieces, sequences = Rooms(capacity), [], 0
    for n, i, s in items:
        found = rooms.take(n)
        if found is None:
            found, sequences = (capacity, sequences), sequences + 1
        room, seq = found
        pieces.append((i, s, n, seq, capacity - room))
        rooms.add(room - n, seq)
    return pieces, sequences


def encode_file(ids: list[np.ndarray], pieces: list[tuple[int, int, int, int, int]], sequences: int, capacity: int) -> bytes:
    width = 2 if max((int(x.max()) for x in ids if len(x)), default=0) < 1 << 16 else 4
    matrix = np.full((sequences, capacity), PAD_ID, f"<u{width}")
    resets = np.zeros((sequences, capacity), bool)
    ends: list[list[int]] = [[0] for _ in range(sequences)]
    for i, s, n, seq, off in sorted(pieces, key=lambda p: (p[3], p[4])):
        matrix[seq, off : off + n] = ids[i][s : s + n]
        resets[seq, off] = True
        ends[seq].append(off + n)
    rows = np.cumsum([0, *map(len, ends)]).astype("<i8")
    parts = [matrix.tobytes(), rows.tobytes(), np.concatenate([np.array(e, "<i4") for e in ends]).tobytes(), np.packbits(resets, axis=1, bitorder="little").tobytes()]
    head = json.dumps({"sequences": sequences, "capacity": capacity, "width": width, "bytes": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


def decode_file(data: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Id matrix, cumulative segment lengths of each sequence, and position ids (from 0 in each segment)."""
    if data[:8] != MAGIC:
        raise ValueError("not a packed file")
    (n,) = struct.unpack_from("<I", data, 8)
    head = json.loads(data[12 : 12 + n])
    at = np.cumsum([12 + n, *head["bytes"]])
    seqs, cap = head["sequences"], head["capacity"]
    matrix = np.frombuffer(data[at[0] : at[1]], f"<u{head['width']}").reshape(seqs, cap)
    rows = np.frombuffer(data[at[1] : at[2]], "<i8")
    cu = np.frombuffer(data[at[2] : at[3]], "<i4")
    resets = np.unpackbits(np.frombuffer(data[at[3] : at[4]], np.uint8).reshape(seqs, -1), axis=1, bitorder="little", count=cap).astype(bool)
    places = np.arange(cap, dtype=np.int32)
    return matrix, [cu[a:b] for a, b in zip(rows[:-1], rows[1:])], places - np.maximum.accumulate(np.where(resets, places, 0), axis=1)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(folder)
    tokenizer = word_tokenizer(path)
    docs: list = []
    ids: list[np.ndarray] = []
    tokens = 0

    def flush() -> pa.RecordBatch:
        pieces, sequences = best_fit([len(x) for x in ids], capacity)
        name = f"{uuid.uuid4().hex}.pack"
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(encode_file(ids, pieces, sequences, capacity))
        columns = [
            pa.array([name] * len(pieces), pa.string()),
            pa.array([p[3] for p in pieces], pa.int32()),
            pa.array([p[4] for p in pieces], pa.int32()),
            pa.array([docs[p[0]] for p in pieces], pa.int64()),
            pa.array([p[1] for p in pieces], pa.int64()),
            pa.array([p[2] for p in pieces], pa.int32()),
            pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
        ]
        docs.clear()
        ids.clear()
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in MANIFEST.split(", ")])

    for batch in batches:
        for doc, found in encoded(batch, tokenizer):
            docs.append(doc)
            ids.append(np.append(found, np.uint32(END_ID)).astype("<u4"))
            tokens += len(ids[-1])
            if tokens >= WINDOW_TOKENS:
                yield flush()
                tokens = 0
    if docs:
        yield flush()


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack every row into files below ``folder`` (a URI all executors reach); the manifest, a row per piece.

    Ids of 65536 and more make their file's ids four bytes wide. Null and empty texts are the end id alone; repeated rows are packed each for itself;
    a null id stays null; an empty table writes no file.
    """
    spark = df.sparkSession
    common.ship(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    path = tokenizer_path or word_tokenizer_path()
    rows = common.pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.written(rows.mapInArrow(lambda it: _write(common.trimmed(it), folder, path, capacity), MANIFEST), "manifest")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, file string, row int, offset long, segment int, sound boolean"


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(folder)
    opened, parts = None, None
    for batch in batches:
        crcs, segments, sound = [], [], []
        for name, row, off, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5))):
            if name != opened:
                with fs.open_input_file(f"{base}/{name}") as f:
                    parts = decode_file(f.read())
                opened = name
            matrix, cu, positions = parts
            k = int(np.searchsorted(cu[row], off))
            segments.append(k)
            sound.append(bool(cu[row][k] == off and cu[row][k + 1] == off + n and positions[row, off] == 0 and positions[row, off + n - 1] == n - 1))
            crcs.append(zlib.crc32(matrix[row, off : off + n].astype("<u4").tobytes()))
        c = batch.column
        columns = [c(3), c(4), c(5).cast(pa.int64()), pa.array(crcs, pa.int64()), c(6), c(0), c(1), c(2).cast(pa.int64()), pa.array(segments, pa.int32()), pa.array(sound, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECES.split(", ")])


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest's pieces with what the files hold of them: checksum of the ids, segment, and whether the segment's ends and
    position resets agree with the manifest."""
    common.ship(manifest.sparkSession)
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = manifest.repartition(n, "file").sortWithinPartitions("file", "row", "offset")
    return rows.mapInArrow(lambda it: _read(common.trimmed(it), folder), PIECES)


def op6_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into files and read back: a row per piece. Null and empty texts are the end id alone; repeated rows
    are packed each for itself, null ids stay null."""
    folder = common.new_folder(spark, "packed")
    return read(write(common.table(spark, sf_dir, "documents"), folder), folder)
