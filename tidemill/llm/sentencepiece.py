"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

A model file's pieces and log scores are read; the trie is built once on the driver and broadcast. Texts get a whitespace marker
for each blank (and one in front); where no piece spans a marker that follows another character, words are independent and each
distinct word is segmented once. New words are segmented together: the trie is walked from all characters of all words at
a time, and the best paths are found level by level. Characters without a piece become byte pieces.

Files of BPE models hold merge ranks instead of log scores; their pieces get Zipf's log scores by rank (-log(rank + 2.7) less
the norm), so that the segmentation is still the one with the largest total score.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import Words

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs below the least score.
UNKNOWN_PENALTY = 10.0
#: Edges (or open words) below which a level is walked edge by edge.
FEW = 32
CACHE_WORDS = 400_000
BLOCK_CHARS = 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at : at + n])[0]
            at += n


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    prefix: bool
    base: np.ndarray
    check: np.ndarray
    piece_at: np.ndarray  # piece that ends at a trie node, or -1

    @property
    def unknown(self) -> int:
        return int(np.flatnonzero(self.kinds == UNKNOWN)[0])


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of each node; node 0 is the root, and the child of s by byte c is base[s] + c + 1."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    size = 1 << 12
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    hints = [1, 1]  # for nodes with one child and with more: places before it are too full to be worth another look
    todo = [(0, 0, len(order), 0)]  # node, range of sorted keys, depth
    while todo:
        node, lo, hi, depth = todo.pop()
        if lo < hi and len(keys[order[lo]]) == depth:
            value[node] = values[order[lo]]
            lo += 1
        spans: list[tuple[int, int, int]] = []
        while lo < hi:
            c, start = keys[order[lo]][depth], lo
            while lo < hi and keys[order[lo]][depth] == c:
                lo += 1
            spans.append((c, start, lo))
        if not spans:
            continue
        wide = len(spans) > 1
        b = max(1, hints[wide] - spans[0][0] - 1)
        while True:
            if b + 300 >= len(check):
                base += [0] * len(base)
                check += [-1] * len(check)
                value += [-1] * len(value)
            if all(check[b + c + 1] == -1 for c, _, _ in spans):
                break
            b += 1
        base[node] = b
        hints[wide] = max(hints[wide], b + spans[0][0] + 1)
        for c, _, _ in spans:
            check[b + c + 1] = node
        todo += [(b + c + 1, start, end, depth + 1) for c, start, end in spans]
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


def build(pieces: list[str], scores: list[float], kinds: list[int], prefix: bool = True) -> Model:
    use = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and pieces[i]]
    base, check, value = double_array([pieces[i].encode() for i in use], use)
    return Model(pieces, np.array(scores, np.float64), np.array(kinds, np.int8), prefix, base, check, value)


def load(path: str) -> Model:
    """The pieces of a model file; only files without a normalisation table can be read."""
    pieces, scores, kinds, model_type, prefix = [], [], [], 1, True
    with open(path, "rb") as f:
        for field, value in _fields(f.read()):
            if field == 1:
                part = dict(_fields(value))
                pieces.append(part[1].decode())
                scores.append(float(part.get(2, 0.0)))
                kinds.append(int(part.get(3, NORMAL)))
            elif field == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif field == 3:
                spec = dict(_fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("the model asks for a normalisation table or for removing white space")
    if model_type == 2:
        scores = zipf_scores(scores, kinds)
    return build(pieces, scores, kinds, prefix)


def zipf_scores(scores: list[float], kinds: list[int]) -> list[float]:
    normal = sorted((i for i, k in enumerate(kinds) if k == NORMAL), key=lambda i: -scores[i])
    weights = 1.0 / (np.arange(len(normal)) + 2.7)
    logs = np.log(weights / weights.sum())
    out = [0.0] * len(scores)
    for i, s in zip(normal, logs):
        out[i] = float(s)
    return out


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: Model):
        self.model = m = model
        self.unknown_score = float(m.scores[(m.kinds == NORMAL) | (m.kinds == USER)].min(initial=0.0)) - UNKNOWN_PENALTY
        by_byte = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == BYTE}
        self.byte_ids = np.array([by_byte.get(f"<0x{b:02X}>", m.unknown) for b in range(256)], np.int32)
        self.has_bytes = len(by_byte) == 256
        spans = any(re.search(f"[^{MARK}]{MARK}", m.pieces[i]) for i in np.flatnonzero((m.kinds == NORMAL) | (m.kinds == USER)))
        lines = any("\n" in m.pieces[i] for i in np.flatnonzero((m.kinds == NORMAL) | (m.kinds == USER)))
        # where words are cut: before a blank that follows something else, and around line ends that no piece holds
        self.words_of = (lambda t: [t]) if spans else re.compile(" *[^ ]+| +" if lines else "\n| *[^ \n]+| +").findall
        text = [b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k in (CONTROL, UNUSED) else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds)]
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.words = Words()
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        m = self.model
        raw = [w.replace(" ", MARK).encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        total = int(ends[-1]) if len(ends) else 0
        stop = np.repeat(ends, size)
        lead = (data[:total] & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        char_end = np.append(at[1:], total)
        # all matches of all pieces: walk the trie from every character at once
        starts, finish, piece = [], [], []
        single = np.zeros(total, bool)
        node, pos, origin = np.zeros(len(at), np.int64), at.copy(), np.arange(len(at))
        while len(pos):
            inside = pos < stop[at[origin]]
            node, pos, origin = node[inside], pos[inside], origin[inside]
            below = m.base[node] + data[pos] + 1
            below = np.minimum(below, len(m.check) - 1)
            good = (m.check[below] == node) & (m.base[node] > 0)
            node, pos, origin = below[good], pos[good] + 1, origin[good]
            ended = m.piece_at[node] >= 0
            starts.append(at[origin[ended]])
            finish.append(pos[ended])
            piece.append(m.piece_at[node[ended]])
            single[at[origin[ended & (pos == char_end[origin])]]] = True
        lone = np.flatnonzero(~single[at])
        s = np.concatenate([*starts, at[lone]]).astype(np.int64)
        e = np.concatenate([*finish, char_end[lone]]).astype(np.int64)
        p = np.concatenate([*piece, np.full(len(lone), -1)]).astype(np.int64)
        score = np.where(p >= 0, m.scores[p], self.unknown_score)
        # best paths, level by level of the distance from the word's start; ties go to the longest last piece
        word_start = np.repeat(ends - size, size)
        level = e - word_start[s]
        order = np.lexsort((s, e, level))
        s, e, p, score, level = s[order], e[order], p[order], score[order], level[order]
        best = np.full(total + 1, -np.inf)
        back = np.full(total + 1, -1, np.int64)
        begins = np.zeros(total + 1, bool)
        begins[ends - size] = True
        edges = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(level)]])
        wide = np.flatnonzero(np.diff(edges) >= FEW)
        narrow = int(wide[-1]) + 1 if len(wide) else 0  # from here on levels hold little: long words, edge by edge
        for a, b in zip(edges[:narrow], edges[1 : narrow + 1]):
            here = np.where(begins[s[a:b]], 0.0, best[s[a:b]]) + score[a:b]
            group = np.flatnonzero(np.concatenate([[True], e[a + 1 : b] != e[a : b - 1]]))
            top = np.maximum.reduceat(here, group)
            wins = here == np.repeat(top, np.diff(np.append(group, b - a)))
            first = np.minimum.reduceat(np.where(wins, np.arange(a, b), len(level)), group)
            best[e[a + group]] = top
            back[e[a + group]] = first
        at = int(edges[narrow])
        if at < len(level):
            begin, value, came = begins.tolist(), best.tolist(), back.tolist()
            for i, start, end, x in zip(range(at, len(level)), s[at:].tolist(), e[at:].tolist(), score[at:].tolist()):
                x = x if begin[start] else x + value[start]
                if x > value[end]:
                    value[end], came[end] = x, i
            back = np.array(came, np.int64)
        used = np.zeros(len(s), bool)
        tip = ends[size > 0]
        while len(tip) >= FEW:
            edge = back[tip]
            used[edge] = True
            tip = s[edge]
            tip = tip[~begins[tip]]
        if len(tip):
            came, start, begin = back.tolist(), s.tolist(), begins.tolist()
            for end in tip.tolist():
                while True:
                    used[came[end]] = True
                    end = start[came[end]]
                    if begin[end]:
                        break
        s, e, p = s[used], e[used], p[used]
        order = np.argsort(s, kind="stable")
        s, e, p = s[order], e[order], p[order]
        width = np.where((p < 0) & self.has_bytes, e - s, 1)
        out = np.repeat(np.where(p < 0, m.unknown, p), width)
        if self.has_bytes:
            loose = np.repeat(p < 0, width)
            place = np.repeat(s - (np.cumsum(width) - width), width) + np.arange(len(out))
            out[loose] = self.byte_ids[data[place[loose]]]
        # a piece belongs to the word that holds its start
        owner = np.searchsorted(ends, s, side="right")
        return out.astype(np.int32), np.bincount(owner, weights=width, minlength=len(words)).astype(np.int64)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < BLOCK_CHARS):
                chars += len(texts[end] or "")
                end += 1
            if len(self.words) > CACHE_WORDS:
                self._clear()
            split = [self.words_of((" " if self.model.prefix else "") + t.replace(MARK, " ")) if t else [] for t in texts[at:end]]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            w = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            if self.words.new:
                new, self.words.new = self.words.new, []
                ids, n = self.segment(new)
                self.ids = np.concatenate([self.ids, ids])
                self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
            start, n = self.at[w], self.at[w + 1] - self.at[w]
            ends = np.cumsum(n)
            flat = self.ids[np.arange(int(n.sum())) + np.repeat(start - ends + n, n)]
            bounds = np.concatenate([[0], ends])[np.cumsum(sizes)[:-1]]
            out += np.split(flat, bounds)
            at = end
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined, markers as blanks, without the one in front; bytes that are no UTF-8 as U+FFFD."""
        if not len(ids):
            return ""
        start, n = self.text_at[ids], np.diff(self.text_at)[ids]
        ends = np.cumsum(n)
        text = self.text[np.arange(int(ends[-1])) + np.repeat(start - ends + n, n)].tobytes().decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def _codec(key: int, model) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model.value)
    return _codecs[key]


def _encode(batches: Iterator[pa.RecordBatch], key: int, model) -> Iterator[pa.RecordBatch]:
    codec = _codec(key, model)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part.column(part.num_columns - 1).to_pylist()
            ids = codec.encode_all(texts)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], names=[*part.schema.names[:-1], "ids"])


def _decode(batches: Iterator[pa.RecordBatch], key: int, model) -> Iterator[pa.RecordBatch]:
    codec = _codec(key, model)
    for batch in batches:
        texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])


def _fields_of(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields)


def _over(df: DataFrame, model: Model, column: str, keep: list[str], work, result: str) -> DataFrame:
    common.ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a vocabulary: its size doesn't depend on the data
    key = zlib.crc32(repr((model.pieces, model.scores.tobytes())).encode())
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__value"))
    return rows.mapInArrow(lambda it: work(common.trimmed(it), key, shared), _fields_of(df, keep) + result)


def encode(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` and ids of each whole text. Null text: null; empty text: no ids. Rows keep their number."""
    return _over(df, model, text_col, keep or [], _encode, "ids array<int>")


def decode(df: DataFrame, model: Model, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` and the text of ids. Null ids: null; no ids: empty."""
    return _over(df, model, ids_col, keep or [], _decode, "text string")


DIGEST = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, score double, round_trip boolean"


def _digest(batches: Iterator[pa.RecordBatch], key: int, model) -> Iterator[pa.RecordBatch]:
    codec = _codec(key, model)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part.column(1).to_pylist()
            found = codec.encode_all(texts)
            kinds = codec.model.kinds
            unknown = [(kinds[x] == BYTE).sum() for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array(unknown, pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                    pa.array([round(float(codec.model.scores[x].sum()), 6) for x in found], pa.float64()),
                    pa.array([codec.decode(x) == (t or "") for x, t in zip(found, texts)], pa.bool_()),
                ],
                names=[f.split()[0] for f in DIGEST.split(", ")],
            )


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ids (number, byte pieces, CRC-32 as little-endian uint32), their log score, and whether decoding them gives the text.

    Null and empty texts have no ids and score 0; repeated rows get the same result, null ids stay null.
    """
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = load(model_path())
    shared = spark.sparkContext.broadcast(model)
    common.ship(spark)
    key = zlib.crc32(repr((model.pieces, model.scores.tobytes())).encode())
    return docs.mapInArrow(lambda it: _digest(common.trimmed(it), key, shared), DIGEST)
