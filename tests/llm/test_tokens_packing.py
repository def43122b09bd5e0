"""Tokenizer cache, the two packers, binary files, SentencePiece."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import binary, packing, sentencepiece, tokens
from tidemill.llm.queries import queries

ODD = ["<|endoftext|> a", "a b c\td\x1ce", "É é ́x  don't'll Σας'S \n\n\r x", "", "   ", "ab<|startoftext|>cd 123 İ", "Ǆ ǅungla J̌a ΑΣ ΑΣ, İstanbul! ﬁne ｆｕｌｌ ªº 中文。 ٣ Ⅷ", "x" * 5000 + "!" * 300, "a.b,c;; ..", " x y\u0085z"]


@pytest.fixture(scope="module")
def words():
    return tokens.word_tokenizer(tokens.word_tokenizer_path())


def test_ids_are_the_tokenizers(words):
    assert words.fast
    for text in ODD:
        assert list(words.encode(text)) == words.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert [len(x) for x in words.encode_all(["", None, "a b", ""])] == [0, 0, 2, 0]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(text):
    w = tokens.word_tokenizer(tokens.word_tokenizer_path())
    assert list(w.encode(text)) == w.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_starts_anew_without_changing_ids(words, monkeypatch):
    before = [x.tolist() for x in words.encode_all(ODD)]
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 10)
    assert [x.tolist() for x in words.encode_all(ODD)] == before


def test_letters_go_through_the_model_once(monkeypatch):
    w = tokens.WordTokenizer(tokens.word_tokenizer_path())
    seen = []
    whole = w._model
    monkeypatch.setattr(w, "_model", lambda pieces: seen.extend(pieces) or whole(pieces))
    texts = ["Word word, WORD!! word\nthe \u00c9t\u00e9 \u00e9t\u00e9.", "the Word; <|x|> \u00c9T\u00c9"]
    want = [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in w.encode_all(texts)] == want
    assert sorted(seen) == ["the", "word", "\u00e9t\u00e9"]
    monkeypatch.setattr(tokens, "CACHE_PIECES", 2)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 10)
    w._clear()
    assert [x.tolist() for x in w.encode_all(texts)] == want
    w.last[:] = False  # a model that doesn't mark the ends of words
    w._clear()
    w._forget_pieces()
    assert [x.tolist() for x in w.encode_all(texts)] == want


def sound(lengths, pieces):
    """Every token in one piece, pieces side by side in their sequences."""
    by_doc, by_seq = {}, {}
    for i, s, n, seq, off in pieces:
        assert n > 0
        by_doc.setdefault(i, []).append((s, n))
        by_seq.setdefault(seq, []).append((off, n))
    for i, length in enumerate(lengths):
        at = 0
        for s, n in sorted(by_doc.get(i, [])):
            assert s == at
            at += n
        assert at == length
    fill = {}
    for seq, parts in by_seq.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        fill[seq] = at
    return fill


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=40))
def test_cost_balanced_packing_needs_no_padding(lengths):
    fill = sound(lengths, packing.assign(lengths, 16))
    short = [n for n in fill.values() if n != 16]
    assert all(n < 16 and n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)


def test_costs_are_balanced():
    lengths = [100] * 40 + [25] * 160 + [10] * 400
    pieces = packing.assign(lengths, 1000)
    cost = {}
    for _, _, n, seq, _ in pieces:
        cost[seq] = cost.get(seq, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    assert max(cost.values()) < 1.02 * min(cost.values())
    assert packing.assign([], 16) == []


def test_cuts_do_not_reopen_every_sequence(monkeypatch):
    """Moves between the heaps grow with the pieces, not with pieces times sequences."""
    lengths = np.minimum(np.random.RandomState(1).lognormal(6.2, 1, 2000).astype(int) + 1, 20_000).tolist()
    popped, pop = [], packing.heapq.heappop
    monkeypatch.setattr(packing.heapq, "heappop", lambda heap: popped.append(1) or pop(heap))
    pieces = packing.assign(lengths)
    sound(lengths, pieces)
    assert len(popped) < 4 * len(pieces)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60))
def test_best_fit_is_what_a_plain_search_finds(lengths):
    pieces, sequences = binary.best_fit(lengths, 16)
    sound(lengths, pieces)
    room = []
    for n in sorted((min(16, n - s) for n in lengths for s in range(0, n, 16)), reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(16 - n)
    assert sequences == len(room)
    assert sorted(room) == sorted(16 - x for x in sound(lengths, pieces).values())


def test_file_round_trip():
    ids = [np.arange(1, 20, dtype="<u2"), np.arange(100, 105, dtype="<u2"), np.arange(7, 8, dtype="<u2")]
    pieces, sequences = binary.best_fit([len(x) for x in ids], 8)
    matrix, cu, positions = binary.decode_file(binary.encode_file(ids, pieces, sequences, 8))
    for i, s, n, seq, off in pieces:
        assert matrix[seq, off : off + n].tolist() == ids[i][s : s + n].tolist()
        assert off in cu[seq] and off + n in cu[seq]
        assert positions[seq, off : off + n].tolist() == list(range(n))


def test_wide_ids_stay_whole():
    ids = [np.array([1, 70_000, 65_535], "<u4"), np.array([2, 3], "<u4")]
    pieces, sequences = binary.best_fit([3, 2], 4)
    matrix, _, _ = binary.decode_file(binary.encode_file(ids, pieces, sequences, 4))
    assert sorted(x for row in matrix.tolist() for x in row if x) == [1, 2, 3, 65_535, 70_000]
    assert binary.decode_file(binary.encode_file(ids[1:], *binary.best_fit([2], 4), 4))[0].dtype == np.dtype("<u2")


def docs(spark, rows):
    """With other columns whose names clash with the results'."""
    return spark.createDataFrame([(i, t, 7, "x", 1.0) for i, t in rows], "doc_id long, text string, length int, ids string, score double")


CASES = [(1, "one two three."), (2, None), (3, ""), (None, "no id"), (1, "one two three."), (5, "word " * 9000), (6, "🙂 \x00 ok")]


def test_packing_of_a_table(spark, words):
    got = packing.digest(packing.pack(docs(spark, CASES).coalesce(1))).collect()
    want = [[*words.encode(t), 1] for _, t in CASES]
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (i, _), ids in zip(CASES, want):
        parts = sorted(by_doc[i, len(ids)], key=lambda r: r.start)
        copies = 2 if i == 1 else 1
        assert sum(r.length for r in parts) == copies * len(ids)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack(docs(spark, [])).count() == 0


def check_pieces(pieces, rows, words):
    """Each document's ids, cut and placed anyhow, are the tokenizer's own and an end id; checksums are those of the ids."""
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*words.tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc = {}
    for i, _, start, length, crc, total in pieces:
        by_doc.setdefault(i, []).append((start, length, crc, total))
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        ids = {len(x): x for x in want[i]}
        assert sum(n for _, n, _, _ in parts) == sum(map(len, want[i]))
        for start, n, crc, total in parts:
            assert crc == zlib.crc32(np.array(ids[total][start : start + n], "<u4").tobytes())


@pytest.mark.parametrize("name", ["op6_binary", "op10_packing"])
def test_registered_packing_queries(spark, sf_dir, words, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries()[name](spark, sf_dir).collect()
    check_pieces([(r.doc_id, None, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got], rows, words)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id if name == "op10_packing" else (r.file, r.row), []).append((r.offset, r.length))
    fill = []
    for parts in places.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
        fill.append(at)
    if name == "op10_packing":
        assert all(n == 2048 or n & (n - 1) == 0 for n in fill)


def test_registered_sentencepiece_query(spark, sf_dir, model):
    """Digests of the registered query against the codec's own ids and texts."""
    codec = sentencepiece.Codec(model)
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries()["op1_sentencepiece"](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(rows)
    for r in got:
        [ids] = codec.encode_all([rows[r.doc_id] or ""])
        assert r.n_ids == len(ids) and r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_binary_of_a_table(spark, tmp_path, words):
    folder = f"file://{tmp_path}/out"
    found = binary.read(binary.write(docs(spark, CASES), folder), folder).collect()
    packed = packing.digest(packing.pack(docs(spark, CASES))).collect()
    assert all(r.sound for r in found)
    assert {(r.doc_id, r.doc_tokens) for r in found} == {(r.doc_id, r.doc_tokens) for r in packed}
    assert sum(r.length for r in found) == sum(r.length for r in packed)
    check_pieces([[r.doc_id, t, r.start, r.length, r.ids_crc32, r.doc_tokens] for r in found for t in [None]], CASES, words)
    assert binary.read(binary.write(docs(spark, []), folder), folder).count() == 0


# ---- SentencePiece


@pytest.fixture(scope="module")
def model():
    return sentencepiece.load(sentencepiece.model_path())


def message(f, v):
    def varint(n):
        out = b""
        while True:
            b, n = n & 127, n >> 7
            out += bytes([b | (128 if n else 0)])
            if not n:
                return out

    if isinstance(v, bytes):
        return varint(f << 3 | 2) + varint(len(v)) + v
    return varint(f << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(f << 3) + varint(v)


@pytest.fixture(scope="module")
def library(model):
    """The library's own Unigram model with the same pieces and scores."""
    import sentencepiece as lib

    data = b"".join(message(1, message(1, p.encode()) + message(2, float(s)) + message(3, int(k))) for p, s, k in zip(model.pieces, model.scores, model.kinds))
    data += message(2, message(3, 1) + message(35, 1) + message(40, 0) + message(41, 1) + message(42, 2)) + message(3, message(1, b"identity") + message(3, 1) + message(4, 0) + message(5, 1))
    return lib.SentencePieceProcessor(model_proto=data)


TEXTS = ["", "a", " a  b ", "\n\n x", "日本語 🙂 ﷽", "▁▁ a▁b", "é́ \x00 z", "The quick brown fox, jumped over it. 12345", "ünïcödé straße", "x" * 300]


def test_sentencepiece_as_the_library(model, library, spark, sf_dir):
    codec = sentencepiece.Codec(model)
    texts = TEXTS + [r.text[:400] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for text, ids in zip(texts, codec.encode_all(texts)):
        want = library.encode(text)
        if ids.tolist() != want:  # only where two ways score the same
            assert model.scores[ids].sum() == pytest.approx(model.scores[want].sum(), abs=1e-3), text


def test_long_words_are_quick_and_the_same(model, monkeypatch):
    import time

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefghij"), 3000)), "x" * 5000, "word " * 50 + "é日" * 700]
    quick = [x.tolist() for x in sentencepiece.Codec(model).encode_all(texts)]
    monkeypatch.setattr(sentencepiece, "FEW", 1)
    assert [x.tolist() for x in sentencepiece.Codec(model).encode_all(texts)] == quick
    monkeypatch.undo()
    codec, began = sentencepiece.Codec(model), time.time()
    [ids] = codec.encode_all(["".join(rng.choice(list("abcdefghij"), 1_000_000))])
    assert time.time() - began < 15 and len(codec.decode(ids)) == 1_000_000


def test_sentencepiece_decodes_what_it_encodes(model):
    codec = sentencepiece.Codec(model)
    for text, ids in zip(TEXTS, codec.encode_all(TEXTS)):
        assert codec.decode(ids) == text.replace("▁", " ")
    assert codec.decode(np.array([3 + 0xE6, 3 + 0x97])) == "�"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc ▁é\n", max_size=9), st.integers(0, 5))
def test_viterbi_is_the_best_of_all_ways(text, seed):
    rng = np.random.default_rng(seed)
    pieces = ["<unk>", "a", "b", "▁", "▁a", "ab", "abc", "▁ab", "bc", "é", "ca", "▁▁", *[f"<0x{b:02X}>" for b in range(256)]]
    kinds = [2] + [1] * 11 + [6] * 256
    scores = [0.0, *(-rng.integers(1, 9, 11) / 2), *([0.0] * 256)]
    m = sentencepiece.build(pieces, scores, kinds)
    codec = sentencepiece.Codec(m)
    [ids] = codec.encode_all([text])
    marked = (" " + text).replace(" ", "▁") if text else ""
    best = [0.0]
    for end in range(1, len(marked) + 1):
        ways = []
        for start in range(end):
            part = marked[start:end]
            if part in pieces[1:12]:
                ways.append(best[start] + scores[pieces.index(part)])
            elif end - start == 1:
                ways.append(best[start] + codec.unknown_score)
        best.append(max(ways, default=-1e9))
    got, run = 0.0, b""
    for i in ids:
        if kinds[i] == 6:
            run += bytes([int(pieces[i][1:-1], 16)])
        else:
            got += scores[i]
    got += codec.unknown_score * len(run.decode())
    assert got == pytest.approx(best[-1])
    assert codec.decode(ids) == text.replace("▁", " ")


def test_sentencepiece_of_a_table(spark, model):
    df = docs(spark, CASES)
    got = sentencepiece.encode(df, model, keep=["doc_id"])
    assert got.where("ids is null").count() == 1 and got.where("size(ids) = 0").count() == 1
    back = {(r.doc_id, r.text) for r in sentencepiece.decode(got, model, keep=["doc_id"]).collect()}
    assert back == set(CASES)
    assert sentencepiece.encode(docs(spark, []), model).count() == 0
