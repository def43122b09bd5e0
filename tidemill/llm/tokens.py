"""Token ids of whole texts by a public tokenizer, with the work for repeated words done once."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Id that ends each document.
END_ID = 1
#: Distinct words, and pieces of them, kept by a worker; beyond it a cache starts anew (results don't depend on it).
CACHE_WORDS, CACHE_PIECES = 250_000, 500_000
#: End marks that the pre-tokenizer cuts off in one piece.
MARKS = ".,!?;:%$&*#|"
#: Characters of texts that are looked up together.
BLOCK_CHARS = 1_000_000


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Numbers words in the order of their first use and remembers which are new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` from ``start``, ``n`` long, one behind the other."""
    ends = np.cumsum(n)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + n, n)]


def _low(core: str) -> str | None:
    """The letters as the normalizers give them; None if the whole tokenizer has to look."""
    if not core.isalpha():
        return None
    low = core.lower()
    if not core.isascii() and (not is_normalized("NFC", core) or not low.isalpha() or "\u03a3" in core):  # also lower case that isn't letter by letter
        return None
    return low


class WordTokenizer:
    """Ids by a ``tokenizers`` file whose pre-tokenizer drops white space, so that no token spans a blank.

    A text is cut at blanks and line ends; each distinct word is looked up once for a block of texts, and its ids are gathered
    by numpy. A new word is lower-case letters and end marks behind them, each encoded once; the letters of many words go
    through the model in one call. Words of another kind are encoded by the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = Tokenizer(self.model)
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # byte-level alphabet: printable Latin-1 stands for itself, the other bytes for what follows 255, in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.bytes = np.arange(256, dtype="<u4")
        for i, b in enumerate(b for b in range(256) if b not in plain):
            self.bytes[b] = 256 + i
        self.bytes[0x20] = 0x20  # between words
        suffix, vocab = getattr(self.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.fast = True
        self._forget_pieces()
        self._clear()
        self.fast = self._agrees()
        self._forget_pieces()
        self._clear()

    def _agrees(self) -> bool:
        """Whether the short way gives this tokenizer's ids for letters and marks."""
        samples = ["The", "over,", "\u00c9t\u00e9.", "stra\u00dfe!!", "\u0437\u0438\u043c\u0430;", "\u4e2d\u6587", "a", "zzxqj??"]
        whole = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in samples]
        return [x.tolist() for x in self._block(samples)] == whole and self.tokenizer.encode(" ".join(samples), add_special_tokens=False).ids == list(chain.from_iterable(whole))

    def _clear(self) -> None:
        self.words = Words()
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _forget_pieces(self) -> None:
        self.pieces = Words()
        self.piece_ids = np.zeros(0, np.uint32)
        self.piece_start = self.piece_n = np.zeros(0, np.int64)

    def _model(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words, one behind the other, and their numbers, by the model alone."""
        text = self.bytes[np.frombuffer(" ".join(pieces).encode(), np.uint8)].tobytes().decode("utf-32-le")
        found = self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.fromiter(found, np.uint32, len(found))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(pieces):  # each word has one last token
            return ids, np.diff(ends, prepend=0)
        each = [[t.id for t in self.model.tokenize(p)] for p in text.split(" ")]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _learn_pieces(self) -> None:
        """Encode the new pieces: letters, end marks, and (behind a blank) words for the whole tokenizer."""
        new, self.pieces.new = self.pieces.new, []
        quick, slow = [], []
        for i, piece in enumerate(new):
            (quick if piece.isalpha() else slow).append(i)
        ids, n = [self.piece_ids], np.zeros(len(new), np.int64)
        for at in range(0, len(quick), 1024):
            some, m = self._model([new[i] for i in quick[at : at + 1024]])
            ids.append(some)
            n[quick[at : at + 1024]] = m
        for at in range(0, len(slow), 1024):
            some = self.tokenizer.encode_batch_fast([new[i].removeprefix(" ") for i in slow[at : at + 1024]], add_special_tokens=False)
            some = [e.ids for e in some]
            ids.append(np.fromiter(chain.from_iterable(some), np.uint32))
            n[slow[at : at + 1024]] = [len(x) for x in some]
        order = np.array(quick + slow, np.int64)
        start = np.zeros(len(new), np.int64)
        start[order] = len(self.piece_ids) + np.cumsum(n[order]) - n[order]
        self.piece_ids = np.concatenate(ids)
        self.piece_start, self.piece_n = np.concatenate([self.piece_start, start]), np.concatenate([self.piece_n, n])

    def _learn(self) -> None:
        if len(self.pieces) > CACHE_PIECES:
            self._forget_pieces()
        new, self.words.new = self.words.new, []
        parts: list[str] = []
        for word in new:
            core = word.rstrip(MARKS)
            low = _low(core) if self.fast else None
            if low is None:
                parts += " " + word, ""
            else:
                parts += low, word[len(core) :]
        p = np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts))
        if self.pieces.new:
            self._learn_pieces()
        n = self.piece_n[p]
        self.ids = np.concatenate([self.ids, _gather(self.piece_ids, self.piece_start[p], n)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n[::2] + n[1::2])])

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self._clear()
        split = pc.split_pattern(pa.array([text.replace("\n", " ") for text in texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False)
        w = np.fromiter(map(self.words.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]
        if self.words.new:
            self._learn()
        start, n = self.at[w], self.at[w + 1] - self.at[w]
        ends = np.cumsum(n)
        return np.split(_gather(self.ids, start, n), ends[split.offsets.to_numpy()[1:-1] - 1])

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text, without special tokens; none for null and empty texts."""
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
        if block:
            yield from self._block(block)

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))


def encoded(batch, tokenizer: WordTokenizer, rows: int = 512) -> Iterator[tuple[object, np.ndarray]]:
    """Id and ids of each row of a record batch (id, text), a few rows in memory at a time."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield from zip(part.column(0).to_pylist(), tokenizer.encode_all(part.column(1).to_pylist()))


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]
