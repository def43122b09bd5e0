"""Language identification with string kernels.

The kernel of two texts counts the character n-grams (of N_MIN to N_MAX letters, blanks for everything between words) that
both have, present or absent only, and is normalised by the texts' own kernels. A bounded sample of labelled texts gives
Nyström landmarks; one-versus-rest kernel ridge regression is fitted on their features. Scoring multiplies a batch's
presence matrix, over the landmarks' n-grams that occur in it, with the landmarks' and the result with the weights.

N-grams are told apart by keys of 64 bits, so kernels are exact but for chance: among ten million n-grams, two share a key
with a probability of about 3 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

N_MIN, N_MAX = 1, 4
#: Sampled labelled texts per language (at most), landmarks per language, ridge.
SAMPLE, LANDMARKS, RIDGE = 300, 24, 1e-3
#: Sampled texts and landmarks of all languages together; many languages share them equally. A language always has one text
#: in the sample; if there are more languages than landmarks, not all have a landmark of their own.
TOTAL_SAMPLE, TOTAL_LANDMARKS = 6000, 512
#: Characters of a sampled text beyond which it is used only if its language has no shorter one (scoring reads whole texts).
SAMPLE_CHARS = 20_000
#: Characters of all landmarks together, about; shared equally by the languages, which have one each at least.
LANDMARK_CHARS = 1 << 20
#: More values than this aren't languages: an error, none is left out.
MAX_LANGUAGES = 10_000
#: Texts that are scored together, and letters whose n-grams are made together.
BATCH_TEXTS, BLOCK = 64, 1 << 18

UNKNOWN = "und"
_STEP, _MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_LENGTHS = np.arange(N_MAX + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point: itself if a letter, else a blank. Surrogates and the rest above are blanks."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)
    return _letters


def grams(text: str) -> np.ndarray:
    """Sorted distinct keys of the n-grams of a text's lower-cased letters."""
    cps = _letter_table()[np.frombuffer(f"\n{text.lower()}\n".encode("utf-32-le", "replace"), np.uint32)]
    blank = cps == 32
    cps = cps[~(blank & np.concatenate([[False], blank[:-1]]))]  # runs of blanks are one
    found = []
    for at in range(0, len(cps), BLOCK):
        part = cps[at : at + BLOCK + N_MAX - 1].astype(np.uint64)
        h, keys = np.zeros(len(part), np.uint64), []
        for n in range(1, min(N_MAX, len(part)) + 1):
            h = h[: len(part) - n + 1] * _STEP + part[n - 1 :]
            if n >= N_MIN:
                k = (h + _LENGTHS[n]) * _MIX
                keys.append(k ^ (k >> np.uint64(32)))
        found.append(_distinct(np.concatenate(keys)))
    return found[0] if len(found) == 1 else _distinct(np.concatenate(found))


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # sorted keys of the landmarks' n-grams
    held: np.ndarray  # for each key, a bit per landmark that has it
    sizes: np.ndarray  # n-grams of each landmark
    weights: np.ndarray  # landmarks + 1 x languages, for normalised kernels and a constant
    starts: np.ndarray | None = None  # first place in the vocabulary for each value of a key's top bits
    shift: np.uint64 = np.uint64(0)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the vocabulary of those keys that are in it, and which these are."""
        if self.starts is None:
            bits = max(1, len(self.vocabulary).bit_length() + 2)
            self.shift = np.uint64(64 - bits)
            self.starts = np.searchsorted(self.vocabulary >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        head = (keys >> self.shift).astype(np.int32)
        at, end = self.starts[head], self.starts[head + 1]
        left = np.flatnonzero(at < end)  # buckets hold few keys each: one after the other
        at, end, keys = at[left], end[left], keys[left]
        places, hits = [], []
        while len(left):
            same = self.vocabulary[at] == keys
            places.append(at[same])
            hits.append(left[same])
            more = ~same & (at + 1 < end)
            at, end, keys, left = at[more] + 1, end[more], keys[more], left[more]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *hits])

    def kernels(self, texts: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel of each text (by its ``grams``) with each landmark: products of whole numbers, exact in any order."""
        out = np.zeros((len(texts), len(self.sizes)))
        for i in range(0, len(texts), BATCH_TEXTS):
            part = texts[i : i + BATCH_TEXTS]
            keys, row = np.concatenate(part), np.repeat(np.arange(len(part)), [len(g) for g in part])
            at, hit = self.find(keys)
            seen = np.zeros(len(self.vocabulary), bool)
            seen[at] = True
            used, column = np.flatnonzero(seen), np.cumsum(seen) - 1
            present = np.zeros((len(part), len(used)), np.float32)
            present[row[hit], column[at]] = 1
            marks = np.unpackbits(self.held[used], axis=1, count=len(self.sizes), bitorder="little").astype(np.float32)
            own = np.maximum([len(g) for g in part], 1).astype(np.float64)
            out[i : i + len(part)] = (present @ marks) / np.sqrt(own[:, None] * self.sizes)
        return out

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; texts need a letter."""
        labels: list[str] = []
        scores = []
        for i in range(0, len(texts), BATCH_TEXTS):
            f = (self.kernels([grams(t) for t in texts[i : i + BATCH_TEXTS]]) @ self.weights[:-1] + self.weights[-1]).round(9)
            best = f.argmax(axis=1)
            labels += [self.languages[b] for b in best]
            scores.append(np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1).round(9))
        return labels, np.concatenate(scores) if scores else np.zeros(0)


def landmarks(texts: list[str], y: np.ndarray, languages: int) -> np.ndarray:
    """Places of the landmarks: the first texts of each language, as the bounds let; of too many languages, some evenly."""
    each, chars = max(1, min(LANDMARKS, TOTAL_LANDMARKS // languages)), LANDMARK_CHARS // languages
    chosen = []
    for c in range(languages):
        mine = np.flatnonzero(y == c)[:each]
        size = np.cumsum([len(texts[i]) for i in mine])
        chosen.append(mine[(size <= chars) | (np.arange(len(mine)) == 0)])
    if languages > TOTAL_LANDMARKS:
        chosen = [chosen[c] for c in np.linspace(0, languages - 1, TOTAL_LANDMARKS).astype(int)]
    return np.concatenate(chosen)


def fit_texts(texts: list[str], langs: list[str]) -> Model:
    """Nyström map to the landmarks' whitened space, then ridge regression to +1 / -1 for each language."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.uint8), np.zeros(0), np.zeros((1, 0)))
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in langs])
    chosen = landmarks(texts, y, len(languages))
    marks = [grams(texts[i]) for i in chosen]
    vocabulary = np.unique(np.concatenate(marks))
    held = np.zeros((len(vocabulary), -(-len(marks) // 8)), np.uint8)
    for j, g in enumerate(marks):
        held[np.searchsorted(vocabulary, g), j // 8] |= np.uint8(1 << j % 8)
    model = Model(languages, vocabulary, held, np.array([len(g) for g in marks], np.float64), np.zeros((1, 1)))
    values, vectors = np.linalg.eigh(model.kernels(marks))
    root = vectors / np.sqrt(np.maximum(values, 1e-8)) * (values > 1e-8)
    x = np.vstack([model.kernels([grams(t) for t in texts[i : i + BATCH_TEXTS]]) for i in range(0, len(texts), BATCH_TEXTS)]) @ root
    x = np.hstack([x, np.ones((len(x), 1))])
    weighed = x / np.bincount(y, minlength=len(languages))[y][:, None]  # languages weigh alike
    # x' (+1 for its own language, -1 for the others): twice a language's sum, less the sum of all
    sums = np.zeros((len(languages), x.shape[1]))
    np.add.at(sums, y, weighed)
    w = np.linalg.solve(x.T @ weighed + RIDGE * np.eye(x.shape[1]), (2 * sums - sums.sum(axis=0)).T)
    model.weights = np.vstack([root @ w[:-1], w[-1:]])
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on up to SAMPLE distinct texts of each language, TOTAL_SAMPLE in all but one a language at least: those with the
    smallest hashes among the texts of at most SAMPLE_CHARS characters, or one longer text of a language that has no such."""
    rows = common.pick(labelled, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    rows = rows.withColumn("draw", F.xxhash64(F.col("text"), F.lit("draw")) / F.lit(2.0**64) + 0.5).withColumn("long", F.length("text") > SAMPLE_CHARS)
    texts = rows.groupBy("lang", "draw").agg(F.min("long").alias("long"))  # copies share a draw
    short = F.when(~F.col("long"), F.col("draw"))
    counts = texts.groupBy("lang").agg(F.count(short).alias("texts"), F.min(short).alias("least"), F.min("draw").alias("any")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    if not counts:
        return fit_texts([], [])
    each = max(1, min(SAMPLE, TOTAL_SAMPLE // len(counts)))
    some = each + 6 * each**0.5 + 10  # so many are drawn that hardly ever fewer than each are
    rates = [(r["lang"], max(some / r["texts"], r["least"]) if r["texts"] else r["any"], not r["texts"]) for r in counts]
    rates = labelled.sparkSession.createDataFrame(rates, "lang string, rate double, only_long boolean")  # MAX_LANGUAGES rows at most
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))  # about some rows a language
    drawn = rows.join(F.broadcast(rates), "lang").where((F.col("draw") <= F.col("rate")) & (~F.col("long") | F.col("only_long")))
    limit = F.when(F.col("only_long"), 1).otherwise(each)
    got = drawn.dropDuplicates(["text", "lang"]).withColumn("r", first).where(F.col("r") <= limit).orderBy("lang", "draw", "text").collect()
    return fit_texts([r["text"] for r in got], [r["lang"] for r in got])


def _score(batches: Iterator[pa.RecordBatch], model: Model, keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            texts = part.column(keep).to_pylist()
            known = part.column(keep + 1).to_pylist()
            use = [i for i, k in enumerate(known) if k and model.languages]
            labels, scores = model.decide([texts[i] for i in use])
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, x, s in zip(use, labels, scores):
                lang[i], score[i] = x, s
            columns = [part.column(i) for i in range(keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score)], names=[*part.schema.names[:keep], "lang_pred", "score"])


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep``, lang_pred and score (0 to 1) of each whole text.

    Null texts, and texts without a letter, are UNKNOWN with score 0, as is everything if no language was learned.
    Rows are scored each for itself; an empty table stays empty. Columns not in ``keep`` are ignored, whatever their names.
    """
    common.ship(df.sparkSession)
    keep = keep or []
    text = F.col(f"`{text_col}`")
    rows = df.select(*[F.col(f"`{c}`") for c in keep], text.alias("__text"), has_letter(text).alias("__letter"))
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the parameters above
    return rows.mapInArrow(lambda it: _score(common.trimmed(it), shared.value, len(keep)), T.StructType([*rows.schema.fields[: len(keep)], *made]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that aren't held out; a null id counts as not held out."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
