"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded, hashed sample of the labelled texts in partial sums on the executors, and
the priors from all labelled rows. The log-probability matrix has a fixed number of buckets, so its size depends on
the languages alone; it is sent to every task, and a batch of texts is scored by one gather for each n-gram length
and one segmented sum. Log-probabilities are whole numbers of 2 ** -20, so that sums don't depend on their order:
a text has the same score in any batch, chunk and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import crc_fold, pick

BUCKETS = 1 << 15
LENGTHS = (1, 2, 3)
TRAIN_ROWS = 20_000  # documents of the training sample, over all languages
MOST_LANGUAGES = 1024  # the matrix, BUCKETS x languages, goes to every task
SMOOTHING = 0.5
SCALE = 1 << 20
CHUNK_CHARS = 1 << 18
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search


class Chunk:
    """Parts of texts one after the other: code points, the text of each part, and for each place its distance from
    the end of its part and whether an n-gram may start there."""

    def __init__(self, parts: list[tuple[int, str, int]]):
        self.codes = np.frombuffer("".join(p for _, p, _ in parts).encode("utf-32-le", "replace"), np.uint32)
        sizes = np.array([len(p) for _, p, _ in parts])
        self.text, self.starts = np.array([i for i, _, _ in parts]), np.cumsum(sizes) - sizes
        place = np.arange(len(self.codes)) - np.repeat(self.starts, sizes)
        self.left = np.repeat(sizes, sizes) - place
        self.own = place < np.repeat([n for _, _, n in parts], sizes)

    def grams(self) -> Iterator[np.ndarray]:
        """For each length the bucket of the n-gram at each place; BUCKETS where none starts. None crosses a text's border."""
        size = len(self.codes)
        padded = np.zeros(size + max(LENGTHS), np.uint32)
        padded[:size] = self.codes
        value = np.zeros(size, np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            value = value * np.uint32(0x01000193) + (padded[n - 1 : n - 1 + size] + np.uint32(n)) * np.uint32(0x9E3779B1)
            if n in LENGTHS:
                found = ((value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15)
                yield np.where(self.own & (self.left >= n), found, np.uint32(BUCKETS))


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[Chunk]:
    """Runs of lower-cased texts of about ``limit`` characters. A longer text is cut into parts that overlap, so that
    each of its n-grams starts in exactly one of them and none is lost."""
    held, size = [], 0
    for i, text in enumerate(texts):
        text = " " + text.lower() + " "
        for a in range(0, len(text), limit):
            part = text[a : a + limit + max(LENGTHS) - 1]
            held.append((i, part, min(limit, len(text) - a)))
            size += len(part)
            if size >= limit:
                yield Chunk(held)
                held, size = [], 0
    if held:
        yield Chunk(held)


def score_texts(texts: list[str], log_prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(summed log-probabilities in 1 / SCALE, n-grams) of each text; ``log_prob`` holds BUCKETS rows of whole numbers."""
    matrix = np.vstack([log_prob, np.zeros((1, log_prob.shape[1]), log_prob.dtype)])
    out, counts = np.zeros((len(texts), log_prob.shape[1]), np.int64), np.zeros(len(texts), np.int64)
    for chunk in chunks(texts):
        for buckets in chunk.grams():
            np.add.at(out, chunk.text, np.add.reduceat(matrix[buckets], chunk.starts, axis=0, dtype=np.int64))
            np.add.at(counts, chunk.text, np.add.reduceat(buckets < BUCKETS, chunk.starts, dtype=np.int64))
    return out, counts


class Model:
    """Languages by code point, their log-priors and the log-probabilities by bucket and language, in 1 / SCALE."""

    def __init__(self, langs: list[str], prior: np.ndarray, log_prob: np.ndarray):
        self.langs, self.prior, self.log_prob = langs, prior, log_prob

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; see ``predict``."""
        plain = [t if t and _LETTER(t) else "" for t in texts]
        pred, score = [UNKNOWN] * len(plain), np.zeros(len(plain))
        if self.langs and plain:
            sums, counts = score_texts(plain, self.log_prob)
            sums += self.prior
            best = sums.argmax(axis=1)
            scaled = (sums - sums.max(axis=1, keepdims=True)) / (SCALE * np.sqrt(np.maximum(counts, 1)))[:, None]
            top = 1 / np.exp(scaled).sum(axis=1)
            for i, t in enumerate(plain):
                if t:
                    pred[i], score[i] = self.langs[best[i]], top[i]
        return pred, score


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """A model from about ``rows`` hashed rows; rows without a text or language teach nothing.

    Every language gives at most an equal share of the rows or, being rare, all of its rows. Priors come from
    the counts of all labelled rows. More than MOST_LANGUAGES values are an error: such a column holds no languages.
    """
    labelled = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    langs = sorted(counts)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values in {lang_col!r}")
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((BUCKETS, 0), np.int32))
    share = max(1, rows // len(langs))
    kept = [F.lit(int(min(1.0, share / counts[x]) * (1 << 20)) + 1) for x in langs]
    index = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col(lang_col)).cast("int")
    sample = labelled.withColumn("_lang", index).filter(F.pmod(F.xxhash64(F.lit(23), id_col), F.lit(1 << 20)) < F.element_at(F.array(*kept), F.col("_lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for lang in np.unique(of):
                own = sums.setdefault(int(lang), np.zeros(BUCKETS + 1, np.int64))
                for chunk in chunks([texts[i] for i in np.flatnonzero(of == lang)]):
                    for buckets in chunk.grams():
                        own += np.bincount(buckets, minlength=BUCKETS + 1)
        for lang, n in sums.items():
            at = np.flatnonzero(n[:BUCKETS])
            yield pa.record_batch([pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    partial = sample.select(text_col, "_lang").mapInArrow(count, "lang int, bucket int, n bigint")
    total = np.zeros((BUCKETS, len(langs)))
    summed = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most buckets x languages rows
    total[summed["bucket"], summed["lang"] - 1] = summed["n"]
    log_prob = np.log(total + SMOOTHING) - np.log(total.sum(axis=0) + SMOOTHING * BUCKETS)
    prior = np.log(np.array([counts[x] for x in langs], np.float64) / sum(counts.values()))
    return Model(langs, np.rint(prior * SCALE).astype(np.int64), np.rint(log_prob * SCALE).astype(np.int32))


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score. Score: the posterior, tempered by the square root of the n-grams so that
    long texts don't all end at 1; a function of the text and the model alone. Null texts, texts without letters, and an
    untrained model give ``und`` and 0. No shuffle; whole texts of any length; repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.log_prob))  # BUCKETS x at most MOST_LANGUAGES
    chosen = docs.select(F.col(text_col).alias("_text"), *keep)
    fields = chosen.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            pred, score = own.predict(batch.column(0).to_pylist())
            yield pa.record_batch([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score)], names=[*(f.name for f in fields), "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])
    return chosen.mapInArrow(run, schema)


def identify(docs: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learnt from the documents outside the held-out fold.

    A row without an id is never held out and teaches nothing; an empty table gives no rows.
    """
    docs = pick(docs, "doc_id", "text", "lang")
    out = crc_fold("doc_id", fold) == held
    model = train(docs.filter(~F.coalesce(out, F.lit(True))).select("doc_id", "text", "lang"))
    return predict(docs, model, [F.col("doc_id"), F.coalesce(out, F.lit(False)).alias("held_out")])
