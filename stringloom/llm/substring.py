"""Exact removal of word passages that occur elsewhere, by recompression.

Documents are dealt once into batches of bounded size, and all passes over the batches share that shuffle.

1. Naming rounds, one Spark round for each level of the parse: every batch sends the distinct names of the pairs (and runs) that
   the level makes, the names of all batches meet in buckets, and one bit for each name comes back: whether it stands
   more than once in the corpus. Only pairs of shared symbols are asked, and only where a window can still
   repeat: a window that holds a whole symbol that stands once is unique itself. Texts without such a window are not
   looked at again.
2. Shared symbols reveal the repeats: what is left are windows all of whose symbols are shared at every level. Each is
   asked under its anchor, the widest symbol of the last level inside it (equal windows have equal anchors), together with a
   fingerprint of its 35 words, which verifies the whole window around the anchor.
3. Words covered by windows that stand twice under one anchor go.

A batch asks for each distinct name once, so a passage with a third of all rows sends no more rows than a
rare one, and questions of many names share a row. Window questions are 128 bits wide: two different windows are taken
for equal with a chance of about windows ** 2 / 2 ** 128. A symbol's name has 64 bits; a false match there only keeps a
window in the running.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm import recompress
from stringloom.llm.common import _Tables, grouped, map_groups, mix64, pick, shield, text_bytes, text_chunks, word_hashes, word_spans

WINDOW = 35
ROUNDS = 5
BATCH_BYTES = 2 << 20  # of text in a batch
PARTITION_BATCHES = 4  # several batches share a partition, which evens the partitions out
MOST_PARTITIONS = 1 << 16  # beyond that, partitions hold more batches; a task holds one batch at a time
ASKED = "bucket bigint, batch bigint, kind int, names binary, many binary"
ANSWERED = "batch bigint, kind int, bucket bigint, shared binary"
# Kinds of questions: a level of symbols from 0 on, or windows. Kinds of notes that a batch sends itself: the answers of a
# level (-1 - level), and the marks of the texts that still hold a window that can repeat.
WINDOWS, ALIVE = 100, -100


def window_names(words: np.ndarray, width: int) -> np.ndarray:
    """A fingerprint of each ``width`` consecutive words, row borders ignored."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _Tables.get(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    return mix64((total[width:] - total[:n]) * down[:n])


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(names ^ np.uint64(0x3C79AC492BA7B653)) >> np.uint64(1)).astype(np.int64) % buckets


def _distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct rows, counts, place of each row among them) of names in one or more columns."""
    if names.shape[1] == 1:
        rows, back, counts = np.unique(names[:, 0], return_inverse=True, return_counts=True)
        return rows[:, None], counts, back
    order = np.lexsort(names.T[::-1])
    ranked = names[order]
    new = np.ones(len(order), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], np.diff(np.append(np.flatnonzero(new), len(order))), back


def _buckets(names: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by bucket, (bucket, first, end) of each bucket in that order) of distinct sorted names."""
    of = bucket_of(names[:, 0], buckets)
    order = np.argsort(of, kind="stable")
    of = of[order]
    edges = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]) if len(of) else np.zeros(1, int)
    return order, [(int(of[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def questions(names: np.ndarray, batch: int, kind: int, buckets: int) -> pa.RecordBatch:
    """A row for each bucket: the batch's distinct names, sorted, and whether each stands in it more than once."""
    names, counts, _ = _distinct(names)
    order, parts = _buckets(names, buckets)
    names, many = names[order], counts[order] > 1
    return pa.record_batch([
        pa.array([p for p, _, _ in parts], pa.int64()), pa.array([batch] * len(parts), pa.int64()), pa.array([kind] * len(parts), pa.int32()),
        pa.array([names[a:b].tobytes() for _, a, b in parts], pa.binary()), pa.array([np.packbits(many[a:b]).tobytes() for _, a, b in parts], pa.binary()),
    ], names=["bucket", "batch", "kind", "names", "many"])


def notes(held: dict[int, bytes], batch: int, buckets: int) -> pa.RecordBatch:
    """What a batch has learnt, sent along with its questions so that the next pass finds it again."""
    n = len(held)
    return pa.record_batch([
        pa.array([batch % buckets] * n, pa.int64()), pa.array([batch] * n, pa.int64()), pa.array(list(held), pa.int32()), pa.array([b""] * n, pa.binary()), pa.array(list(held.values()), pa.binary()),
    ], names=["bucket", "batch", "kind", "names", "many"])


def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For one bucket: which names of each question stand in it twice or in two questions. Notes go back as they are."""
    table = table.combine_chunks()
    kinds = table.column("kind").to_numpy()
    rows: list[bytes] = table.column("many").to_pylist()
    asking = np.flatnonzero(kinds >= 0)
    if len(asking):
        width = 2 if kinds[asking[0]] == WINDOWS else 1
        raw = table.column("names").to_pylist()
        asked = [np.frombuffer(raw[r], np.uint64).reshape(-1, width) for r in asking]
        many = np.concatenate([np.unpackbits(np.frombuffer(rows[r], np.uint8), count=len(n)) for r, n in zip(asking, asked)])
        _, _, back = _distinct(np.concatenate(asked))
        shared = (np.bincount(back) > 1)[back] | many.astype(bool)
        edges = np.concatenate([[0], np.cumsum([len(x) for x in asked])])
        for r, a, b in zip(asking, edges[:-1], edges[1:]):
            rows[r] = np.packbits(shared[a:b]).tobytes()
    yield pa.record_batch([table.column("batch").combine_chunks(), table.column("kind").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(rows, pa.binary())], names=["batch", "kind", "bucket", "shared"])


def _marks(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int64) if packed else np.zeros(0, np.int64)


class Answers:
    """What came back to one batch: answers to its last questions and its own notes."""

    def __init__(self, table: pa.Table | None, buckets: int):
        self.buckets, self.notes, self.of = buckets, {}, {}
        for kind, bucket, bits in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "shared"))) if table is not None else ():
            if kind < 0:
                self.notes[kind] = bits
            else:
                self.of.setdefault(kind, {})[bucket] = np.frombuffer(bits, np.uint8)

    def shared(self, names: np.ndarray, kind: int) -> np.ndarray:
        """For every name asked, in any number and order: whether it is shared."""
        distinct, _, back = _distinct(names)
        if not len(distinct):
            return np.zeros(0, bool)
        if -1 - kind in self.notes:
            out = np.unpackbits(np.frombuffer(self.notes[-1 - kind], np.uint8), count=len(distinct)).astype(bool)
        else:
            order, parts = _buckets(distinct, self.buckets)
            out = np.zeros(len(distinct), bool)
            for bucket, a, b in parts:
                out[order[a:b]] = np.unpackbits(self.of[kind][bucket], count=b - a).astype(bool)
        return out[back]

    def alive(self, marks: np.ndarray) -> np.ndarray:
        """Which texts may still hold a window that repeats; all of them before any note says otherwise."""
        if ALIVE not in self.notes:
            return np.ones(len(marks), bool)
        return np.isin(marks, _marks(self.notes[ALIVE]))


class Chunk:
    """Words, symbols and windows of a run of texts."""

    def __init__(self, data: np.ndarray, borders: np.ndarray, width: int):
        starts, ends, self.bounds = word_spans(data, borders)
        self.words, self.width = word_hashes(data, starts, ends), width
        lengths = np.diff(self.bounds)
        place = np.arange(len(self.words)) - np.repeat(self.bounds[:-1], lengths)
        self.open = place + width <= np.repeat(lengths, lengths)  # windows that can repeat, by their first word
        self.symbols = recompress.level_zero(self.words, self.bounds)
        self.heard: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # names asked, their texts, answers by level

    def ask(self, level: int) -> np.ndarray:
        """Make the next level's symbols; the names to ask for."""
        s = self.symbols = recompress.next_level(self.symbols, level)
        before = np.concatenate([[0], np.cumsum(self.open)])
        low = np.clip(s.high - self.width, 0, len(self.words))
        inside = (s.low >= 0) & (s.high - s.low <= self.width) & (s.high <= len(self.words))
        some = before[np.clip(s.low + 1, 0, len(self.words))] > before[low]  # an open window around the context
        self.asked = np.flatnonzero(s.fresh & s.shared & inside & some)
        s.shared[s.fresh & ~some] = False  # no window asks for it, so nothing is lost
        return s.name[self.asked][:, None]

    def hear(self, shared: np.ndarray) -> None:
        """Take in the answers: windows that hold a symbol that stands once can't repeat."""
        s = self.symbols
        s.shared[self.asked] = shared
        self.heard.append((s.name[self.asked], s.text[self.asked], shared))
        once = s.fresh & ~s.shared
        self.open &= recompress.windows_with(s.low[once], s.high[once], self.width, len(self.words)) == 0

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first words of the open windows, their (fingerprint, anchor) names)."""
        at, s = np.flatnonzero(self.open), self.symbols
        anchor, widest = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
        if len(at) and len(s.name):
            low = np.maximum.accumulate(s.low)  # contexts rise with their symbols
            first = np.searchsorted(low, at)
            for step in range(self.width):
                i = np.minimum(first + step, len(s.name) - 1)
                fits = (first + step < len(s.name)) & (s.low[i] >= at) & (s.high[i] <= at + self.width)
                wider = fits & (s.end[i] - s.start[i] > widest)
                anchor = np.where(wider, s.name[i] + (s.start[i] - at).astype(np.uint64), anchor)
                widest = np.where(wider, s.end[i] - s.start[i], widest)
                if not fits.any():
                    break
        return at, np.stack([window_names(self.words, self.width)[at], anchor], axis=1)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """The words that the windows at ``starts`` cover."""
        change = np.zeros(len(self.words) + 1, np.int64)
        change[starts] += 1
        change[starts + self.width] -= 1
        return np.cumsum(change[:-1]) > 0


class Batch:
    """The texts of one batch that are still alive, parsed as far as the answers go."""

    def __init__(self, texts: pa.Table, answers: Answers, width: int, levels: int):
        marks = texts.column("_mark").to_numpy() if texts.num_rows else np.zeros(0, np.int64)
        self.rows, self.answers, self.levels = np.flatnonzero(answers.alive(marks)), answers, levels
        self.marks = marks[self.rows]
        self.chunks = [(first, rows, Chunk(data, borders, width)) for first, rows, data, borders in text_chunks(texts.column("_text").take(pa.array(self.rows)))] if len(self.rows) else []
        for level in range(levels):
            self.hear(self.ask(level), level)

    def ask(self, level: int) -> list[np.ndarray]:
        return [c.ask(level) for _, _, c in self.chunks]

    def hear(self, names: list[np.ndarray], level: int) -> None:
        if names:
            shared = self.answers.shared(np.concatenate(names), level)
            for (_, _, c), part in zip(self.chunks, np.split(shared, np.cumsum([len(n) for n in names])[:-1])):
                c.hear(part)

    def notes(self) -> dict[int, bytes]:
        """The marks of the texts that are still alive, and the answers that these asked for."""
        rows = [np.logical_or.reduceat(np.append(c.open, False), c.bounds[:-1]) & (np.diff(c.bounds) > 0) for _, _, c in self.chunks]
        marks = np.unique(self.marks[np.concatenate(rows)]) if rows else np.zeros(0, np.int64)
        out = {ALIVE: marks.tobytes()}
        alive = [np.isin(self.marks[first : first + n], marks) for first, n, _ in self.chunks]
        for level in range(self.levels):
            parts = [tuple(x[own[text]] for x in (names, shared)) for own, (names, text, shared) in ((a, c.heard[level]) for a, (_, _, c) in zip(alive, self.chunks))]
            distinct, _, back = _distinct(np.concatenate([n for n, _ in parts] or [np.zeros(0, np.uint64)])[:, None])
            bits = np.zeros(len(distinct), bool)
            bits[back] = np.concatenate([b for _, b in parts] or [bits])
            out[-1 - level] = np.packbits(bits).tobytes()
        return out


class Removal:
    """The plan of one removal: what each pass does with a batch of documents."""

    def __init__(self, buckets: int, width: int, rounds: int):
        self.buckets, self.width, self.rounds = buckets, width, rounds

    def batch(self, texts: pa.Table, answers: pa.Table | None, levels: int) -> Batch:
        return Batch(texts, Answers(answers, self.buckets), self.width, levels)

    def ask(self, texts: pa.Table, answers: pa.Table | None, level: int) -> Iterator[pa.RecordBatch]:
        """A batch's questions of one level, or for its windows once all levels are settled, and its notes."""
        if not texts.num_rows:
            return
        number, batch = texts.column("batch")[0].as_py(), self.batch(texts, answers, level)
        last = level == self.rounds
        held = batch.notes() if level else {}
        made = [c.windows()[1] for _, _, c in batch.chunks] if last else batch.ask(level)
        if made:
            yield questions(np.concatenate(made), number, WINDOWS if last else level, self.buckets)
        if held:
            yield notes(held, number, self.buckets)

    def kept(self, texts: pa.Table, answers: pa.Table) -> dict[int, np.ndarray]:
        """For each row that loses words, whether each of its words stays."""
        batch = self.batch(texts, answers, self.rounds)
        found = [c.windows() for _, _, c in batch.chunks]
        out = {}
        if found:
            shared = batch.answers.shared(np.concatenate([names for _, names in found]), WINDOWS)
            for (first, rows, c), (at, _), own in zip(batch.chunks, found, np.split(shared, np.cumsum([len(at) for at, _ in found])[:-1])):
                gone = c.covered(at[own])
                for r in np.unique(np.searchsorted(c.bounds, np.flatnonzero(gone), side="right") - 1).tolist():
                    out[int(batch.rows[first + r])] = ~gone[c.bounds[r] : c.bounds[r + 1]]
        return out


def remove_repeats(docs: DataFrame, text_col: str, finish: Callable[[pa.Table, dict[int, np.ndarray]], pa.Table], schema: str, width: int = WINDOW, rounds: int = ROUNDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Run the passes; ``finish`` makes the output columns from a batch's table and the kept words of the rows that lose some.

    Null and empty texts have no words. Repeated rows are occurrences of their own, so copies remove each
    other. Texts shorter than a window stay. ``docs`` has no columns named ``_text``, ``_mark`` or ``batch`` (callers
    shield theirs). Equal rows are spread over batches by the input partition that they stand in.
    """
    total = text_bytes(docs, text_col)
    batches = max(1, math.ceil(total / batch_bytes))
    partitions = min(MOST_PARTITIONS, max(1, math.ceil(batches / PARTITION_BATCHES)))
    plan = Removal(max(partitions, 12), width, rounds)
    others = [c for c in docs.columns if c != text_col]
    key = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in docs.columns]), F.lit(batches))
    dealt = docs.select(*[F.col(c) for c in others], F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_mark"), key.alias("batch")).repartition(partitions, "batch")

    def asked(level: int, answers: DataFrame | None) -> DataFrame:
        if answers is None:
            return map_sorted(dealt, lambda texts: plan.ask(texts, None, level), ASKED)
        return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda texts, own: _table(plan.ask(texts, own, level)), ASKED)

    answers = None
    for level in range(rounds + 1):
        answers = map_groups(asked(level, answers), "bucket", answer, ANSWERED)

    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda texts, own: finish(texts, plan.kept(texts, own)), schema)


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    found = list(batches)
    return pa.Table.from_batches(found) if found else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())], names=["bucket", "batch", "kind", "names", "many"])


def map_sorted(dealt: DataFrame, kernel: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``kernel`` over each batch of documents, without another shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "batch"):
            yield from kernel(table)

    return dealt.sortWithinPartitions("batch").mapInArrow(run, schema)


def word_counts(column: pa.ChunkedArray) -> np.ndarray:
    """Words of each text; null has none."""
    out = np.zeros(len(column), np.int64)
    for first, rows, data, borders in text_chunks(column):
        out[first : first + rows] = np.diff(word_spans(data, borders)[2])
    return out


def joined(raw: bytes, stays: np.ndarray | None) -> bytes:
    """The kept words of a text, one space between them."""
    words = raw.split()
    return b" ".join(words if stays is None else compress(words, stays))


def _raw(column: pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of each document.

    Null and empty texts have 0 words and the digest of no bytes. Rows that repeat an id or a whole row have a row each,
    and count as different places. Texts of any length are taken whole. An empty table gives no rows; other columns
    are not read.
    """

    def finish(texts: pa.Table, rows: dict[int, np.ndarray]) -> pa.Table:
        counts = word_counts(texts.column("_text"))
        gone = np.zeros(len(counts), np.int64)
        for r, stays in rows.items():
            gone[r] = len(stays) - int(stays.sum())
        kept = [hashlib.sha256(joined(raw, rows.get(r))).hexdigest() for r, raw in enumerate(_raw(texts.column("_text")))]
        return pa.table([texts.column(id_col), pa.array(counts), pa.array(gone), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    named = pick(docs, id_col, text_col)
    kind = named.schema[id_col].dataType.simpleString()
    return remove_repeats(named, text_col, finish, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string", width, batch_bytes=batch_bytes)


def without_repeats(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", width: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages taken out of the texts; a text that loses nothing stays as it is, others
    become their kept words with one space between them (possibly none). ``length_col`` follows the new text. Null and
    empty texts stay as they are; every row stays, repeated ones too."""
    plain, at = shield(docs)
    columns, text = plain.columns, at[text_col]

    def finish(texts: pa.Table, rows: dict[int, np.ndarray]) -> pa.Table:
        new = texts.column("_text")
        if rows:
            held = new.to_pylist()
            for r, stays in rows.items():
                held[r] = joined(held[r].encode(), stays).decode()
            new = pa.array(held, pa.string())
        return pa.table([new if c == text else texts.column(c) for c in columns], names=columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    out = remove_repeats(plain, text, finish, schema, width)
    if length_col in docs.columns:
        out = out.withColumn(at[length_col], F.char_length(text).cast(plain.schema[at[length_col]].dataType))
    return out.toDF(*docs.columns)
