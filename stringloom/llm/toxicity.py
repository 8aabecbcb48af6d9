"""Toxicity: noisy-channel restoration of disguised words, then cue scoring of the restored text.

Disguised spellings (digits and signs for letters, also at the edges of words, doubled and drawn-out letters, words
parted by white space or signs) form a lattice of possible letters. A Viterbi search picks the path that is likeliest
under a character trigram model of all words outside the held-out fold, weighted by the cost of each disguise. Original
and restored words are then looked up among cues: words, word beginnings, and beginnings that two different words of a
text share, whose presence, by a lower confidence bound on the training rows, makes the toxic label likely. Beginnings let
a cue catch endings that training never saw.

A batch of texts is split into words by Arrow, and each distinct word is looked at once; only texts that hold a
cue, or neighbouring words that could spell one together, are visited one by one.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import crc_fold, mix64, pick, shield, shingles, text_chunks, word_hashes, word_spans

TOXIC_ROWS, CLEAN_ROWS = 4000, 16_000  # of the training sample
PREFIXES = (4, 5, 6, 7)
LEAST_DOCUMENTS = 6  # different toxic documents behind a cue
CAUTION = 12.0  # squared width of the confidence bound
LEAST_CUE, LEAST_HINT = 0.5, 0.2  # bounds of cues, and of the hints that grade texts without a cue
THRESHOLD = 0.3
BASE_SCORE = 0.02
CACHE_WORDS, CACHE_PAIRS = 150_000, 30_000
CHUNK_BYTES = 2 << 20

# The letters that a sign can stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
}
SIGN_COST, REPEAT_COST, DROP_COST, DROP_SIGN_COST, SPACE_COST = 0.3, 0.5, 1.0, 4.0, 1.0

_SIGN = regex.escape("".join(x for x in SIGNS if not x.isdigit()), special_only=False)
# Without a letter drawn out or a sign, a word's lattice holds one path; digits alone are numbers.
_SUSPECT = regex.compile(r"^(?=.*\p{L}).*?(?:(\p{L})\1|[^\p{L}'’])", regex.DOTALL)
_DOUBLE = regex.compile(r"(\p{L})\1")
_SPACED = regex.compile(rf"(?<!\S)[\w{_SIGN}](?:\s+[\w{_SIGN}]){{2,}}(?=[^\w\s]*(?!\S))")
_OUTER = regex.compile(rf"^[^\p{{L}}\p{{N}}{_SIGN}]+|[^\p{{L}}\p{{N}}{_SIGN}]+$")
_SINGLE = regex.compile(rf"[\w{_SIGN}]")
_LAST = regex.compile(rf"[\w{_SIGN}][^\w\s]*")
_EDGES = regex.compile(r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}@$]+$|^([@$])\1{2,}|([@$])\2{2,}$")


def plain_word(token: str) -> str:
    """A lower-case token without the signs around it."""
    bare = token.strip(".,;:?")
    return bare if bare.isalpha() else _EDGES.sub("", token).strip("@$")


class Tokens:
    """The words of some texts: distinct ones in lower case, and for each text and place the number of its word."""

    def __init__(self, column: pa.Array):
        lists = pc.utf8_split_whitespace(pc.fill_null(column, ""))
        self.bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.bounds -= self.bounds[0]
        raw = coded.indices.to_numpy(zero_copy_only=False)
        distinct: dict[str, int] = {}
        lower = np.array([distinct.setdefault(t.lower(), len(distinct)) for t in coded.dictionary.to_pylist()], np.int64)
        self.distinct = list(distinct)
        self.ids = lower[raw] if len(raw) else np.zeros(0, np.int64)
        self.text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def texts_with(self) -> np.ndarray:
        """For each distinct word the number of texts that hold it."""
        pairs = np.unique(self.text * max(1, len(self.distinct)) + self.ids)
        return np.bincount(pairs % max(1, len(self.distinct)), minlength=len(self.distinct))


def token_chunks(column: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """(first row, words) of runs of texts of about CHUNK_BYTES."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK_BYTES, side="right")))
        yield a, Tokens(column.slice(a, b - a))
        a = b


def trigrams(word: str) -> list[str]:
    """The trigrams of a word with its borders."""
    padded = "^^" + word + "$"
    return [padded[i - 2 : i + 1] for i in range(2, len(padded))]


def count_trigrams(words: dict[str, int]) -> dict[str, int]:
    """The trigrams of many words at once; each word counts as often as it says."""
    if not words:
        return {}
    codes = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 3 for w in words])
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place >= 2)
    keys, back = np.unique((codes[at - 2] << np.uint64(42)) | (codes[at - 1] << np.uint64(21)) | codes[at], return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, back, np.repeat(np.fromiter(words.values(), np.int64), sizes - 2))
    return {chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF): n for k, n in zip(keys.tolist(), counts.tolist())}


def corpus_trigrams(texts: DataFrame) -> DataFrame:
    """(gram, n) over every text of a single-column table: each text counts its distinct plain words once, and the
    empty gram counts the words. Each task adds up its own counts first, so a gram takes one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for _, tokens in token_chunks(batch.column(0)):
                words: Counter = Counter()
                for token, n in zip(tokens.distinct, tokens.texts_with().tolist()):
                    word = plain_word(token)
                    if len(word) >= 3 and word.isalpha():
                        words[word] += n
                total[""] += words.total()
                total.update(count_trigrams(words))
        if total:
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    return texts.mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Add-k trigram model over letters, with word borders."""

    def __init__(self, words: Iterable[tuple[str, float]]):
        self.three, self.two, self.letters = defaultdict(float), defaultdict(float), set()
        self.seen: dict[str, float] = {}
        for word, n in words:
            self.add(((gram, n) for gram in trigrams(word)))
        self.size = len(self.letters) + 2

    def add(self, grams: Iterable[tuple[str, float]]) -> None:
        """Take in trigrams and how often each stands."""
        for gram, n in grams:
            self.three[gram] += n
            self.two[gram[:2]] += n
            if gram[2] != "$":
                self.letters.add(gram[2])
        self.size = len(self.letters) + 2

    def cost(self, context: str, letter: str) -> float:
        key = context + letter
        found = self.seen.get(key)
        if found is None:
            found = self.seen[key] = -math.log((self.three.get(key, 0.0) + 0.1) / (self.two.get(context, 0.0) + 0.1 * self.size))
        return found

    def spell(self, word: str) -> float:
        """The cost of a plain word."""
        padded = "^^" + word + "$"
        return sum(self.cost(padded[i - 2 : i], padded[i]) for i in range(2, len(padded)))

    def restore(self, seen: str) -> str:
        """The likeliest word behind a disguised one."""
        return self.read(seen)[1]

    def read(self, seen: str) -> tuple[float, str]:
        """The cheapest path through the lattice of a disguised word, and the word it spells."""
        states: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
        ahead: dict[int, dict[str, tuple[float, str]]] = {0: states}
        i = 0
        while i < len(seen):
            states = ahead.pop(i, {})
            ch, run = seen[i], 1
            while i + run < len(seen) and seen[i + run] == ch:
                run += 1
            options = [(ch, 0.0)] if ch.isalpha() else []
            options += [(x, SIGN_COST) for x in SIGNS.get(ch, "")]
            if not ch.isalpha():
                options.append(("", DROP_SIGN_COST if ch in SIGNS else DROP_COST))
            moves = [(x * n, cost + (REPEAT_COST if n != run else 0.0), run) for x, cost in options for n in sorted({1, 2, run} if x else {1}) if n <= run]
            for text, cost, length in moves:
                into = ahead.setdefault(i + length, {})
                for context, (spent, made) in states.items():
                    total, here = spent + cost, context
                    for x in text:
                        total += self.cost(here, x)
                        here = here[1] + x
                    old = into.get(here)
                    if old is None or total < old[0]:
                        into[here] = (total, made + text)
            i += run
        ends = [(spent + self.cost(context, "$"), made) for context, (spent, made) in ahead.get(len(seen), {}).items()]
        return min(ends) if ends else (math.inf, seen)


class Found:
    """What a token says: its strongest cue, the shared beginnings it counts for and the word behind it, its hint, and
    the beginnings of cues that it spells from its start to its end."""

    __slots__ = ("begun", "cue", "hint", "shared", "value", "word")

    def __init__(self, value: float, cue: str, shared: tuple[str, ...], hint: float, word: str, begun: dict[str, float]):
        self.value, self.cue, self.shared, self.hint, self.word, self.begun = value, cue, shared, hint, word, begun


class Scorer:
    """Cues, hints and character model of one training run. A cue is '=' and a word, '^' and a word's beginning, or '2' and
    a beginning that two different words of a text share."""

    def __init__(self, cues: dict[str, float], model: CharModel, hints: dict[str, float] | None = None):
        self.cues, self.model, self.hints = cues, model, hints or {}
        self.known: dict[str, Found | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.lengths = sorted({len(w) - 1 for w in cues if w[0] == "="})
        self.starts = {w[1 : 1 + n] for w in cues if w[0] == "=" and len(w) > PREFIXES[0] for n in range(1, len(w))}
        self.heads = {w[1:5] for w in (*cues, *self.hints)}
        self.stems = {w[1:] for w in cues if w[0] != "="}
        self.paths = {""} | {w[1 : 1 + n] for w in cues for n in range(1, len(w))}

    def word_cue(self, word: str) -> float:
        """The strongest cue of a clean word."""
        return self.named_cue(word)[0]

    def named_cue(self, word: str) -> tuple[float, str]:
        names = ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]
        return max((self.cues.get(name, 0.0), name) for name in names)

    def shared_cues(self, word: str) -> tuple[str, ...]:
        return tuple(name for n in PREFIXES if len(word) >= n and (name := "2" + word[:n]) in self.cues)

    def look(self, token: str) -> Found | None:
        """What a lower-case token says as written or, if that is nothing, as restored; None for nothing."""
        bare = token.strip(".,;:?")
        if bare.isalpha() and bare[:4] not in self.heads and not _DOUBLE.search(bare):  # one path, and no cue or hint begins so
            return Found(0.0, "", (), 0.0, bare, {bare: 0.0}) if bare in self.starts else None
        word, seen = plain_word(token), _OUTER.sub("", token)
        value, cue = self.named_cue(word)
        shared = self.shared_cues(word)
        if not value and not shared and _SUSPECT.search(seen) and self.may_spell(seen):
            word = self.model.restore(seen)
            value, cue = self.named_cue(word)
            shared = self.shared_cues(word)
        hint = max((self.hints.get(name, 0.0) for name in ("=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n))), default=0.0)
        begun = {at: spent for at, spent in self.walk({"": 0.0}, seen).items() if at}
        return Found(value, cue, shared, hint, word, begun) if value or shared or hint or begun else None

    def token(self, token: str) -> Found | None:
        found = self.known.get(token, self)
        if found is self:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[token] = self.look(token)
        return found

    def token_cue(self, token: str) -> float:
        """The strongest cue of a token as written or restored."""
        found = self.token(token)
        return found.value if found else 0.0

    def goes_on(self, first: str, second: str) -> bool:
        """Whether two neighbouring tokens spell the beginning of a cue together, or the second is nothing but signs."""
        found = self.pairs.get((first, second))
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            bare, own = _OUTER.sub("", second), self.token(first)
            found = self.pairs[first, second] = bool(own and own.begun) and (not bare or bool(self.walk({at: spent + SPACE_COST for at, spent in own.begun.items()}, bare)))
        return found

    def may_spell(self, seen: str) -> bool:
        """Whether any path of the word's lattice, however dear, has a cue; without one its likeliest path has none either."""
        states, paths = {""}, self.paths
        for ch in seen:
            if ch.isalpha():
                states = {to for at in states for to in ((at + ch, at) if at[-1:] == ch else (at + ch,)) if to in paths}
            else:
                states |= {to for at in states for x in SIGNS.get(ch, "") if (to := at + x) in paths}
            if not states:
                return False
            if not states.isdisjoint(self.stems):
                return True
        return any("=" + at in self.cues for at in states)

    def walk(self, states: dict[str, float], token: str) -> dict[str, float]:
        """Beginnings of cues, with the least cost of the disguises, that go on from ``states`` through a token."""
        for ch in token:
            made: dict[str, float] = {}
            for at, spent in states.items():
                moves = [(at + ch, spent)] if ch.isalpha() else [(at + x, spent + SIGN_COST) for x in SIGNS.get(ch, "")]
                if at and at[-1] == ch:
                    moves.append((at, spent + REPEAT_COST))
                if not ch.isalpha():
                    moves.append((at, spent + (DROP_SIGN_COST if ch in SIGNS else DROP_COST)))
                for to, cost in moves:
                    if (not to or to in self.starts) and cost < made.get(to, math.inf):
                        made[to] = cost
            states = made
            if not states:
                break
        return states

    def parted_cues(self, tokens: list[str], starts: Iterable[int] | None = None) -> dict[str, float]:
        """The cues that neighbouring tokens spell together, where that is likelier than the tokens one by one."""
        out: dict[str, float] = {}
        for i in range(len(tokens)) if starts is None else starts:
            found = self.token(tokens[i])
            states = found.begun if found else {}
            j = i + 1
            while states and j < len(tokens):
                bare = _OUTER.sub("", tokens[j])
                if bare:
                    states = self.walk({at: spent + SPACE_COST for at, spent in states.items()}, bare)
                whole = {at: spent for at, spent in states.items() if bare and "=" + at in self.cues}
                if whole:
                    apart = sum(self.model.read(_OUTER.sub("", t))[0] for t in tokens[i : j + 1])
                    out.update(("=" + at, self.cues["=" + at]) for at, spent in whole.items() if spent + self.model.spell(at) < apart)
                j += 1
        return out

    def joined_cue(self, letters: str) -> float:
        """The strongest whole-word cue anywhere in letters written apart."""
        best = self.word_cue(letters) if len(letters) >= PREFIXES[0] else 0.0
        for text in {letters, self.model.restore(letters)}:
            for n in self.lengths:
                if n >= PREFIXES[0]:
                    for i in range(len(text) - n + 1):
                        best = max(best, self.cues.get("=" + text[i : i + n], 0.0))
        return best

    def restore_text(self, text: str) -> str:
        """The text with disguised words restored; other words as they are, in lower case."""
        text = _SPACED.sub(lambda m: self.model.restore("".join(m.group(0).lower().split())) if len(set(m.group(0).split())) > 2 else m.group(0), text.lower())
        return " ".join(self.model.restore(_OUTER.sub("", w)) if _SUSPECT.search(_OUTER.sub("", w)) else w for w in text.split())

    def score(self, text: str | None) -> float:
        """The score of one text; see ``score_column``."""
        return float(self.score_column(pa.array([text], pa.string()))[0])

    def score_column(self, column: pa.Array) -> np.ndarray:
        """1 - the product of what the different cues of each text leave. Without a cue the strongest hint grades the
        text below the threshold; without a hint, a word or a text it has the base score."""
        out = np.full(len(column), BASE_SCORE)
        for first, tokens in token_chunks(column):
            if len(tokens.ids):
                self._score_chunk(column, first, tokens, out)
        return out

    def _score_chunk(self, column: pa.Array, first: int, tokens: Tokens, out: np.ndarray) -> None:
        ids, text, bounds, names = tokens.ids, tokens.text, tokens.bounds, tokens.distinct
        found = [self.token(t) for t in names]
        says = np.array([f is not None and bool(f.value or f.shared or f.hint) for f in found])
        opens = np.array([f is not None and bool(f.begun) for f in found])
        inner = text[1:] == text[:-1]
        at = np.flatnonzero(opens[ids[:-1]] & inner)
        if len(at):
            pairs, back = np.unique(ids[at] * len(names) + ids[at + 1], return_inverse=True)
            at = at[np.array([self.goes_on(names[p // len(names)], names[p % len(names)]) for p in pairs.tolist()])[back]]
        single, last = (np.array([bool(p.fullmatch(t)) for t in names]) for p in (_SINGLE, _LAST))
        spaced = np.flatnonzero(single[ids[:-2]] & single[ids[1:-1]] & last[ids[2:]] & inner[1:] & inner[:-1]) if len(ids) > 2 else ids[:0]
        held = np.flatnonzero(says[ids])
        for row in np.unique(np.concatenate([text[held], text[at], text[spaced]])).tolist():
            a, b = bounds[row], bounds[row + 1]
            cues: dict[str, float] = {}
            shared: dict[str, set[str]] = {}
            hint = 0.0
            for i in np.unique(ids[held[np.searchsorted(held, a) : np.searchsorted(held, b)]]).tolist():
                own = found[i]
                if own.value:
                    cues[own.cue] = own.value
                for name in own.shared:
                    shared.setdefault(name, set()).add(own.word)
                hint = max(hint, own.hint)
            twice = [(self.cues[name], name) for name, words in shared.items() if len(words) > 1]
            if twice:
                value, name = max(twice)  # the beginnings of one word are one cue
                cues[name] = value
            starts = at[np.searchsorted(at, a) : np.searchsorted(at, b)]
            if len(starts):
                cues |= self.parted_cues([names[i] for i in ids[a:b].tolist()], (starts - a).tolist())
            if np.searchsorted(spaced, a) < np.searchsorted(spaced, b):
                for m in _SPACED.finditer(column[first + row].as_py().lower()):
                    parts = m.group(0).split()
                    if len(set(parts)) > 2 and (value := self.joined_cue("".join(parts))):
                        cues["".join(parts)] = value
            left = math.prod(1 - v for v in cues.values())
            graded = BASE_SCORE + (0.9 * THRESHOLD - BASE_SCORE) * min(1.0, hint / LEAST_CUE)
            out[first + row] = max(BASE_SCORE, 1 - left) if cues else graded


def features(text: str) -> set[str]:
    """Whole words of a text, their beginnings, and the beginnings that two different words share."""
    words = {w for token in set(text.lower().split()) if len(w := plain_word(token)) >= 3 and w.isalpha()}
    starts = Counter(w[:n] for w in words for n in PREFIXES if len(w) >= n)
    return {"=" + w for w in words} | {"^" + p for p in starts} | {"2" + p for p, n in starts.items() if n > 1}


def _signature(texts: pa.Array) -> np.ndarray:
    """A minhash of each text's three-word shingles: near copies mostly share it."""
    out = np.zeros(len(texts), np.uint64)
    for first, rows, data, borders in text_chunks(texts):
        starts, ends, bounds = word_spans(data, borders)
        words = word_hashes(data, starts, ends)
        for r in range(rows):
            own = words[bounds[r] : bounds[r + 1]]
            made = shingles(own, min(3, len(own))) if len(own) else own
            out[first + r] = mix64(made).min() if len(made) else 0
    return out.view(np.int64)


def _kept(n: int, rows: int, id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(29), id_col), F.lit(1 << 20)) < F.lit(int(min(1.0, rows / max(1, n)) * (1 << 20)) + 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Cues from a bounded, hashed sample of TOXIC_ROWS and CLEAN_ROWS labelled rows; the character model from all of ``docs``.

    Rows without a label, id or text give no cues. Near copies count once behind a cue.
    """
    docs, labels = pick(docs, id_col, text_col), pick(labels, id_col, label_col)
    labels = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).alias("_label"))
    counts = {r[0]: r[1] for r in labels.groupBy("_label").count().collect()}
    toxic_n, clean_n = counts.get(1, 0), counts.get(0, 0)
    chosen = labels.filter(((F.col("_label") == 1) & _kept(toxic_n, TOXIC_ROWS, id_col)) | ((F.col("_label") == 0) & _kept(clean_n, CLEAN_ROWS, id_col))).distinct()
    sample = docs.filter(F.col(text_col).isNotNull()).select(id_col, text_col).join(F.broadcast(chosen), id_col)  # the sample is bounded

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _signature(batch.column(0))
            for text, mark in zip(batch.column(0).to_pylist(), marks):
                made = sorted(features(text))
                yield pa.record_batch([pa.array(made, pa.string()), pa.array(np.full(len(made), mark, np.int64))], names=["feature", "mark"])

    found = sample.filter("_label = 1").select(text_col).mapInArrow(toxic_features, "feature string, mark bigint").distinct()
    support = {r["feature"]: r["n"] for r in found.groupBy("feature").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS).collect()}

    shared = docs.sparkSession.sparkContext.broadcast(frozenset(support))  # at most the words of TOXIC_ROWS rows

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = shared.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(features(text) & wanted)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["feature", "n"])

    partial = sample.filter("_label = 0").select(text_col).mapInArrow(clean_counts, "feature string, n bigint")
    clean = {r["feature"]: r["n"] for r in partial.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    weight = min(1.0, TOXIC_ROWS / max(1, toxic_n)) / min(1.0, CLEAN_ROWS / max(1, clean_n))
    cues, hints = {}, {}
    for feature, t in support.items():
        n = t + clean.get(feature, 0) * weight
        p = t / n
        bound = (p + CAUTION / (2 * n) - math.sqrt(CAUTION * (p * (1 - p) / n + CAUTION / (4 * n * n)))) / (1 + CAUTION / n)
        if bound >= LEAST_HINT:
            (cues if bound >= LEAST_CUE else hints)[feature] = round(bound, 6)
    grams = {r["gram"]: r["n"] for r in corpus_trigrams(docs.select(text_col)).collect()}  # as many as the alphabet makes
    mass = max(1.0, grams.pop("", 0))
    strong = [f[1:] for f in sorted(cues) if f[0] == "="]
    # Disguised words are mostly cues: these get as much of the model's mass as all words of the corpus.
    model = CharModel((w, mass / max(1, len(strong))) for w in strong)
    model.add(grams.items())
    return Scorer(cues, model, hints)


def score(docs: DataFrame, scorer: Scorer, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of ``keep``, score, predicted: every whole text; null and empty texts get the base score. No shuffle; the
    text crosses to Python once, whether it is kept or not."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer.cues, scorer.hints, dict(scorer.model.three), dict(scorer.model.two), scorer.model.letters))
    chosen = docs.select(*dict.fromkeys([text_col, *keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues, hints, three, two, letters = shared.value
        model = CharModel([])
        model.three, model.two, model.letters, model.size = three, two, letters, len(letters) + 2
        own = Scorer(cues, model, hints)
        for batch in batches:
            made = own.score_column(batch.column(0))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(made), pa.array((made >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join([f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep] + ["score double", "predicted int"])
    return chosen.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted): learnt from the labels outside the held-out fold."""
    docs, labels = pick(docs, "doc_id", "text"), pick(labels, "doc_id", "toxic")
    out = F.coalesce(crc_fold("doc_id", fold) == held, F.lit(False))
    scorer = train(docs.filter(~out), labels.filter(crc_fold("doc_id", fold) != held))
    return score(docs.withColumn("held_out", out), scorer, ["doc_id", "held_out"])


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model trained on all labels does not reject."""
    plain, at = shield(docs)
    scored = score(plain, train(docs, labels), plain.columns, text_col=at["text"])
    return scored.filter("predicted = 0").select(*plain.columns).toDF(*docs.columns)
