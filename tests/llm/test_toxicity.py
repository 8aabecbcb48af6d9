import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stringloom.llm import toxicity

BAD = ["idiot", "moron", "worthless", "pathetic"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    syllables = "an the on er in th re nd es ou ti le ar st".split()
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) if rng.random() < 0.7 else "vequ" + rng.choice(syllables) + rng.choice(syllables))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus()
    extra = [(9000, None), (9001, ""), (9002, "an onth ou " * 20000), (9003, "an onth vequtire er"), (9004, "you 1d10t"), (9005, "m o r o n stuff"), (9006, "such a w0rthle$$ thing"), (9007, "paaaathetic"), (9008, "a a a a a a"), (9009, "i.d.i.o.t"), (9000, None), (None, "the an")]
    docs = spark.createDataFrame(rows + extra, "doc_id bigint, text string").withColumn("score", F.lit(5)).withColumn("predicted", F.lit("x")).withColumn("_text", F.lit("y"))
    marks = spark.createDataFrame([*labels, (None, 1), (9001, None), (9001, 7)], "doc_id bigint, toxic int").withColumn("text", F.lit("idiot"))
    return docs, marks, toxicity.toxicity(docs, marks).collect(), dict(labels)


def test_held_out(scored):
    _, _, got, labels = scored
    by_id = {r["doc_id"]: r for r in got}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by_id[i]["held_out"] == (i in set(held)) for i in labels)
    right = [by_id[i]["predicted"] == labels[i] for i in held]
    assert sum(right) / len(right) >= 0.95
    assert not any(by_id[i]["predicted"] for i in held if not labels[i])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_disguised_and_clean(scored):
    _, _, got, _ = scored
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert [by_id[i] for i in range(9000, 9010)] == [0, 0, 0, 1, 1, 1, 1, 1, 0, 1]
    assert len(got) == 612


def test_keep_clean_and_empty_tables(scored):
    docs, marks, _, _ = scored
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {9000, 9001, 9002, None} <= ids and not ids & {9003, 9004}
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0}


def test_viterbi_finds_the_cheapest_path():
    model = toxicity.CharModel([("idiot", 5), ("stupid", 3), ("the", 20), ("class", 4)])
    assert model.restore("1d10t") == "idiot"
    assert model.restore("stuuupid") == "stupid"
    assert model.restore("cl@ss") == "class"
    assert model.restore("") == ""
    assert len(model.restore("t" * 5000)) > 0


def test_disguises_reach_the_lattice():
    plain = "the class small letter good press common mutter little apply stuff spider stupor clover idea scurry moral".split()
    cues = {"=stupid": 0.9, "=idiot": 0.9, "=scum": 0.9, "=trash": 0.9, "=clown": 0.9}
    model = toxicity.CharModel([*((w, 20) for w in plain), *((c[1:], 68) for c in cues)])
    scorer = toxicity.Scorer(cues, model)
    for text in ("stuupid", "iddiot", "scuum", "!diot", "|diot", "+rash", "(lown", "you stu pid thing", "s  c u\nm", "s c u m.", "s c\tu m", "(stu pid)", "st0 stu p1d"):
        assert scorer.score(f"the {text} class") >= toxicity.THRESHOLD, text
    for text in ("good letter!", "(the press", "common + little", "apply |stuff|", "s c u", "12 100 $5", "stupor idea", "the mutter!!! scurry", ""):
        assert scorer.score(text) < toxicity.THRESHOLD, text


def test_character_model_counts_every_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 5)
    rows = [(i, f"bad bad word{i}") for i in range(40)] + [(100 + i, "quokka fine") for i in range(200)] + [(None, "zyx"), (500, None)]
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(100)]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks).model
    assert model.three["quo"] == model.three["^^q"] == 200 and model.three["yx$"] == 1
    assert model.letters >= set("quokfinezyx")


def test_words_without_a_path_to_a_cue_are_passed_over_losslessly():
    rng = random.Random(8)
    scorer = toxicity.Scorer({"=stoop": 0.9, "=bill": 0.8, "^stoo": 0.7, "=ees": 0.6}, toxicity.CharModel([("stoop", 9), ("bill", 9), ("ees", 5), ("best", 3)]))
    for _ in range(4000):
        seen = "".join(rng.choice("sstooopbille10!8.-3$") for _ in range(rng.randint(1, 8)))
        assert scorer.may_spell(seen) or scorer.word_cue(scorer.model.restore(seen)) == 0.0, seen


def test_trigrams_of_many_words_at_once():
    words = {"quokka": 3, "aaa": 2, "\U0001d54f\U0001d54f\U0001d54f": 4, "straße": 1}
    expected = Counter()
    for w, n in words.items():
        for g in toxicity.trigrams(w):
            expected[g] += n
    assert toxicity.count_trigrams(words) == expected
    assert toxicity.count_trigrams({}) == {}


def plain_score(scorer, text):
    """One text, token by token, pair by pair, without caches and batches."""
    if not text:
        return toxicity.BASE_SCORE
    own = toxicity.Scorer(scorer.cues, scorer.model, scorer.hints)
    cues, shared, hint, tokens = {}, {}, 0.0, text.lower().split()
    for token in tokens:
        found = own.look(token)
        if found:
            if found.value:
                cues[found.cue] = found.value
            for name in found.shared:
                shared.setdefault(name, set()).add(found.word)
            hint = max(hint, found.hint)
    twice = [(own.cues[name], name) for name, words in shared.items() if len(words) > 1]
    if twice:
        cues[max(twice)[1]] = max(twice)[0]
    cues |= own.parted_cues(tokens)
    for m in toxicity._SPACED.finditer(text.lower()):
        parts = m.group(0).split()
        if len(set(parts)) > 2 and own.joined_cue("".join(parts)):
            cues["".join(parts)] = own.joined_cue("".join(parts))
    if cues:
        return max(toxicity.BASE_SCORE, 1 - math.prod(1 - v for v in cues.values()))
    return toxicity.BASE_SCORE + (0.9 * toxicity.THRESHOLD - toxicity.BASE_SCORE) * min(1.0, hint / toxicity.LEAST_CUE)


def test_batches_equal_plain_scores(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 300)
    rng = random.Random(4)
    cues = {"=stupid": 0.9, "=idiot": 0.9, "^moro": 0.6, "2vequ": 0.7, "=scum": 0.8}
    model = toxicity.CharModel([("stupid", 9), ("idiot", 9), ("the", 50), ("press", 9), ("vequan", 3)])
    scorer = toxicity.Scorer(cues, model, {"=press": 0.3, "^thea": 0.45})
    parts = ["the", "thea", "press", "stu", "pid", "stuupid", "!diot", "vequan", "vequer", "vequer.", "s c u m", "s", "c", "u", "m!", "moroso", "12", "--", "id", "iot", "v3quan", "\n", "\x1f", "İdiot", "é"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "  \n ", "the " * 3000 + "stu pid"]
    for column in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string()).slice(1)):
        assert scorer.score_column(column).tolist() == [plain_score(scorer, t) for t in texts]


def test_beginnings_that_two_words_share():
    scorer = toxicity.Scorer({"2achlich": 0.7}, toxicity.CharModel([("achlich", 2)]))
    assert scorer.score("der achlichst und") == toxicity.BASE_SCORE
    assert scorer.score("der achlichst und achlichst") == toxicity.BASE_SCORE
    assert scorer.score("der achlichst und achlichau.") == pytest.approx(0.7)
    assert {"2achl", "2achlich", "^achlich", "=achlichst"} <= toxicity.features("achlichst achlichau")


TABLES = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not TABLES.exists(), reason="needs the driver's tables")
def test_held_out_rows_of_the_tables(spark):
    docs, marks = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [(got[r["doc_id"]]["score"], r["toxic"]) for r in marks.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    toxic, clean = (np.array([s for s, y in held if y == want]) for want in (1, 0))
    assert (toxic >= 0.3).mean() >= 0.9 and (clean >= 0.3).mean() <= 0.03
    assert (toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2 >= 0.95
