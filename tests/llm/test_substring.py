import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stringloom.llm import recompress, substring
from stringloom.llm.common import text_chunks, word_hashes, word_spans


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def corpus(rng, n=120):
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(70)]
    texts = [None, "", "one", "a " * 200, "a " * 90 + "b", "a b " * 60, " ".join(passage), "\t\n".join(passage) + "\n", "x\x00y " * 40, "a b " * 50]
    for _ in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(1, 160))]
        if rng.random() < 0.5:
            i, j = sorted(rng.sample(range(71), 2))
            at = rng.randint(0, len(own))
            own[at:at] = passage[i:j]
        if rng.random() < 0.15:
            own += own[-50:]
        texts.append(" ".join(own))
    return texts + texts[20:30]


def test_equals_brute_force(spark):
    for seed, batch in ((1, 2000), (2, 1 << 20)):
        texts = corpus(random.Random(seed))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("batch", F.lit(1)).withColumn("_text", F.lit("z"))
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.removal_digest(df, batch_bytes=batch).collect()}
        assert got == dict(enumerate(brute(texts, 35)))
    assert substring.removal_digest(df.limit(0)).count() == 0


def test_each_level_asks_and_windows_meet_under_an_anchor():
    """The passes over two batches by hand: dead texts ask nothing more, and repeats share anchor and fingerprint."""
    import pyarrow as pa

    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(30)]
    texts[3] = " ".join([*texts[3].split()[:60], *passage])
    texts[20] = " ".join([*passage, *texts[20].split()[:60]])
    tables = [pa.table({"_text": texts[a:b], "_mark": list(range(a, b)), "batch": [n] * (b - a)}) for n, (a, b) in enumerate(((0, 15), (15, 30)))]
    plan, came, asked = substring.Removal(3, 35, 5), [None, None], []
    for level in range(6):
        sent = pa.concat_tables([substring._table(plan.ask(t, own, level)) for t, own in zip(tables, came)])
        asked.append(sum(len(n) for n, k in zip(sent.column("names").to_pylist(), sent.column("kind").to_pylist()) if k >= 0) // (16 if level == 5 else 8))
        parts = [sent.filter(pa.array([x == b for x in sent.column("bucket").to_pylist()])) for b in range(3)]
        back = pa.Table.from_batches([r for part in parts if part.num_rows for r in substring.answer(part)])
        came = [back.filter(pa.array([x == n for x in back.column("batch").to_pylist()])) for n in (0, 1)]
    assert asked[1] < asked[0] / 3 and asked[5] <= 2 * 40
    assert [set(plan.kept(t, own)) for t, own in zip(tables, came)] == [{3}, {5}]
    assert [[int((~v).sum()) for v in plan.kept(t, own).values()] for t, own in zip(tables, came)] == [[50], [50]]


def test_long_texts_null_ids_and_repeated_rows(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(260_000))
    assert len(long) > 1 << 20
    rows = [(1, long), (2, "x " + " ".join(long.split()[1000:1050]) + " y"), (None, "q " * 100), (None, "q " * 100), (5, None), (5, "a b"), (6, " ".join(words[:40])), (6, " ".join(words[:40]))]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.removal_digest(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert got == sorted((i or 0, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 35)))


def test_text_form(spark):
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(1, f"head  kept\n{long} tail", "a", 3, "x"), (2, f"{long}", "b", 4, "y"), (3, "un  touched ", None, 5, "z"), (4, None, "c", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, batch string")
    got = {r["doc_id"]: r for r in substring.without_repeats(df).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == ["head kept tail", "", "un  touched ", None]
    assert [got[i]["n_chars"] for i in (1, 2, 3, 4)] == [14, 0, 12, None]
    assert substring.without_repeats(df).columns == df.columns


def test_contexts_settle_symbols():
    """A symbol whose context lies inside a window appears in every other occurrence of that window."""
    rng = random.Random(7)
    for _ in range(40):
        letters = [f"{rng.randrange(5)}" for _ in range(60)]
        around = [[f"{rng.randrange(5)}" for _ in range(rng.randint(0, 20))] for _ in range(4)]
        texts = [" ".join(around[0] + letters + around[1]).encode(), " ".join(around[2] + letters + around[3]).encode()]
        parsed = []
        for text, before in zip(texts, (around[0], around[2])):
            data = np.frombuffer(text, np.uint8)
            starts, ends, bounds = word_spans(data, np.array([0, len(data)]))
            s = recompress.parse(word_hashes(data, starts, ends), bounds, 6)
            inside = (s.low >= len(before)) & (s.high <= len(before) + 60)
            parsed.append((s, inside, len(before)))
        (a, a_in, a_at), (b, _, b_at) = parsed
        every = set(zip(b.name.tolist(), (b.start - b_at).tolist(), (b.end - b_at).tolist()))
        assert set(zip(a.name[a_in].tolist(), (a.start[a_in] - a_at).tolist(), (a.end[a_in] - a_at).tolist())) <= every


def test_words_and_chunks():
    import pyarrow as pa

    texts = ["", "a b", None, "  x\ty\x0bz \n", "é é", "q" * 50, ""]
    for limit in (1, 7, 1000):
        found = {}
        for first, rows, data, borders in text_chunks(pa.array(texts), limit):
            starts, ends, bounds = word_spans(data, borders)
            for r in range(rows):
                found[first + r] = [data[a:b].tobytes() for a, b in zip(starts[bounds[r] : bounds[r + 1]], ends[bounds[r] : bounds[r + 1]])]
        assert [found[i] for i in range(len(texts))] == [(t or "").encode().split() for t in texts]
