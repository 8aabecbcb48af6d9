import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringloom.functions import scalars
from stringloom.operators import align, index, kernels, navigate, ranges, relative, saved, search, tree
from stringloom.session import shared_dir
from stringloom.sources import generators, readers


def small(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abé\U0001d54f") for _ in range(rng.randint(0, 60)))) for i in range(25)] + [(100, None), (101, ""), (102, "a" * 300), (103, "banana")]
    return spark.createDataFrame(rows, "text_id bigint, text string").withColumn("n", F.lit("x")), dict(rows)


PATTERNS = ["a", "ab", "é\U0001d54f", "", "zz", "aaa", "nan", "ana", "b" * 70]


def occurrences(text, pattern):
    return [i for i in range(len(text) + 1) if text.startswith(pattern, i)]


def test_a_saved_index_answers_without_building(spark, tmp_path):
    df, texts = small(spark)
    saved.save(df, str(tmp_path / "packed"))
    own = saved.load(spark, str(tmp_path / "packed"))
    found = saved.find(own, PATTERNS)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.find(df, PATTERNS).collect()))
    assert sorted(map(tuple, saved.locate(own, PATTERNS).collect())) == sorted(map(tuple, search.locate(df, PATTERNS).collect()))
    assert {r["cnt"] for r in found.filter("text_id = 102 AND pattern = 'aaa'").collect()} == {298}
    asked = spark.createDataFrame([(p,) for p in PATTERNS + PATTERNS + [None]], "q string")
    expected = sorted((i, p, len(occurrences(t, p))) for i, t in texts.items() if t is not None for p in PATTERNS if occurrences(t, p))
    for chars, share in ((5, 200), (1 << 20, 1 << 20)):
        got = saved.find_all(own, asked, "q", part_chars=chars, share_bytes=share)
        assert sorted((r["text_id"], r["pattern"], r["cnt"]) for r in got.collect()) == expected
    assert saved.find_all(own, asked.limit(0), "q").count() == 0
    assert saved.find(saved.pack(df.limit(0)), PATTERNS).count() == 0


def test_order_faults_notice_wrong_ranges(spark):
    df, _ = small(spark)
    own = saved.pack(df)
    right = saved.find(own, PATTERNS)
    assert {r["faults"] for r in saved.order_faults(own, right).collect()} == {0}
    for wrong in ("sp + 1, ep", "sp, ep + 1", "sp - 1, ep", "sp, ep - 1", "1, 0"):
        sp, ep = wrong.split(", ")
        bent = right.filter("text_id = 103 AND pattern = 'ana'").selectExpr("text_id", "pattern", f"CAST({sp} AS BIGINT) AS sp", f"CAST({ep} AS BIGINT) AS ep", "cnt")
        assert [r["faults"] > 0 for r in saved.order_faults(own, bent).collect()] == [True]
    held = search.locate(df, ["ana"]).withColumn("pos", F.when(F.col("text_id") == 103, F.col("pos") + 1).otherwise(F.col("pos")))
    assert search.checked(df, held).collect()[0]["faults"] == 2


def test_down_the_suffix_tree(spark):
    df, _ = small(spark)
    got = saved.forward_find(tree.tree_nodes(df), df, PATTERNS)
    expected = search.find(df, PATTERNS).filter("cnt > 0").select("text_id", "pattern", "sp", "ep")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    some = tree.tree_nodes(df, columns=["sp", "ep", "depth", "leaf", "pos"])
    whole = tree.tree_nodes(df).select(some.columns)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.collect()))
    walk = [(r["visit"], r["sp"], r["ep"]) for r in tree.walk(some).filter("text_id = 103").orderBy("visit").collect()]
    assert [w[0] for w in walk] == list(range(len(walk))) and walk[0][1:] == (0, 6)


def test_digests_by_hand(spark):
    df, texts = small(spark)
    got = {r["text_id"]: r["digest"] for r in search.place_digest(search.locate(df, ["ana", "n"])).collect()}
    assert got[103] == str(kernels.fnv1a([3, 1, 4, 2]))
    walks = {r["text_id"]: r["digest"] for r in tree.traversal_digest(tree.tree_nodes(df)).collect()}
    visits = []
    nodes = sorted({(r["sp"], -r["ep"]) for r in tree.tree_nodes(df).filter("text_id = 103").collect()})

    def visit(node, rest):
        sp, ep = node[0], -node[1]
        visits.extend((sp, ep))
        inside = [n for n in rest if sp <= n[0] and -n[1] <= ep]
        while inside:
            first = inside[0]
            visit(first, [n for n in inside[1:] if -n[1] <= -first[1]])
            inside = [n for n in inside[1:] if n[0] > -first[1]]
        if sp < ep:
            visits.extend((sp, ep))

    visit(nodes[0], nodes[1:])
    assert walks[103] == str(kernels.fnv1a(visits))
    values = spark.createDataFrame([([1, 2, -1],), ([],), (None,)], "v array<bigint>").select(scalars.fnv1a("v").alias("d")).collect()
    assert [r["d"] for r in values] == [str(kernels.fnv1a([1, 2, (1 << 64) - 1])), str(kernels.FNV_OFFSET), None]


def test_run_matching_and_common_subsequences():
    rng = random.Random(7)

    def by_steps(a, b):
        """The same rule, a symbol at a time."""
        i = j = 0
        out = []
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                s, x, y = a[i], i, j
                while x < len(a) and y < len(b) and a[x] == s and b[y] == s:
                    out.append((x, y))
                    x, y = x + 1, y + 1
                while i < len(a) and a[i] == s:
                    i += 1
                while j < len(b) and b[j] == s:
                    j += 1
            elif a[i] < b[j]:
                s = a[i]
                while i < len(a) and a[i] == s:
                    i += 1
            else:
                s = b[j]
                while j < len(b) and b[j] == s:
                    j += 1
        return out

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert kernels.match_runs(a, b) == by_steps(a, b)
        pairs = kernels.common_subsequence(a, b)
        assert len(pairs) == longest(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert kernels.common_subsequence("abc", "xyz", 5) is None and kernels.common_subsequence("", "") == []


def pairs_of(spark):
    rng = random.Random(5)
    rows = []
    for i in range(12):
        ref = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        seq = "".join(rng.choice("abc") if rng.random() < 0.2 else c for c in ref)
        rows.append((i, ref, seq))
    return spark.createDataFrame([*rows, (50, None, "a"), (51, "ab", None)], "pair_id bigint, ref string, seq string"), rows


def test_alignments_and_their_faults(spark):
    pairs, rows = pairs_of(spark)
    sides = [index.suffix_table(pairs.select("pair_id", F.col(c).alias("text")), ["pos", "ch", "lf"], id_col="pair_id") for c in ("ref", "seq")]
    for aligned in (align.block_alignment(pairs), align.block_alignment(pairs, block=2, depth=6), align.run_alignment(pairs)):
        assert {r["faults"] for r in align.alignment_faults(aligned, *sides).collect()} <= {0}
    aligned = align.block_alignment(pairs)
    bent = aligned.withColumn("seq_rank", F.when(F.col("pair_id") == 3, F.col("seq_rank") + 1).otherwise(F.col("seq_rank")))
    assert [r["pair_id"] for r in align.alignment_faults(bent, *sides).filter("faults > 0").collect()] == [3]
    texts = align.to_suffix_order(align.lcs_alignment(pairs), *sides).join(sides[0].select("pair_id", F.col("rank").alias("ref_rank"), F.col("ch").alias("a")), ["pair_id", "ref_rank"]).join(sides[1].select("pair_id", F.col("rank").alias("seq_rank"), F.col("ch").alias("b")), ["pair_id", "seq_rank"])
    assert texts.count() == align.lcs_alignment(pairs).count() and texts.filter("a <> b").isEmpty()
    asked = spark.createDataFrame([(i, p) for i, _, _ in rows for p in (0, 5, 1000)], "pair_id bigint, ref_pos bigint")
    mapped = align.map_position(align.lcs_alignment(pairs), asked).collect()
    by_id = {i: (r, s) for i, r, s in rows}
    assert len(mapped) == 36 and all(m["seq_pos"] is None or by_id[m["pair_id"]][0][m["ref_pos"]] == by_id[m["pair_id"]][1][m["seq_pos"]] for m in mapped)
    sizes = pairs.filter("ref IS NOT NULL AND seq IS NOT NULL").select("pair_id", (F.char_length("ref") + 1).alias("ref_size"), (F.char_length("seq") + 1).alias("seq_size"))
    counts = {r["pair_id"]: r["count"] for r in aligned.groupBy("pair_id").count().collect()}
    assert all(r["aligned"] == counts.get(r["pair_id"], 0) and r["ref_lost"] == r["ref_size"] - r["aligned"] for r in align.alignment_losses(aligned, sizes).join(sizes, "pair_id").collect())


def test_partition_statistics_by_hand(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 3, 0, 1), (1, 1, 6, 8, 2, 9), (2, 0, 2, 4, 0, 4), (2, 1, 4, 5, 3, 5)], "pair_id bigint, block_no bigint, ref_sp bigint, ref_ep bigint, seq_sp bigint, seq_ep bigint")
    sizes = spark.createDataFrame([(1, 12, 10), (2, 6, 6), (3, 4, 5)], "pair_id bigint, ref_size bigint, seq_size bigint")
    got = {r["pair_id"]: tuple(r)[1:] for r in align.partition_statistics(blocks, sizes).collect()}
    assert got[1] == (2, 5, 5, 0, 2, 5, 0, 0)
    assert got[2][:2] == (2, 5) and got[2][-2:] == (1, 1)
    assert got[3] == (0, 0, 4, 5, 0, 0, 0, 0)


def test_relative_index_on_disk(spark, tmp_path):
    pairs = pairs_of(spark)[0].filter("ref IS NOT NULL AND seq IS NOT NULL")
    ref, seq = (index.suffix_table(pairs.select("pair_id", F.col(c).alias("text")), ["ch", "lf", "occ"], id_col="pair_id") for c in ("ref", "seq"))
    aligned = align.block_alignment(pairs)
    readers.save_relative({"aligned": aligned, "ref_rest": align.complement(ref, aligned, "ref"), "seq_rest": align.complement(seq, aligned, "seq")}, str(tmp_path))
    kept = readers.load_relative(spark, str(tmp_path))
    got = align.relative_lf(ref, kept["seq_rest"], kept["aligned"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, seq.select("pair_id", "rank", "ch", "occ", "lf").collect()))


def test_run_measures_by_hand(spark):
    bits = [0, 0, 1, 1, 1, 0, 1, 0, 0, 0]

    def brute(bits):
        runs = gap0 = gap1 = run = prev0 = prev1 = border = 0
        for i, b in enumerate(bits, 1):
            if b != (bits[i - 2] if i > 1 else 0):
                run += (i - border).bit_length()
                runs += b
                border = i
            if b:
                gap1, prev1 = gap1 + (i - prev1).bit_length(), i
            else:
                gap0, prev0 = gap0 + (i - prev0).bit_length(), i
        return runs, gap0, gap1, run

    rng = random.Random(2)
    columns = [bits, [1] * 9, [0] * 7, *([rng.randrange(2) for _ in range(rng.randint(1, 40))] for _ in range(20))]
    df = spark.createDataFrame([(g, i, bool(b)) for g, own in enumerate(columns) for i, b in enumerate(own)], "g bigint, i bigint, b boolean")
    assert {r["g"]: tuple(r)[1:] for r in ranges.run_measures(df, "g", "i", "b").collect()} == {g: brute(own) for g, own in enumerate(columns)}


def test_small_helpers(spark):
    row = spark.sql("SELECT 5 AS v, -3 AS w, 12 AS x").select(
        navigate.clamp(F.col("v"), F.lit(0), F.lit(3)).alias("a"), navigate.clamp(F.col("w"), F.lit(0), F.lit(3)).alias("b"), navigate.range_length(F.col("v"), F.col("x")).alias("c"),
        navigate.range_length(F.lit(1), F.lit(0)).alias("d"), relative.gigabytes(F.lit(3 << 30)).alias("e"), relative.microseconds(F.lit(2.0), F.lit(1000)).alias("f"),
        relative.microseconds(F.lit(2.0), F.lit(0)).alias("g"), scalars.common_prefix(F.lit("abcd"), F.lit("abxd")).alias("h"), scalars.common_prefix(F.lit(""), F.lit("a")).alias("i"),
    ).first()
    assert tuple(row) == (3, 0, 8, 0, 3.0, 2000.0, None, 2, 0)
    texts = spark.createDataFrame([(1, "AACCGN" + "T"), (2, "AC"), (3, None), (4, "a\nb\n"), (5, "")], "text_id bigint, text string")
    assert sorted({r["text_id"] for r in index.default_alphabet(texts).collect()}) == [1]
    assert {r["text_id"]: r["sequences"] for r in navigate.sequence_counts(texts, mark="\n").collect()} == {1: 1, 2: 1, 4: 2, 5: 1}
    same = align.map_alphabet(spark.createDataFrame([(1, "x")], "pair_id bigint, ch string"), spark.createDataFrame([(1, "b"), (1, "a")], "pair_id bigint, ch string"), is_sorted=False)
    assert sorted(map(tuple, same.collect())) == [(1, "a", "a", True), (1, "b", "b", True)]


def test_random_probes_and_streams(spark, tmp_path):
    p = generators.random_positions(spark, 5000, 1000)
    assert p.filter("pos < 0 OR pos >= 1000").isEmpty() and p.select("pos").distinct().count() > 900
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, generators.random_positions(spark, 5000, 1000).repartition(3).collect()))
    r = generators.random_ranges(spark, 5000, 100_000)
    assert r.filter("sp < 0 OR ep < sp OR ep >= 100000").isEmpty()
    short = r.filter("ep - sp < 16").count() / 5000
    assert 0.5 <= short <= 0.65
    mutated = generators.mutate(spark.createDataFrame([(1, None), (2, "ACGTN" * 2000), (3, "")], "text_id bigint, text string"), 0.1).collect()
    by_id = {m["text_id"]: m for m in mutated}
    assert by_id[1]["text"] is None and by_id[3]["text"] == ""
    m = by_id[2]
    assert len(m["text"]) == 10_000 + m["inserted"] - m["deleted"] and 650 < m["substitutions"] < 950 and 20 < m["insertions"] < 90


def test_readers_of_whole_texts_agree_with_lines(spark):
    texts = spark.createDataFrame([(1, ">h\nacgnn\nNNa\n>x\nn"), (2, ""), (3, None), (4, "abcd\nab\nxyzw\nxyz1\nqqqq"), (5, "abc1\nabcd")], "text_id bigint, text string")
    lines = readers.lines_of(texts)
    for n in (True, False):
        assert sorted(map(tuple, readers.fasta_of(texts, n).collect())) == sorted(map(tuple, readers.fasta(lines, n).collect()))
    assert sorted(map(tuple, readers.column_of(texts, 3).collect())) == sorted(map(tuple, readers.column(lines, 3).collect()))


def test_increasing_length_and_shared_folder(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, 1, 2, 2, 5, 4, 6])] + [("b", 0, None), ("b", 1, 7)], "g string, i bigint, v bigint")
    assert {r["g"]: (r["entries"], r["length"]) for r in ranges.increasing_length(df, "g", ["i"], "v").collect()} == {"a": (7, 4), "b": (1, 1)}
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("size", [0, 1, 5])
def test_rank_at_among_many_probes(spark, size):
    texts = spark.createDataFrame([(i, "ab" * size + "a") for i in range(3)], "text_id bigint, text string")
    table = index.suffix_table(texts, ["ch"])
    column = {i: [r["ch"] for r in table.filter(F.col("text_id") == i).orderBy("rank").collect()] for i in range(3)}
    probes = [(i, p, c) for i in range(3) for p in (0, 1, 3, 100) for c in ("a", "b", "", "z")]
    got = navigate.rank_at(table, spark.createDataFrame(probes + probes[:3], "text_id bigint, i bigint, ch string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, p, c, column[i][:p].count(c)) for i, p, c in probes)
    assert np.array([len(v) for v in column.values()]).tolist() == [2 * size + 2] * 3
