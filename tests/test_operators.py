import random

import pytest
from pyspark.sql import functions as F

from stringloom.operators import align, index, matches, navigate, ranges, relative, search, tree
from stringloom.plans import strategies
from stringloom.sources import generators, readers
from stringloom.streaming import patterns as streams

TEXTS = {1: "banana", 2: "mississippi", 3: "", 4: "a", 5: "aaaa", 6: "naïve né 漢漢", 7: None, 8: "GATTACAGATTANNACA"}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "text_id bigint, text string").cache()


def test_columns_of_golden_texts(texts):
    got = index.suffix_table(texts, list(index.COLUMNS)).filter("text_id = 1").orderBy("rank").collect()
    column = lambda c: [r[c] for r in got]
    assert "".join(x or "$" for x in column("ch")) == "annb$aa"
    assert column("lf") == [1, 5, 6, 4, 0, 2, 3] and column("psi") == [4, 0, 5, 6, 3, 1, 2]
    assert column("psv") == [None, None, 1, 2, None, None, 5] and column("psev") == [None, 0, 1, 2, 1, 4, 5]
    assert column("nsv") == [None, None, 4, 4, None, None, None] and column("nsev") == [1, 4, 4, 4, 5, None, None]
    with pytest.raises(ValueError):
        index.suffix_table(texts, ["nothing"])


def test_kernel_equals_declarative_form(texts):
    a = index.suffix_table(texts, ["pos", "ch"])
    assert matches.differing(a, index.suffix_table_sql(texts)).count() == 0
    assert index.suffix_table(texts.limit(0)).count() == 0


def test_long_text_by_joins(spark):
    text = "abracadabra" * 4
    chars = spark.createDataFrame(list(enumerate(text)), "pos bigint, ch string")
    got = {r["pos"]: r["rank"] for r in index.suffix_ranks_of_long_text(chars).collect()}
    assert [p for p, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(len(text) + 1), key=lambda i: text[i:])


def test_find_and_locate(texts):
    wanted = ["ana", "issi", "s", "", "x", "漢", "a.*", "aaaaaaaa"]
    got = {(r["text_id"], r["pattern"]): (r["sp"], r["ep"], r["cnt"]) for r in search.find(texts, wanted).collect()}
    assert got[1, "ana"] == (2, 3, 2) and got[2, "issi"] == (3, 4, 2) and got[2, "s"] == (8, 11, 4)
    assert got[1, ""] == (0, 6, 7) and got[3, ""] == (0, 0, 1) and got[1, "x"] == (1, 0, 0) and got[6, "漢"][2] == 2
    scanned = {(r["text_id"], r["pattern"]): r["cnt"] for r in search.count_scan(texts, wanted).collect()}
    assert scanned == {key: v[2] for key, v in got.items()}
    places = search.locate(texts, wanted)
    assert search.violations(texts, places).count() == 0
    assert sorted(r["pos"] for r in places.filter("text_id = 5 AND pattern = ''").collect()) == [0, 1, 2, 3, 4]
    many = texts.sparkSession.createDataFrame([(chr(97 + i),) for i in range(26)], "pattern string")
    assert {r["cnt"] for r in strategies.pattern_counts(texts, many).filter("text_id = 1 AND pattern = 'a'").collect()} == {3}


def test_tree_of_golden_texts(texts):
    nodes = tree.tree_nodes(texts).cache()
    assert {(r["sp"], r["ep"], r["depth"]) for r in tree.intervals(nodes).filter("text_id = 1").collect()} == {(0, 6, 0), (1, 3, 1), (2, 3, 3), (5, 6, 2)}
    assert {(r["sp"], r["ep"], r["depth"]) for r in tree.intervals(nodes).filter("text_id = 2").collect()} == {(0, 11, 0), (1, 4, 1), (3, 4, 4), (6, 7, 1), (8, 9, 2), (8, 11, 1), (10, 11, 3)}
    assert {r["text_id"]: r["nodes"] for r in tree.counts(nodes).collect()} | {8: 0} == {1: 11, 2: 19, 3: 1, 4: 3, 5: 9, 6: tree.counts(nodes).filter("text_id = 6").first()["nodes"], 8: 0}
    links = {(r["sp"], r["ep"]): (r["link_sp"], r["link_ep"]) for r in tree.suffix_links(nodes).filter("text_id = 1").collect()}
    assert links[2, 3] == (5, 6) and links[5, 6] == (1, 3) and links[1, 3] == (0, 6)


def test_matching_statistics(spark):
    pairs = [(1, "TTACATTAGACAXGATN", 1, TEXTS[8]), (2, None, 1, "x"), (3, "", 1, "x"), (4, "zz", 1, ""), (5, "aaa", 2, "aaaaa")]
    df = spark.createDataFrame(pairs, "query_id bigint, query string, text_id bigint, text string")
    found = matches.matching_statistics(df).cache()
    assert [r["length"] for r in found.filter("query_id = 1").orderBy("start").collect()] == [5, 4, 3, 2, 4, 3, 2, 3, 2, 3, 2, 1, 0, 3, 2, 1, 1]
    got = sorted((r["start"], r["length"], r["sp"], r["ep"]) for r in matches.maximal_matches(found).filter("query_id = 1").collect())
    assert got == [(0, 5, 16, 16), (4, 4, 6, 7), (7, 3, 4, 4), (9, 3, 2, 3), (13, 3, 10, 11), (16, 1, 12, 13)]
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(1, 30))), i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(30)]
    got = matches.matching_statistics(spark.createDataFrame(rows, df.schema)).collect()
    by_id = {r[0]: r for r in rows}
    for r in got:
        _, q, _, t = by_id[r["query_id"]]
        longest = max(n for n in range(len(q) - r["start"] + 1) if q[r["start"] : r["start"] + n] in t)
        order = sorted(range(len(t) + 1), key=lambda i: t[i:])
        hits = [k for k, i in enumerate(order) if t[i:].startswith(q[r["start"] : r["start"] + longest])]
        assert (r["length"], r["sp"], r["ep"]) == (longest, hits[0], hits[-1])


def test_alignments_are_valid(spark):
    rng = random.Random(4)
    pairs = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 80)))) for i in range(12)]
    pairs = [(i, r, generators.mutate_text(r, 0.1, i)[0]) for i, r in pairs] + [(90, None, "a"), (91, "same", "same")]
    df = spark.createDataFrame(pairs, "pair_id bigint, ref string, seq string").cache()
    by_id = {i: (r, s) for i, r, s in pairs}
    for made in (align.lcs_alignment(df), align.lcs_alignment(df, 1), align.invariant_alignment(df, align.neighbour_matches(align.merged_order(df)))):
        last = {}
        for r in sorted(made.collect(), key=lambda r: (r["pair_id"], r["k"])):
            ref, seq = by_id[r["pair_id"]]
            before = last.get(r["pair_id"], (-1, -1))
            assert ref[r["ref_pos"]] == seq[r["seq_pos"]] and before[0] < r["ref_pos"] and before[1] < r["seq_pos"]
            last[r["pair_id"]] = (r["ref_pos"], r["seq_pos"])
    ref, seq = (index.suffix_table(df.select("pair_id", F.col(c).alias("text")), ["ch"], id_col="pair_id") for c in ("ref", "seq"))
    blocks = align.block_alignment(df, block=4, depth=6)
    rebuilt = align.rebuild_bwt(ref, align.complement(seq, blocks, "seq"), blocks)
    assert matches.differing(rebuilt, seq).count() == 0


def test_ranges(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, 1, 2, 1, 4])] + [("b", 0, 7), (None, 0, 1), ("c", 0, None)], "g string, r bigint, v bigint")
    got = {(r["g"], r["r"]): (r["psv"], r["psev"], r["nsv"], r["nsev"]) for r in ranges.smaller_values(rows, "g", "r", "v").collect()}
    assert got == {("a", 0): (None, None, 1, 1), ("a", 1): (None, None, None, 3), ("a", 2): (1, 1, 3, 3), ("a", 3): (None, 1, None, None), ("a", 4): (3, 3, None, None), ("b", 0): (None,) * 4}
    asked = spark.createDataFrame([("a", 0, 4), ("a", 2, 4), ("a", 3, 1), ("a", 2, 9), ("z", 0, 0)], "g string, sp bigint, ep bigint")
    found = {(r["g"], r["sp"], r["ep"]): (r["pos"], r["v"]) for r in ranges.range_minimum(rows.filter("v is not null"), asked, "g", "r", "v").collect() if r["sp"] is not None}
    assert found == {("a", 0, 4): (1, 1), ("a", 2, 4): (3, 1), ("a", 3, 1): (None, None), ("a", 2, 9): (None, None), ("z", 0, 0): (None, None)}
    spans = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 10, 11), ("a", 11, 12), ("a", 4, 4)], "g string, lo bigint, hi bigint")
    assert ranges.coverage(spans, "g", "lo", "hi").first()[1:] == (4, 12, 10, 2)


def test_copies_decode(spark):
    rng = random.Random(6)
    source = [(p, i, rng.randint(0, 4)) for p in range(5) for i in range(60)]
    target = [(p, i, v if rng.random() < 0.9 else rng.randint(0, 9)) for p, i, v in source]
    a, b = (spark.createDataFrame(x, "pair_id bigint, rank bigint, value bigint") for x in (target, source))
    phrases = relative.copy_phrases(a, b, most=16).cache()
    assert matches.differing(relative.decode_phrases(phrases, b), a).count() == 0
    assert relative.phrase_statistics(phrases).agg(F.sum("values")).first()[0] == 300
    assert {r["phrase_id"] for r in relative.phrase_of(phrases, a.filter("rank = 0")).collect()} == {0}


def test_sources(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one\nacgNN\nNNt\n>two\nGG\n")
    (tmp_path / "p.txt").write_text("ab\n\ncd\n")
    t = readers.read_texts(spark, str(tmp_path / "x.fa"))
    row = readers.fasta(readers.lines_of(t), collapse_n=True).first()
    assert (row["sequences"], row["text"]) == (2, "ACGNTGG")
    assert sorted(r[0] for r in readers.read_patterns(spark, str(tmp_path / "p.txt")).collect()) == ["ab", "cd"]
    assert readers.read_patterns(spark, str(tmp_path / "p.txt"), skip_empty=False).count() == 4
    assert readers.read_bytes(spark, str(tmp_path / "p.txt")).first()["text"] == "ab\n\ncd\n"
    lines = readers.lines_of(spark.createDataFrame([(1, "xa\nyb\nz\nw7\nqc")], "text_id bigint, text string"))
    assert readers.column(lines, 1).first()["text"] == "ab"
    logs = spark.createDataFrame([("f", 0, "Part A:  12.5 MB (1.25 bpc)"), ("f", 1, "noise"), ("f", 2, "Build: 3.5 seconds")], "file string, line_no int, value string")
    assert sorted(tuple(r) for r in readers.log_sizes(logs).collect()) == [("f", "Build", None, None, 3.5), ("f", "Part A", 12.5, 1.25, None)]
    kept = readers.build_or_load(spark, str(tmp_path / "idx"), lambda: index.suffix_table(spark.createDataFrame([(1, "ab")], "text_id bigint, text string")))
    assert kept.count() == 3 and readers.build_or_load(spark, str(tmp_path / "idx"), lambda: 1 / 0).count() == 3


def test_mutation_rates():
    text, done = generators.mutate_text("ACGT" * 50000, 0.01, 7)
    total = done["substitutions"] + done["insertions"] + done["deletions"]
    assert abs(total - 2000) < 250 and abs(done["insertions"] / total - 0.05) < 0.02 and abs(done["deletions"] / total - 0.05) < 0.02
    assert len(text) == 200000 + done["inserted"] - done["deleted"]
    assert generators.mutate_text("NNNN" * 100, 1.0, 1)[1]["substitutions"] == 0


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "onononx"), (2, "z")], "text_id bigint, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("text_id bigint, text string").parquet(str(tmp_path / "in"))
    query = streams.stream_counts(source, ["onon"]).writeStream.format("memory").queryName("hits").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["text_id"], r["cnt"]) for r in spark.sql("SELECT * FROM hits").collect()} == {(1, 2), (2, 0)}


def test_core_queries_over_whole_documents(spark, tmp_path):
    from stringloom.queries import REGISTRY

    rng = random.Random(3)
    texts = {0: "banana", 1: "mississippi", 2: "é" * 40 + "a", 3: "".join(rng.choice("abc ") for _ in range(700)), 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "x")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: REGISTRY.queries[name](spark, str(tmp_path)).collect()
    order = {i: sorted(range(len(t) + 1), key=lambda k: t[k:]) for i, t in texts.items() if t is not None}
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert sorted((r["text_id"], r["rank"], r["pos"]) for r in run("documents_suffix_array")) == [(i, k, p) for i, own in order.items() for k, p in enumerate(own)]
    assert sorted((r["text_id"], r["rank"], r["ch"]) for r in run("documents_bwt")) == [(i, k, texts[i][p - 1] if p else "") for i, own in order.items() for k, p in enumerate(own)]
    lcp = [(i, k, common(texts[i][own[k - 1] :], texts[i][p:]) if k else 0) for i, own in order.items() for k, p in enumerate(own)]
    assert sorted((r["text_id"], r["rank"], r["lcp"]) for r in run("documents_lcp_array")) == lcp
    found = {(r["text_id"], r["pattern"]): r["cnt"] for r in run("documents_pattern_range")}
    assert all(n == sum(texts[i].startswith(p, k) for k in range(len(texts[i]) + 1)) for (i, p), n in found.items())
    assert {i for i, _ in found} == set(order)


@pytest.mark.parametrize("part_chars,share_chars", [(matches.PART_CHARS, matches.SHARE_CHARS), (4, 9)])
def test_all_queries_against_all_texts(spark, texts, part_chars, share_chars):
    queries = {10: "anana", 11: "issx né 漢", 12: "", 13: None, 14: "banana", 15: "zz", 16: "anana"}
    asked = spark.createDataFrame(list(queries.items()), "query_id int, query string")
    expected = []
    for q, query in queries.items():
        for t, text in TEXTS.items():
            if not query or text is None:
                continue
            before = 0
            for start in range(len(query)):
                length = max(k for k in range(len(query) - start + 1) if query[start : start + k] in text)
                if length > 0 and length >= before:
                    expected.append((q, t, start, length, len(query)))
                before = length
    found = matches.against_all(texts, asked, part_chars, share_chars)
    got = sorted(tuple(r) for r in found.select("query_id", "text_id", "start", "length", "chars").collect())
    assert got == sorted(expected)
    whole = {r["query_id"]: (r["whole"], r["longest"]) for r in matches.passage_summary(found).collect()}
    assert whole[14] == (1, 6) and whole[10] == (1, 5) and 15 not in whole
    assert matches.against_all(texts, asked.limit(0)).count() == 0 and matches.against_all(texts.limit(0), asked).count() == 0


def test_pairs_of_documents_without_faults(spark, tmp_path):
    """Gaps in ids, null, empty and repeated texts through the queries on neighbouring documents."""
    import __spark_entry__ as entry

    rows = [(1, "banana bandana"), (4, "bandana banana"), (9, None), (11, ""), (30, "a banana"), (31, "a banana")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    known = entry.queries()
    for name, pairs in (("block_alignment_faults", {1, 11, 30}), ("run_alignment_faults", {1, 11, 30}), ("rlz_faults", {1, 11, 30})):
        got = {r["pair_id"]: r["faults"] for r in known[f"documents_{name}"](spark, str(tmp_path)).collect()}
        assert got == {p: 0 for p in pairs}
