"""Queries over all documents keep the rows of suffixes and nodes in the tasks that make them, with the same results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringloom import queries
from stringloom.operators import align, index, kernels, matches, navigate, ranges, relative, saved, search, tree

TEXTS = {1: "banana bandana", 2: "mississippi", 3: "", 4: "a", 5: "aaaaaaaaaaaa", 6: "naïve né 漢漢 the 𝄞 then the", 7: None, 8: "the hat on the onion, onon e", 9: "the hat in the onion, onon e", 10: "the hat in the onion, onon e"}
NARROW = ["documents_alignment_partitions", "documents_tree_find", "documents_tree_traversal_digest", "documents_block_alignment", "documents_block_alignment_faults", "documents_run_alignment_faults", "documents_left_right_matches", "documents_psi_k", "documents_rlz_faults", "documents_rlz_phrases", "documents_matching_statistics", "documents_lcp_intervals", "documents_lcp_diff_encoded", "documents_mutual_suffix_order", "documents_lcp_diff_decoded", "documents_partition_statistics", "documents_bwt_rank_at", "documents_run_alignment", "documents_inverse_positions", "documents_maximal_matches", "documents_tree_node_count", "documents_tree_counts", "documents_locate_ranks", "documents_saved_order_faults", "documents_backward_step", "documents_lcp_slice", "documents_extract_bwt"]
TO_SUMS = ["documents_passage_matches", "documents_maximal_summary", "documents_saved_passages", "documents_find", "documents_pattern_checked"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(1, "the onion"), (2, "banana"), (3, None)], "item_id bigint, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


@pytest.fixture(scope="module")
def texts(spark, tables):
    return queries.documents(spark, tables).cache()


@pytest.fixture(scope="module")
def pairs(spark, tables):
    return queries.document_pairs(spark, tables).cache()


def same(a, b):
    assert a.columns == b.columns and [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
    rows = lambda df: sorted(map(repr, df.collect()))
    return rows(a) == rows(b)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NARROW)
def test_no_row_of_a_suffix_is_sent(spark, tables, name):
    """Above the step that sorts suffixes there is no shuffle, join or window."""
    above = plan_of(queries.REGISTRY.queries[name](spark, tables)).split("MapInArrow")[0]
    assert not any(x in above for x in ("Exchange", "Window", "Join", "CoGroup", "Sort"))


@pytest.mark.parametrize("name", TO_SUMS)
def test_only_sums_are_sent(spark, tables, name):
    plan = plan_of(queries.REGISTRY.queries[name](spark, tables))
    above = plan.split("FlatMapCoGroupsInArrow" if "FlatMapCoGroupsInArrow" in plan else "MapInArrow")[0]
    assert not any(x in above for x in ("Window", "Join", "Generate")) and above.count("Exchange") <= 1
    assert any(x in above for x in ("_total", "found", "hits", "longest#"))


def test_pairs_come_in_shares_of_a_known_size(spark, tables, monkeypatch):
    monkeypatch.setattr(queries, "SHARE_CHARS", 5)
    total = sum(len(t) for t in TEXTS.values() if t is not None)
    made = queries.document_pairs(spark, tables)
    assert made.rdd.getNumPartitions() == -(-total // 5)
    assert sorted((r["pair_id"], r["ref"], r["seq"]) for r in made.collect()) == [(i, TEXTS[i], TEXTS[i + 1]) for i in (1, 2, 3, 4, 5, 8, 9)]


def _random_pairs(seed):
    rng = random.Random(seed)
    some = lambda: "".join(rng.choice(["ab", "abcd "][seed % 2]) for _ in range(rng.choice([0, 1, 5, 60])))
    made = [(some(), some()) for _ in range(6)]
    return made + [(x, x[: len(x) // 2] + "ab" + x[len(x) // 2 :]) for x, _ in made[:2]]


@pytest.mark.parametrize("block,depth", [(1, 4), (8, 8), (1, 6)])
def test_blocks_by_depth_for_all_pairs_at_once(block, depth):
    for seed in range(6):
        made = _random_pairs(seed)
        refs, seqs = ([kernels.codes(x) for x in side] for side in zip(*made))
        of, ref_base, seq_base, ref, ref_size, seq, seq_size = (x.tolist() for x in align._shared(kernels.joint_order(refs, seqs), block, depth))
        got = {k: [] for k in range(len(made))}
        for k, *row in zip(of, ref, ref_base, ref_size, seq, seq_base, seq_size):
            got[k].append((row[0] - row[1], row[2], row[3] - row[4], row[5]))
        for k, texts_ in enumerate(made):
            sides = [sorted(t[i:] + "\0" for i in range(len(t) + 1)) for t in texts_]
            stack, expected = [""], []
            while stack:
                prefix = stack.pop()
                hit = [[i for i, s in enumerate(own) if s.startswith(prefix)] for own in sides]
                d = len(prefix)
                if not hit[0] or not hit[1]:
                    continue
                if prefix.endswith("\0") or d >= depth or (d >= align.SEED and min(map(len, hit)) <= block):
                    expected.append((hit[0][0], len(hit[0]), hit[1][0], len(hit[1])))
                else:
                    stack += [prefix + c for c in {s[d] for i in hit[0] for s in [sides[0][i]]}]
            assert got[k] == sorted(expected)


def test_forward_search_without_nodes(texts):
    wanted = ["the", "an", "onon", "e", "", "zzqx", "h t", "漢漢", "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "the hat in the onion, onon e", "n𝄞", "a\0"]
    assert same(tree.find_of(texts, wanted), saved.forward_find(tree.tree_nodes(texts), texts, wanted))


def test_digest_in_whole_array_steps(texts):
    assert same(tree.digest_of(texts), tree.traversal_digest(tree.tree_nodes(texts)))
    rng = random.Random(1)
    for top in (2, 256, 70000, 1 << 40):
        values = [rng.randrange(top) for _ in range(40)]
        assert kernels.fnv1a_array(np.array(values)) == kernels.fnv1a(values)
    assert kernels.fnv1a_array(np.array([1])) == 9929646806074584996 and kernels.fnv1a_array(np.array([], np.int64)) == kernels.FNV_OFFSET


@pytest.mark.parametrize("most_edits", [8192, 6])
def test_blocks_through_tables_are_those_of_the_rounds(most_edits):
    rng = random.Random(most_edits)
    sizes = np.array([[rng.choice([1, 2, 3, 8, 30]), rng.choice([1, 2, 8, 40])] for _ in range(60)])
    a, b = (np.array([rng.randrange(3) for _ in range(int(sizes[:, i].sum()))]) for i in (0, 1))
    starts = np.cumsum(sizes, axis=0) - sizes
    of, i, j = kernels.block_subsequences(a, b, starts[:, 0], sizes[:, 0], starts[:, 1], sizes[:, 1], most_edits)
    expected = []
    for k, ((n, m), (p, q)) in enumerate(zip(sizes.tolist(), starts.tolist())):
        x, y = a[p : p + n].tolist(), b[q : q + m].tolist()
        found = kernels.common_subsequence(x, y, most_edits)
        expected += [(k, *z) for z in (kernels.commonest_match(x, y) if found is None else found)]
    assert list(zip(of.tolist(), i.tolist(), j.tolist())) == expected


def test_faults_of_wrong_alignments(pairs):
    def worse(refs, seqs):
        of, number, ref, seq = align.block_rows(refs, seqs, 8, 8, 8192)
        return of, number, ref, seq + 1000 * (seq > 0)

    right = align.faults_of(pairs, lambda refs, seqs: align.block_rows(refs, seqs, 8, 8, 8192))
    assert {r["faults"] for r in right.collect()} == {0} and right.count() == pairs.count()
    assert sum(r["faults"] for r in align.faults_of(pairs, worse).collect()) > 0
    aligned = align.block_alignment(pairs, 8, 8)
    assert same(right.filter("aligned > 0"), align.alignment_faults(aligned, *queries._pair_indexes(pairs)))


def test_neighbour_runs(pairs):
    assert same(align.neighbour_runs(pairs), align.neighbour_matches(align.merged_order(pairs)))


@pytest.mark.parametrize("part_chars,share_chars", [(matches.PART_CHARS, matches.SHARE_CHARS), (4, 9)])
def test_sums_of_all_queries_against_all_texts(spark, texts, part_chars, share_chars):
    asked = spark.createDataFrame([(1, "the onion"), (2, "banana"), (3, None), (4, "zz"), (5, "hat"), (6, "")], "query_id int, query string")
    found = matches.passage_sums(texts, asked, part_chars, share_chars)
    assert same(found, matches.passage_summary(matches.against_all(texts, asked)))
    assert {r["query_id"]: r["whole"] for r in found.collect()} == {1: 3, 2: 1, 5: 3}


@pytest.mark.parametrize("k", [0, 5])
def test_psi_steps_of_texts(texts, k):
    assert same(navigate.psi_steps_of(texts, k), navigate.psi_steps(index.suffix_table(texts, ["pos"]), k))


@pytest.mark.parametrize("most", [1024, 3])
def test_phrases_of_pairs(pairs, most):
    sides = [index.suffix_table(pairs.select("pair_id", F.col(c).alias("text")), ["lcp"], id_col="pair_id").select("pair_id", "rank", F.col("lcp").cast("bigint").alias("value")) for c in ("seq", "ref")]
    phrases = relative.phrases_of(pairs, most)
    assert same(phrases, relative.copy_phrases(*sides, most=most))
    assert matches.differing(relative.decode_phrases(phrases, sides[1]), sides[0]).count() == 0
    got = {r["pair_id"]: (r["places"], r["faults"]) for r in relative.phrase_faults(pairs, most).collect()}
    assert got == {r["pair_id"]: (len(r["seq"]) + 1, 0) for r in pairs.collect()}
    assert relative._decoded(np.array([2, 0]), np.array([1, -1]), [5, 7], np.array([9, 1, 2])).tolist() == [1, 3, 8, 15]


def test_sums_of_maximal_matches(spark, tables):
    pairs = queries._match_pairs(spark, tables, queries.documents)
    assert same(matches.maximal_sums(pairs), matches.match_summary(matches.maximal_matches(matches.matching_statistics(pairs))))


def test_intervals_without_nodes(texts):
    assert same(tree.intervals_of(texts), tree.intervals(tree.tree_nodes(texts)))


def test_packed_entries_take_few_bytes(spark, texts):
    packed = {r["text_id"]: r for r in saved.pack(texts).collect()}
    sizes = {i: (len(r["symbols"]) // r["n"], len(r["sa"]) // r["n"]) for i, r in packed.items()}
    assert sizes[1] == (1, 2) and sizes[6] == (4, 2) and saved.symbol_width(kernels.codes("漢") + 1) == 2
    wanted = ["the", "", "漢", "né", "zz", "𝄞", "ÿ", "h t"]
    found = saved.find(saved.pack(texts), wanted)
    assert same(found.select("text_id", "pattern", "sp", "ep", "cnt"), search.find(texts, wanted))
    assert same(saved.summary(saved.pack(texts), wanted), search.summary(search.find(texts, wanted)))
    assert same(search.summary_of(texts, wanted), search.summary(search.find(texts, wanted)))
    long = spark.createDataFrame([(1, "ab" * 40000)], "text_id bigint, text string")
    assert len(saved.pack(long).first()["sa"]) == 4 * 80001 and saved.find(saved.pack(long), ["bab"]).first()["cnt"] == 39999


def test_codes_of_common_prefixes(texts):
    column = index.suffix_table(texts, ["lcp"])
    assert same(ranges.lcp_codes(texts), ranges.differences(column))
    assert same(ranges.lcp_codes(texts, decoded=True), ranges.from_differences(ranges.differences(column)))


def test_sums_of_partitions(pairs):
    sizes = pairs.select("pair_id", (F.char_length("ref") + 1).alias("ref_size"), (F.char_length("seq") + 1).alias("seq_size"))
    assert same(align.partition_sums(pairs, 1, 4), align.partition_statistics(align.partitions(pairs, 1, 4), sizes))


def test_asked_places_of_texts(texts):
    probes = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(c).alias("ch")) for i in (0, 3, 100) for c in ("e", "", "漢")])
    flat = texts.filter("text IS NOT NULL").select("text_id", F.explode(probes).alias("a")).select("text_id", "a.i", "a.ch")
    assert same(navigate.rank_at_of(texts.withColumn("asked", probes)), navigate.rank_at(index.suffix_table(texts, ["ch"]), flat).select("text_id", "i", "ch", "occurrences"))


def test_asked_positions_of_texts(texts):
    wanted = F.array(*[F.lit(x).cast("bigint") for x in (0, 2, 100000, -1)])
    asked = texts.select("text_id", F.explode(wanted).alias("pos"))
    assert same(navigate.inverse_of(texts.withColumn("asked", wanted)), navigate.inverse(index.suffix_table(texts, ["pos"]), asked))


def test_counts_without_nodes(texts):
    assert same(tree.counts_of(texts), tree.counts(tree.tree_nodes(texts)))


def test_places_are_checked_where_they_are_found(texts):
    wanted = ["the", "an", "", "zzqx", "漢", "aa"]
    assert same(search.checked_of(texts, wanted), search.checked(texts, search.locate(texts, wanted)))


def test_asked_ranks_of_texts(texts):
    wanted = F.array(*[F.lit(x).cast("bigint") for x in (0, 2, 100000, -1)])
    asked = texts.select("text_id", F.explode(wanted).alias("rank"))
    assert same(navigate.locate_of(texts.withColumn("asked", wanted)), navigate.locate(index.suffix_table(texts, ["pos"]), asked))


def test_order_faults_where_ranges_are_found(texts):
    own, wanted = saved.pack(texts).cache(), ["the", "an", "", "zzqx", "漢", "𝄞", "aa"]
    assert same(saved.find_faults(own, wanted), saved.order_faults(own, saved.find(own, wanted)))
    assert {r["faults"] for r in saved.find_faults(own, wanted).collect()} == {0}
    row = own.filter("text_id = 1").first()
    tested = lambda p, sp, ep: saved._range_faults(row["n"], row["symbols"], saved.places_of(row["sa"], row["n"]), kernels.codes(p) + 1, sp, ep)
    assert tested("an", 1, 0) == 1 and tested("b", 1, 2) > 0 and tested("漢", 1, 0) == 0 and tested("漢", 1, 1) == 1


def test_backward_step_of_texts(texts):
    table = index.suffix_table(texts, ["ch", "first_ch"])
    asked = navigate.char_ranges(table).filter("ch = 'e'").select("text_id", "sp", "ep", F.explode(F.array(F.lit("h"), F.lit("Q"))).alias("ch"))
    assert same(navigate.backward_step_of(texts, "e", ["h", "Q"]), navigate.backward_step(table, index.alphabet(texts), asked))


@pytest.mark.parametrize("low,high", [(5, 25), (0, 3), (7, 7)])
def test_slices_of_texts(texts, low, high):
    table = index.suffix_table(texts, ["lcp", "ch"])
    assert same(ranges.lcp_slice_of(texts, low, high), ranges.value_slice(table, low, high))
    assert same(navigate.extract_bwt_of(texts, low, high), navigate.extract_bwt(table, low, high))
