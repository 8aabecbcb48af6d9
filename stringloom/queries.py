"""Registered queries of the text-order engine, each over whole tables and whole texts.

Index queries take ``benchmark`` as the text collection, whose suffix orders DuckDB can build from suffix strings.
The same operators over all ``documents`` stand beside them as ``documents_*`` without SQL, as suffix strings of long texts are quadratic.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from stringloom.functions import scalars
from stringloom.operators import align, index, matches, navigate, ranges, relative, saved, search, tree
from stringloom.plans import strategies
from stringloom.registry import Registry, table
from stringloom.places import positions
from stringloom.session import cut, shared_dir
from stringloom.sources import generators, readers

REGISTRY = Registry()

SHARE_CHARS = 4 << 20  # of the texts in a share of pairs
PATTERNS = ["the", "an", "onon", "e", "", "zzqx", "h t"]

# ---- parts of the comparison SQL -------------------------------------------------------------------------------

D = "d AS (SELECT item_id AS text_id, text AS t FROM benchmark WHERE text IS NOT NULL)"
X = f"""{D}, x0 AS (SELECT text_id, t, unnest(range(0, length(t) + 1)) AS pos FROM d),
x AS (SELECT text_id, t, pos, substring(t, pos + 1) AS suf, CASE WHEN pos = 0 THEN '' ELSE substring(t, pos, 1) END AS ch FROM x0),
sa AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY suf) - 1 AS rank, length(t) + 1 AS n FROM x)"""
L = f"""{X}, l0 AS (SELECT *, lag(suf) OVER (PARTITION BY text_id ORDER BY rank) AS prev FROM sa),
l AS (SELECT text_id, t, n, pos, rank, ch, suf, CAST(coalesce(list_max(list_filter(range(1, least(length(suf), length(prev)) + 1),
  lambda k: substring(suf, 1, k) = substring(prev, 1, k))), 0) AS INTEGER) AS lcp FROM l0)"""
IV = f"""{L}, nb AS (SELECT a.text_id, a.rank, a.lcp, a.n, max(CASE WHEN b.rank < a.rank THEN b.rank END) AS psv, min(CASE WHEN b.rank > a.rank THEN b.rank END) AS nsv
  FROM l a LEFT JOIN l b ON a.text_id = b.text_id AND b.lcp < a.lcp GROUP BY ALL),
iv AS (SELECT DISTINCT text_id, CAST(coalesce(psv, 0) AS BIGINT) AS sp, CAST(coalesce(nsv, n) - 1 AS BIGINT) AS ep, CAST(lcp AS BIGINT) AS depth FROM nb WHERE rank > 0),
nodes AS (SELECT *, false AS leaf FROM iv UNION ALL SELECT text_id, rank, rank, n - 1 - pos, true FROM l),
pa0 AS (SELECT c.text_id, c.sp, c.ep, c.depth, c.leaf, p.sp AS psp, p.ep AS pep, p.depth AS pdepth,
  row_number() OVER (PARTITION BY c.text_id, c.sp, c.ep ORDER BY p.depth DESC) AS k
  FROM nodes c JOIN iv p ON c.text_id = p.text_id AND p.sp <= c.sp AND c.ep <= p.ep AND (p.sp < c.sp OR c.ep < p.ep)),
pa AS (SELECT * FROM pa0 WHERE k = 1)"""
# Each text with the next one: pairs for the operators on two texts.
PAIRS = "pr AS (SELECT * FROM (SELECT item_id AS pair_id, text AS ref, lead(text) OVER (ORDER BY item_id) AS seq, lead(item_id) OVER (ORDER BY item_id) AS next_id FROM benchmark) WHERE seq IS NOT NULL AND ref IS NOT NULL)"


def texts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), "text")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")


def _neighbours(rows):
    """(pair_id, ref, seq) of each text with the next one by id, whatever gaps the ids have: places by counting, then an
    equi-join on them. Only (id, place) rows are ordered; texts stay out of it."""
    spark = rows.sparkSession
    ids = rows.select("text_id").filter(F.col("text_id").isNotNull()).distinct()
    placed = positions(cut(ids.withColumn("_all", F.lit(1))), "_all", [F.col("text_id")]).select("text_id", "position")
    after = placed.select(F.col("text_id").alias("next_id"), (F.col("position") - 1).alias("position"))
    links = placed.join(after, "position").select("text_id", "next_id")
    seq = rows.select(F.col("text_id").alias("next_id"), F.col("text").alias("seq"))
    # What follows works on whole pairs, much longer than it takes to read them: shares of a known size, not those of a join.
    shares = max(spark.sparkContext.defaultParallelism, -(-(rows.agg(F.sum(F.char_length("text"))).first()[0] or 0) // SHARE_CHARS))
    joined = rows.join(links, "text_id").repartition(shares, "next_id").join(seq.repartition(shares, "next_id"), "next_id")
    return joined.select(F.col("text_id").alias("pair_id"), F.col("text").alias("ref"), "seq", "next_id").filter("ref IS NOT NULL AND seq IS NOT NULL")


def text_pairs(spark, sf_dir):
    return _neighbours(texts(spark, sf_dir)).drop("next_id")


def document_pairs(spark, sf_dir):
    return _neighbours(documents(spark, sf_dir)).drop("next_id")


def saved_index(spark, sf_dir, texts):
    """The packed index of a collection, built once for a session and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, texts.__name__)
    if key not in _SAVED:
        path = f"{shared_dir(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
        saved.save(texts(spark, sf_dir), path)
        _SAVED[key] = path
    return saved.load(spark, _SAVED[key])


_SAVED: dict[tuple, str] = {}


def add(name, sql=None):
    return REGISTRY.add(name, sql)


# ---- search ----------------------------------------------------------------------------------------------------


@add(
    "pattern_count",
    """
    WITH h AS (
      SELECT 'onon' AS pattern, list_sum(list_transform(regexp_extract_all(text, 'on(?:on)+'), lambda x: length(x) // 2 - 1)) AS n FROM documents
      UNION ALL SELECT 'the', len(regexp_extract_all(text, 'the')) FROM documents
      UNION ALL SELECT 'ss', list_sum(list_transform(regexp_extract_all(text, 's+'), lambda x: length(x) - 1)) FROM documents
      UNION ALL SELECT 'e e', list_sum(list_transform(regexp_extract_all(text, 'e(?: e)+'), lambda x: length(x) // 2)) FROM documents)
    SELECT pattern, CAST(count_if(n > 0) AS BIGINT) AS found, CAST(coalesce(sum(n), 0) AS BIGINT) AS matches, CAST(length(pattern) AS BIGINT) AS chars FROM h GROUP BY pattern
    """,
)
def pattern_count(spark, sf_dir):
    return search.summary(search.count_scan(documents(spark, sf_dir), ["onon", "the", "ss", "e e"]))


_P = "p AS (SELECT unnest(['the', 'an', 'onon', 'e', '', 'zzqx', 'h t']) AS pattern)"
_FIND = f"""{X}, {_P}, f AS (SELECT text_id, pattern, min(CASE WHEN starts_with(suf, pattern) THEN rank END) AS lo, CAST(count_if(starts_with(suf, pattern)) AS BIGINT) AS cnt
  FROM sa, p GROUP BY text_id, pattern), fr AS (SELECT text_id, pattern, CAST(coalesce(lo, 1) AS BIGINT) AS sp, CAST(coalesce(lo + cnt - 1, 0) AS BIGINT) AS ep, cnt FROM f)"""


@add("pattern_range", f"WITH {_FIND} SELECT * FROM fr")
def pattern_range(spark, sf_dir, texts=texts):
    return search.find(texts(spark, sf_dir), PATTERNS)


@add("pattern_multi_summary", f"WITH {_FIND} SELECT pattern, CAST(count_if(cnt > 0) AS BIGINT) AS found, CAST(sum(cnt) AS BIGINT) AS matches, CAST(length(pattern) AS BIGINT) AS chars FROM fr GROUP BY pattern")
def pattern_multi_summary(spark, sf_dir, texts=texts):
    return search.summary_of(texts(spark, sf_dir), PATTERNS)


@add("pattern_locate", f"WITH {X}, {_P} SELECT text_id, pattern, rank, pos FROM sa, p WHERE starts_with(suf, pattern)")
def pattern_locate(spark, sf_dir, texts=texts):
    return search.locate(texts(spark, sf_dir), PATTERNS)


@add("pattern_strategy", f"WITH {_FIND} SELECT text_id, pattern, cnt FROM fr")
def pattern_strategy(spark, sf_dir, texts=texts):
    asked = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return strategies.pattern_counts(texts(spark, sf_dir), asked)


@add("pattern_checked", f"WITH {_FIND} SELECT pattern, CAST(sum(cnt) AS BIGINT) AS hits, CAST(0 AS BIGINT) AS faults FROM fr GROUP BY pattern HAVING sum(cnt) > 0")
def pattern_checked(spark, sf_dir, texts=texts):
    t = texts(spark, sf_dir)
    return search.checked_of(t, PATTERNS)


@add("saved_find", f"WITH {_FIND} SELECT * FROM fr")
def saved_find(spark, sf_dir, texts=texts):
    return saved.find(saved_index(spark, sf_dir, texts), PATTERNS)


@add("saved_locate", f"WITH {X}, {_P} SELECT text_id, pattern, rank, pos FROM sa, p WHERE starts_with(suf, pattern)")
def saved_locate(spark, sf_dir, texts=texts):
    return saved.locate(saved_index(spark, sf_dir, texts), PATTERNS)


@add("saved_order_faults", f"WITH {_FIND} SELECT text_id, pattern, cnt, CAST(0 AS BIGINT) AS faults FROM fr")
def saved_order_faults(spark, sf_dir, texts=texts):
    return saved.find_faults(saved_index(spark, sf_dir, texts), PATTERNS)


@add("saved_find_all", f"""WITH {X}, p AS (SELECT DISTINCT substring(text, 1, 3) AS pattern FROM documents WHERE text IS NOT NULL),
  f AS (SELECT text_id, pattern, min(rank) AS sp, max(rank) AS ep, CAST(count(*) AS BIGINT) AS cnt FROM sa, p WHERE starts_with(suf, pattern) GROUP BY text_id, pattern) SELECT * FROM f""")
def saved_find_all(spark, sf_dir):
    """A table of patterns, the beginnings of all documents, in all texts of a saved index, in small parts and shares."""
    starts = documents(spark, sf_dir).select(F.substring("text", 1, 3).alias("pattern"))
    return saved.find_all(saved_index(spark, sf_dir, texts), starts, part_chars=500, share_bytes=1 << 16)


@add("tree_find", f"WITH {_FIND} SELECT text_id, pattern, sp, ep FROM fr WHERE cnt > 0")
def tree_find(spark, sf_dir, texts=texts):
    return tree.find_of(texts(spark, sf_dir), PATTERNS)


@add("tree_forward_step", f"WITH {X}, p AS (SELECT unnest(['e', 'th']) AS pattern), r AS (SELECT text_id, max(rank) AS n FROM sa GROUP BY text_id), g AS (SELECT sa.text_id, pattern, min(rank) AS sp, max(rank) AS ep, count(*) AS cnt, list(suf) AS sufs FROM sa, p WHERE starts_with(suf, substring(pattern, 1, 1)) GROUP BY ALL), w AS (SELECT *, CAST(CASE WHEN length(pattern) = 1 OR len(list_filter(sufs, lambda x: starts_with(x, pattern))) = cnt THEN length(pattern) ELSE 1 END AS BIGINT) AS matched FROM g) SELECT text_id, pattern, sp, ep, matched FROM w WHERE matched = length(pattern) OR len(list_distinct(list_transform(sufs, lambda x: substring(x, 2, 1)))) > 1 OR len(list_filter(sufs, lambda x: length(x) = 1)) > 0")
def tree_forward_step(spark, sf_dir, texts=texts):
    """One step from the root: to the node below the first character, as far as the pattern goes along its edge."""
    t = texts(spark, sf_dir)
    nodes = cut(tree.tree_nodes(t))
    root = nodes.filter("child_no IS NULL").select("text_id", F.explode(F.array(F.lit("e"), F.lit("th"))).alias("pattern"), "sp", "ep", F.lit(0).cast("bigint").alias("matched"))
    return saved.forward_step(root, nodes, t)


@add("pattern_place_digest")
def pattern_place_digest(spark, sf_dir):
    return search.place_digest(search.locate(documents(spark, sf_dir), ["onon", "ing the"]))


_PASSAGES = """WITH p AS (SELECT DISTINCT text AS pattern FROM benchmark WHERE text IS NOT NULL), t AS (SELECT text AS t FROM documents WHERE text IS NOT NULL),
  h AS (SELECT pattern, (length(t) - length(replace(t, pattern, ''))) // length(pattern) AS cnt FROM t, p)
  SELECT pattern, CAST(count_if(cnt > 0) AS BIGINT) AS found, CAST(sum(cnt) AS BIGINT) AS matches, CAST(length(pattern) AS BIGINT) AS chars FROM h GROUP BY pattern"""


def _passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("text").alias("pattern"))


@add("documents_find", _PASSAGES)
def documents_find(spark, sf_dir):
    return search.summary_of(documents(spark, sf_dir), search.collect_patterns(_passages(spark, sf_dir)))


@add("documents_saved_passages", _PASSAGES)
def documents_saved_passages(spark, sf_dir):
    """The passages in a saved index of all documents; a second call builds nothing."""
    return saved.summary(saved_index(spark, sf_dir, documents), search.collect_patterns(_passages(spark, sf_dir)))


# ---- construction and navigation -------------------------------------------------------------------------------


@add("suffix_array", f"WITH {X} SELECT text_id, rank, pos FROM sa")
def suffix_array(spark, sf_dir, texts=texts):
    return index.suffix_table(texts(spark, sf_dir), ["pos"])


@add("suffix_array_declarative", f"WITH {X} SELECT text_id, rank, pos, ch FROM sa")
def suffix_array_declarative(spark, sf_dir):
    return index.suffix_table_sql(texts(spark, sf_dir))


@add("inverse_suffix_array", f"WITH {X} SELECT text_id, pos, rank FROM sa")
def inverse_suffix_array(spark, sf_dir, texts=texts):
    return index.suffix_table(texts(spark, sf_dir), ["pos"]).select("text_id", "pos", "rank")


@add("bwt", f"WITH {X} SELECT text_id, rank, ch FROM sa")
def bwt(spark, sf_dir, texts=texts):
    return index.suffix_table(texts(spark, sf_dir), ["ch"])


@add("long_text_suffix_ranks", "WITH t AS (SELECT string_agg(text, '' ORDER BY item_id) AS t FROM benchmark), x AS (SELECT t, unnest(range(0, length(t) + 1)) AS pos FROM t) SELECT pos, row_number() OVER (ORDER BY substring(t, pos + 1)) - 1 AS rank FROM x")
def long_text_suffix_ranks(spark, sf_dir):
    """All texts as one, ordered by joins alone."""
    t = table(spark, sf_dir, "benchmark").select("item_id", "text")
    before = Window.orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.select("item_id", F.char_length("text").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("item_id", "offset")
    chars = t.join(sizes, "item_id").select("offset", F.posexplode(F.filter(F.split("text", ""), lambda x: x != "")).alias("i", "ch"))
    return index.suffix_ranks_of_long_text(chars.select((F.col("offset") + F.col("i")).cast("bigint").alias("pos"), "ch"))


_ALPHABET = """a0 AS (SELECT text_id, unnest(string_split(t, '')) AS ch FROM d WHERE t <> ''), a1 AS (SELECT text_id, ch, count(*) AS cnt FROM a0 GROUP BY ALL UNION ALL SELECT text_id, '', 1 FROM d),
al AS (SELECT text_id, ch, row_number() OVER w - 1 AS comp, CAST(cnt AS BIGINT) AS cnt, CAST(coalesce(sum(cnt) OVER (PARTITION BY text_id ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM a1 WINDOW w AS (PARTITION BY text_id ORDER BY ch))"""
_DOCS = "d AS (SELECT doc_id AS text_id, text AS t FROM documents WHERE text IS NOT NULL)"


@add("alphabet_c_array", f"WITH {_DOCS}, {_ALPHABET} SELECT * FROM al")
def alphabet_c_array(spark, sf_dir):
    return index.alphabet(documents(spark, sf_dir))


@add("char_histogram", f"WITH {_DOCS} SELECT ch, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(string_split(t, '')) AS ch FROM d WHERE t <> '') GROUP BY ch")
def char_histogram(spark, sf_dir):
    return index.char_counts(documents(spark, sf_dir)).filter("ch <> ''").groupBy("ch").agg(F.sum("cnt").alias("cnt"))


@add("recode_text", f"WITH {D}, {_ALPHABET} SELECT d.text_id, list(al.comp ORDER BY i.pos) AS comps FROM (SELECT text_id, t, unnest(range(1, length(t) + 1)) AS pos FROM d) i JOIN d ON d.text_id = i.text_id JOIN al ON al.text_id = i.text_id AND al.ch = substring(i.t, i.pos, 1) GROUP BY d.text_id")
def recode_text(spark, sf_dir, texts=texts):
    t = texts(spark, sf_dir)
    return index.recode(t, index.alphabet(t))


@add("reassign_alphabet", f"WITH d AS (SELECT r_regionkey AS text_id, r_name AS t FROM region), {_ALPHABET}, s AS (SELECT *, count(*) OVER (PARTITION BY text_id) = 6 AS valid FROM al) SELECT text_id, valid, ch, CAST(CASE WHEN NOT valid THEN NULL WHEN ch = '' THEN 0 ELSE nullif(position(ch IN 'ACGNT'), 0) END AS BIGINT) AS comp FROM s")
def reassign_alphabet(spark, sf_dir):
    letters = index.alphabet(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("text_id"), F.col("r_name").alias("text")))
    return index.reassign_alphabet(letters, "ACGNT")


@add("sa_samples", f"WITH {X} SELECT text_id, rank, pos FROM sa WHERE rank % 17 = 0")
def sa_samples(spark, sf_dir, texts=texts):
    return index.sample_ranks(index.suffix_table(texts(spark, sf_dir), ["pos"]))


@add("isa_samples", f"WITH {X} SELECT text_id, rank, pos FROM sa WHERE pos % 64 = 0")
def isa_samples(spark, sf_dir, texts=texts):
    return index.sample_positions(index.suffix_table(texts(spark, sf_dir), ["pos"]))


@add("lf_mapping", f"WITH {X} SELECT a.text_id, a.rank, b.rank AS lf FROM sa a JOIN sa b ON a.text_id = b.text_id AND b.pos = (a.pos - 1 + a.n) % a.n")
def lf_mapping(spark, sf_dir, texts=texts):
    return navigate.lf(index.suffix_table(texts(spark, sf_dir), ["lf"]))


@add("psi_mapping", f"WITH {X} SELECT a.text_id, a.rank, b.rank AS psi FROM sa a JOIN sa b ON a.text_id = b.text_id AND b.pos = (a.pos + 1) % a.n")
def psi_mapping(spark, sf_dir, texts=texts):
    return navigate.psi(index.suffix_table(texts(spark, sf_dir), ["psi"]))


@add("psi_k", f"WITH {X} SELECT a.text_id, a.rank, b.rank AS psi_k FROM sa a LEFT JOIN sa b ON a.text_id = b.text_id AND b.pos = a.pos + 5")
def psi_k(spark, sf_dir, texts=texts):
    return navigate.psi_steps_of(texts(spark, sf_dir), 5)


@add("lf_psi_identity", "SELECT doc_id AS text_id, CAST(length(text) + 1 AS BIGINT) AS suffixes, false AS broken FROM documents WHERE text IS NOT NULL")
def lf_psi_identity(spark, sf_dir):
    """Psi undoes LF: the pairs (rank, LF) and (Psi, rank) of a text are the same set. Checksums of both sets, no join."""
    t = index.suffix_table(documents(spark, sf_dir), ["lf", "psi"])
    there, back = F.bit_xor(F.xxhash64("rank", "lf")), F.bit_xor(F.xxhash64("psi", "rank"))
    return t.groupBy("text_id").agg(F.count("*").alias("suffixes"), (there != back).alias("broken"))


@add("bwt_rank", f"WITH {X} SELECT text_id, rank, ch, row_number() OVER (PARTITION BY text_id, ch ORDER BY rank) - 1 AS rank_before FROM sa")
def bwt_rank(spark, sf_dir, texts=texts):
    return navigate.rank_of(index.suffix_table(texts(spark, sf_dir), ["ch", "occ"]))


@add("bwt_rank_window", f"WITH {X} SELECT text_id, rank, ch, row_number() OVER (PARTITION BY text_id, ch ORDER BY rank) - 1 AS rank_before FROM sa")
def bwt_rank_window(spark, sf_dir, texts=texts):
    return navigate.rank_of(index.suffix_table(texts(spark, sf_dir), ["ch"]))


@add("bwt_select", f"WITH {X} SELECT text_id, ch, CAST(3 AS BIGINT) AS k, rank FROM (SELECT *, row_number() OVER (PARTITION BY text_id, ch ORDER BY rank) AS o FROM sa) WHERE o = 3")
def bwt_select(spark, sf_dir, texts=texts):
    return navigate.select_of(index.suffix_table(texts(spark, sf_dir), ["ch", "occ"]), 3)


@add("bwt_rank_at", f"WITH {X}, q AS (SELECT text_id, CAST(i AS BIGINT) AS i, c AS ch FROM d, unnest([10, 100]) a(i), unnest(['e', 'n', 'Q']) b(c)) SELECT q.text_id, q.i, q.ch, CAST(count_if(sa.rank < q.i AND sa.ch = q.ch) AS BIGINT) AS occurrences FROM q JOIN sa ON sa.text_id = q.text_id GROUP BY ALL")
def bwt_rank_at(spark, sf_dir, texts=texts):
    probes = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(c).alias("ch")) for i in (10, 100) for c in ("e", "n", "Q")])
    return navigate.rank_at_of(texts(spark, sf_dir).withColumn("asked", probes))


@add(
    "backward_step",
    f"""WITH {X}, s AS (SELECT text_id, min(rank) AS sp, max(rank) AS ep FROM sa WHERE starts_with(suf, 'e') GROUP BY text_id),
    q AS (SELECT *, unnest(['h', 'Q']) AS ch FROM s),
    w AS (SELECT q.text_id, q.sp, q.ep, q.ch, min(CASE WHEN starts_with(suf, q.ch || 'e') THEN rank END) AS lo, max(CASE WHEN starts_with(suf, q.ch || 'e') THEN rank END) AS hi FROM q JOIN sa ON sa.text_id = q.text_id GROUP BY ALL)
    SELECT text_id, sp, ep, ch, CAST(coalesce(lo, 1) AS BIGINT) AS new_sp, CAST(coalesce(hi, 0) AS BIGINT) AS new_ep FROM w""",
)
def backward_step(spark, sf_dir, texts=texts):
    return navigate.backward_step_of(texts(spark, sf_dir), "e", ["h", "Q"])


@add("locate_ranks", f"WITH {X}, q AS (SELECT text_id, CAST(r AS BIGINT) AS rank FROM d, unnest([0, 7, 100000]) g(r)) SELECT q.text_id, q.rank, sa.pos FROM q LEFT JOIN sa USING (text_id, rank)")
def locate_ranks(spark, sf_dir, texts=texts):
    return navigate.locate_of(texts(spark, sf_dir).withColumn("asked", F.array(*[F.lit(x).cast("bigint") for x in (0, 7, 100000)])))


@add("inverse_positions", f"WITH {X}, q AS (SELECT text_id, CAST(r AS BIGINT) AS pos FROM d, unnest([0, 7, 100000]) g(r)) SELECT q.text_id, q.pos, sa.rank FROM q LEFT JOIN sa USING (text_id, pos)")
def inverse_positions(spark, sf_dir, texts=texts):
    return navigate.inverse_of(texts(spark, sf_dir).withColumn("asked", F.array(*[F.lit(x).cast("bigint") for x in (0, 7, 100000)])))


@add("extract_text", "SELECT doc_id AS text_id, substring(text, 101, 60) AS part FROM documents")
def extract_text(spark, sf_dir):
    return navigate.extract(documents(spark, sf_dir), 100, 159)


@add("extract_bwt", f"WITH {X} SELECT text_id, string_agg(ch, '' ORDER BY rank) AS part FROM sa WHERE rank BETWEEN 10 AND 40 GROUP BY text_id")
def extract_bwt(spark, sf_dir, texts=texts):
    return navigate.extract_bwt_of(texts(spark, sf_dir), 10, 40)


@add("char_range", f"WITH {X} SELECT text_id, substring(suf, 1, 1) AS ch, min(rank) AS sp, max(rank) AS ep FROM sa WHERE suf <> '' GROUP BY ALL")
def char_range(spark, sf_dir, texts=texts):
    return navigate.char_ranges(index.suffix_table(texts(spark, sf_dir), ["first_ch"]))


@add("sequence_counts", "SELECT doc_id AS text_id, CAST(len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS BIGINT) AS sequences FROM documents WHERE text IS NOT NULL")
def sequence_counts(spark, sf_dir):
    return navigate.sequence_counts(documents(spark, sf_dir), mark="\n")


@add("default_alphabet", f"WITH d AS (SELECT r_regionkey AS text_id, r_name AS t FROM region), {_ALPHABET}, n AS (SELECT text_id FROM al GROUP BY text_id HAVING count(*) = 6) SELECT text_id, c AS ch, CAST(i AS BIGINT) AS comp FROM n, (SELECT unnest(['', 'A', 'C', 'G', 'N', 'T']) AS c, unnest(range(0, 6)) AS i)")
def default_alphabet(spark, sf_dir):
    return index.default_alphabet(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("text_id"), F.col("r_name").alias("text")))


@add("text_sizes", "SELECT doc_id AS text_id, CAST(length(text) + 1 AS BIGINT) AS size FROM documents WHERE text IS NOT NULL")
def text_sizes(spark, sf_dir):
    return navigate.text_sizes(documents(spark, sf_dir))


# ---- LCP columns, minima, nearest smaller values ---------------------------------------------------------------


@add("lcp_array", f"WITH {L} SELECT text_id, rank, lcp FROM l")
def lcp_array(spark, sf_dir, texts=texts):
    return index.suffix_table(texts(spark, sf_dir), ["lcp"])


@add("lcp_large_values", f"WITH {L} SELECT text_id, rank, lcp, row_number() OVER (PARTITION BY text_id ORDER BY rank) - 1 AS large_rank FROM l WHERE lcp >= 4")
def lcp_large_values(spark, sf_dir, texts=texts):
    return ranges.large_values(index.suffix_table(texts(spark, sf_dir), ["lcp"]), least=4)


@add("lcp_slice", f"WITH {L} SELECT text_id, list(lcp ORDER BY rank) AS values FROM l WHERE rank >= 5 AND rank < 25 GROUP BY text_id")
def lcp_slice(spark, sf_dir, texts=texts):
    return ranges.lcp_slice_of(texts(spark, sf_dir), 5, 25)


@add("documents_large_lcp")
def documents_large_lcp(spark, sf_dir):
    t = index.suffix_table(documents(spark, sf_dir), ["lcp"])
    return t.groupBy("text_id").agg(F.count_if(F.col("lcp") >= ranges.LARGE).alias("large_values"), F.max("lcp").alias("longest"), F.avg("lcp").alias("average"))


_DIFF = "CAST(lcp - coalesce(lag(lcp) OVER (PARTITION BY text_id ORDER BY rank), 0) AS BIGINT)"


@add("lcp_diff_encoded", f"WITH {L}, e AS (SELECT text_id, rank, {_DIFF} AS x FROM l) SELECT text_id, rank, CASE WHEN x < 0 THEN -2 * x - 1 ELSE 2 * x END AS code FROM e")
def lcp_diff_encoded(spark, sf_dir, texts=texts):
    return ranges.lcp_codes(texts(spark, sf_dir))


@add("lcp_diff_decoded", f"WITH {L} SELECT text_id, rank, CAST(lcp AS BIGINT) AS value FROM l")
def lcp_diff_decoded(spark, sf_dir, texts=texts):
    return ranges.lcp_codes(texts(spark, sf_dir), decoded=True)


@add("lcp_block_minima", f"WITH {L} SELECT text_id, CAST(k AS INTEGER) AS level, CAST(floor(rank / power(16, k)) AS BIGINT) AS block, min(lcp) AS low FROM l, range(1, 4) g(k) GROUP BY ALL")
def lcp_block_minima(spark, sf_dir, texts=texts):
    return ranges.block_minima(index.suffix_table(texts(spark, sf_dir), ["lcp"]), branching=16)


@add(
    "rmq_leftmost",
    f"""WITH {L}, q AS (SELECT text_id, CAST(s AS BIGINT) AS sp, CAST(s + w AS BIGINT) AS ep, n FROM (SELECT text_id, length(t) + 1 AS n FROM d), range(0, 200, 40) a(s), unnest([-1, 0, 3, 40, 100000]) b(w)),
    m AS (SELECT q.text_id, q.sp, q.ep, l.rank AS pos, l.lcp, row_number() OVER (PARTITION BY q.text_id, q.sp, q.ep ORDER BY l.lcp, l.rank) AS k FROM q JOIN l ON l.text_id = q.text_id AND l.rank BETWEEN q.sp AND q.ep WHERE q.ep < q.n)
    SELECT q.text_id, q.sp, q.ep, m.pos, m.lcp FROM q LEFT JOIN m ON m.text_id = q.text_id AND m.sp = q.sp AND m.ep = q.ep AND m.k = 1""",
)
def rmq_leftmost(spark, sf_dir, texts=texts):
    t = texts(spark, sf_dir)
    asked = t.select("text_id", F.explode(F.sequence(F.lit(0), F.lit(160), F.lit(40))).alias("sp")).select("text_id", F.col("sp").cast("bigint"), F.explode(F.array(*[F.lit(w) for w in (-1, 0, 3, 40, 100000)])).alias("w"))
    return ranges.range_minimum(index.suffix_table(t, ["lcp"]), asked.select("text_id", "sp", (F.col("sp") + F.col("w")).alias("ep")))


def _neighbour_sql(name):
    side, op = ("max", "<") if name[0] == "p" else ("min", ">")
    test = "<=" if name[2] == "e" else "<"
    return f"WITH {L} SELECT a.text_id, a.rank, {side}(b.rank) AS {name} FROM l a LEFT JOIN l b ON a.text_id = b.text_id AND b.rank {op} a.rank AND b.lcp {test} a.lcp GROUP BY ALL"


def _add_neighbour(name):
    @add(name, _neighbour_sql(name))
    def query(spark, sf_dir):
        return index.suffix_table(texts(spark, sf_dir), [name])

    query.__name__ = name


for _name in ranges.NEIGHBOURS:
    _add_neighbour(_name)


@add(
    "smaller_prices",
    """WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders)
    SELECT a.o_custkey, a.o_orderkey, a.o_totalprice, max(CASE WHEN b.o_orderkey < a.o_orderkey AND b.o_totalprice < a.o_totalprice THEN b.o_orderkey END) AS psv,
      max(CASE WHEN b.o_orderkey < a.o_orderkey THEN b.o_orderkey END) AS psev, min(CASE WHEN b.o_orderkey > a.o_orderkey AND b.o_totalprice < a.o_totalprice THEN b.o_orderkey END) AS nsv,
      min(CASE WHEN b.o_orderkey > a.o_orderkey THEN b.o_orderkey END) AS nsev
    FROM v a LEFT JOIN v b ON a.o_custkey = b.o_custkey AND b.o_totalprice <= a.o_totalprice GROUP BY ALL""",
)
def smaller_prices(spark, sf_dir):
    return ranges.smaller_values(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@add(
    "interval_coverage",
    """WITH v AS (SELECT event_type, event_id AS lo, event_id + CAST(floor(value) AS BIGINT) AS hi FROM events WHERE floor(value) > 0),
    o AS (SELECT *, max(hi) OVER (PARTITION BY event_type ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v)
    SELECT event_type, CAST(count(*) AS BIGINT) AS intervals, CAST(sum(hi - lo) AS BIGINT) AS total, CAST(sum(greatest(0, hi - greatest(lo, coalesce(reach, lo)))) AS BIGINT) AS covered,
      CAST(sum(CASE WHEN reach IS NULL OR reach < lo THEN 1 ELSE 0 END) AS BIGINT) AS islands FROM o GROUP BY event_type""",
)
def interval_coverage(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("lo"), (F.col("event_id") + F.floor("value")).alias("hi"))
    return ranges.coverage(spans, "event_type", "lo", "hi")


@add(
    "lis_length",
    """WITH v AS (SELECT o_orderpriority, list([o_totalprice] ORDER BY o_orderkey) AS v, count(*) AS n FROM orders GROUP BY o_orderpriority)
    SELECT o_orderpriority, CAST(n AS BIGINT) AS entries, CAST(len(list_reduce(v, lambda acc, x: list_concat(acc[1:len(list_filter(acc, lambda y: y < x[1]))], list_concat([x[1]], acc[len(list_filter(acc, lambda y: y < x[1])) + 2:])))) AS BIGINT) AS length FROM v""",
)
def lis_length(spark, sf_dir):
    return ranges.increasing_length(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"], "o_totalprice")


@add(
    "bit_runs",
    """WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS bit FROM orders),
    s AS (SELECT *, CASE WHEN lag(bit) OVER w = bit THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM s),
    g AS (SELECT o_custkey, bit, run, count(*) AS n FROM r GROUP BY ALL)
    SELECT o_custkey, bit, CAST(count(*) AS BIGINT) AS runs, CAST(max(n) AS BIGINT) AS longest, CAST(sum(n) AS BIGINT) AS bits, CAST(sum(length(bin(n))) AS BIGINT) AS length_bits FROM g GROUP BY ALL""",
)
def bit_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("bit"))
    return ranges.bit_runs(rows, "o_custkey", "o_orderkey", "bit")


_RUNS = """WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS bit, row_number() OVER w AS i, coalesce(lag(o_orderstatus = 'F') OVER w, false) AS was FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  g AS (SELECT *, i - coalesce(lag(i) OVER (PARTITION BY o_custkey, bit ORDER BY o_orderkey), 0) AS gap FROM v),
  b AS (SELECT o_custkey, bit, i - coalesce(lag(i) OVER (PARTITION BY o_custkey ORDER BY i), 0) AS n FROM v WHERE bit <> was),
  r AS (SELECT o_custkey, count_if(bit) AS runs, sum(length(bin(n))) AS run FROM b GROUP BY o_custkey)
  SELECT g.o_custkey, CAST(coalesce(any_value(r.runs), 0) AS BIGINT) AS runs, CAST(coalesce(sum(CASE WHEN NOT bit THEN length(bin(gap)) END), 0) AS BIGINT) AS gap0, CAST(coalesce(sum(CASE WHEN bit THEN length(bin(gap)) END), 0) AS BIGINT) AS gap1, CAST(coalesce(any_value(r.run), 0) AS BIGINT) AS run
  FROM g LEFT JOIN r ON r.o_custkey = g.o_custkey GROUP BY g.o_custkey"""


@add("run_measures", _RUNS)
def run_measures(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("bit"))
    return ranges.run_measures(rows, "o_custkey", "o_orderkey", "bit")


# ---- suffix tree -----------------------------------------------------------------------------------------------


@add("lcp_intervals", f"WITH {IV} SELECT text_id, sp, ep, depth FROM iv")
def lcp_intervals(spark, sf_dir, texts=texts):
    return tree.intervals_of(texts(spark, sf_dir))


@add("tree_walk", f"WITH {IV} SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY sp, ep DESC) - 1 AS visit, sp, ep, depth FROM nodes")
def tree_walk(spark, sf_dir, texts=texts):
    return tree.walk(tree.tree_nodes(texts(spark, sf_dir), columns=["sp", "ep", "depth", "leaf"]))


@add("tree_node_count", f"WITH {IV} SELECT text_id, CAST(count(*) AS BIGINT) AS nodes, CAST(count_if(NOT leaf) AS BIGINT) AS inner, CAST(count_if(leaf) AS BIGINT) AS leaves, max(CASE WHEN NOT leaf THEN depth END) AS deepest FROM nodes GROUP BY text_id")
def tree_node_count(spark, sf_dir, texts=texts):
    return tree.counts_of(texts(spark, sf_dir))


@add("tree_depth_hist", f"WITH {IV} SELECT depth, CAST(count(*) AS BIGINT) AS nodes, CAST(sum(ep - sp + 1) AS BIGINT) AS subtree_leaves FROM iv GROUP BY depth")
def tree_depth_hist(spark, sf_dir, texts=texts):
    return tree.intervals_of(texts(spark, sf_dir)).groupBy("depth").agg(F.count("*").alias("nodes"), F.sum(F.col("ep") - F.col("sp") + 1).alias("subtree_leaves"))


@add("tree_parent", f"WITH {IV} SELECT n.text_id, n.sp, n.ep, coalesce(pa.psp, n.sp) AS parent_sp, coalesce(pa.pep, n.ep) AS parent_ep, coalesce(pa.pdepth, 0) AS parent_depth FROM nodes n LEFT JOIN pa ON n.text_id = pa.text_id AND n.sp = pa.sp AND n.ep = pa.ep")
def tree_parent(spark, sf_dir, texts=texts):
    return tree.parents(tree.tree_nodes(texts(spark, sf_dir)))


_KIDS = f"""{IV}, kids AS (SELECT pa.text_id, psp AS parent_sp, pep AS parent_ep, row_number() OVER (PARTITION BY pa.text_id, psp, pep ORDER BY pa.sp) AS child_no,
  substring(l.suf, pdepth + 1, 1) AS edge_ch, pa.sp, pa.ep, pa.depth FROM pa JOIN l ON l.text_id = pa.text_id AND l.rank = pa.sp)"""


@add("tree_children", f"WITH {_KIDS} SELECT * FROM kids")
def tree_children(spark, sf_dir, texts=texts):
    return tree.children(tree.tree_nodes(texts(spark, sf_dir)))


def _child_sql(i):
    return f"WITH {_KIDS} SELECT iv.text_id, iv.sp, iv.ep, kids.sp AS child_sp, kids.ep AS child_ep FROM iv LEFT JOIN kids ON kids.text_id = iv.text_id AND kids.parent_sp = iv.sp AND kids.parent_ep = iv.ep AND kids.child_no = {i}"


@add("tree_first_child", _child_sql(1))
def tree_first_child(spark, sf_dir, texts=texts):
    return tree.select_child(tree.tree_nodes(texts(spark, sf_dir)), 1)


@add("tree_select_child", _child_sql(3))
def tree_select_child(spark, sf_dir, texts=texts):
    return tree.select_child(tree.tree_nodes(texts(spark, sf_dir)), 3)


@add("tree_child_char", f"WITH {_KIDS} SELECT text_id, parent_sp AS sp, parent_ep AS ep, sp AS child_sp, ep AS child_ep FROM kids WHERE edge_ch = 'e'")
def tree_child_char(spark, sf_dir, texts=texts):
    return tree.child_by_char(tree.tree_nodes(texts(spark, sf_dir)), "e")


@add("tree_sibling", f"WITH {_KIDS} SELECT text_id, sp, ep, lead(sp) OVER w AS sibling_sp, lead(ep) OVER w AS sibling_ep FROM kids WINDOW w AS (PARTITION BY text_id, parent_sp, parent_ep ORDER BY sp)")
def tree_sibling(spark, sf_dir, texts=texts):
    return tree.siblings(tree.tree_nodes(texts(spark, sf_dir)))


@add(
    "tree_suffix_link",
    f"""WITH {IV}, psi AS (SELECT a.text_id, a.rank, b.rank AS psi FROM l a JOIN l b ON a.text_id = b.text_id AND b.pos = a.pos + 1),
    im AS (SELECT n.text_id, n.sp, n.ep, n.leaf, a.psi AS x, b.psi AS y FROM nodes n JOIN psi a ON a.text_id = n.text_id AND a.rank = n.sp JOIN psi b ON b.text_id = n.text_id AND b.rank = n.ep WHERE n.depth > 0),
    s AS (SELECT im.*, t.sp AS link_sp, t.ep AS link_ep, row_number() OVER (PARTITION BY im.text_id, im.sp, im.ep ORDER BY t.ep - t.sp, t.depth DESC) AS k
      FROM im JOIN nodes t ON t.text_id = im.text_id AND t.sp <= im.x AND im.y <= t.ep AND (t.leaf = im.leaf))
    SELECT text_id, sp, ep, link_sp, link_ep FROM s WHERE k = 1""",
)
def tree_suffix_link(spark, sf_dir, texts=texts):
    return tree.suffix_links(tree.tree_nodes(texts(spark, sf_dir)))


@add("tree_leaf", f"WITH {L} SELECT text_id, rank, CAST(lcp AS BIGINT) AS left_lcp, CAST(coalesce(lead(lcp) OVER (PARTITION BY text_id ORDER BY rank), 0) AS BIGINT) AS right_lcp, CAST(n - 1 - pos AS BIGINT) AS depth FROM l")
def tree_leaf(spark, sf_dir, texts=texts):
    return tree.leaves(tree.tree_nodes(texts(spark, sf_dir)))


@add("tree_traversal_digest")
def tree_traversal_digest(spark, sf_dir, texts=texts):
    return tree.digest_of(texts(spark, sf_dir))


@add("documents_tree_counts")
def documents_tree_counts(spark, sf_dir):
    return tree.counts_of(documents(spark, sf_dir))


# ---- matches ---------------------------------------------------------------------------------------------------

_MS = f"""{PAIRS}, q0 AS (SELECT pair_id AS query_id, next_id AS text_id, ref AS q, seq AS t, unnest(range(0, length(ref))) AS start FROM pr),
ms AS (SELECT query_id, text_id, start, q, t, CAST(coalesce(list_max(list_filter(range(1, length(q) - start + 1), lambda k: contains(t, substring(q, start + 1, k)))), 0) AS BIGINT) AS length FROM q0),
mm AS (SELECT * FROM (SELECT *, coalesce(lag(length) OVER (PARTITION BY query_id, text_id ORDER BY start), 0) - 1 AS before FROM ms) WHERE length > 0 AND length > before)"""
_MRANGE = """, xr AS (SELECT DISTINCT text_id, t FROM q0), xs AS (SELECT text_id, t, unnest(range(0, length(t) + 1)) AS pos FROM xr),
xo AS (SELECT text_id, substring(t, pos + 1) AS suf, row_number() OVER (PARTITION BY text_id ORDER BY substring(t, pos + 1)) - 1 AS rank FROM xs)"""


def _match_pairs(spark, sf_dir, texts):
    return _neighbours(texts(spark, sf_dir)).select(F.col("pair_id").alias("query_id"), F.col("ref").alias("query"), F.col("next_id").alias("text_id"), F.col("seq").alias("text"))


@add("matching_statistics", f"WITH {_MS} SELECT query_id, text_id, start, length FROM ms")
def matching_statistics(spark, sf_dir, texts=texts):
    return matches.matching_statistics(_match_pairs(spark, sf_dir, texts), ranges=False)


@add("maximal_matches", f"WITH {_MS}{_MRANGE} SELECT mm.query_id, mm.text_id, mm.start, mm.length, min(xo.rank) AS sp, max(xo.rank) AS ep FROM mm JOIN xo ON xo.text_id = mm.text_id AND starts_with(xo.suf, substring(mm.q, mm.start + 1, mm.length)) GROUP BY ALL")
def maximal_matches(spark, sf_dir, texts=texts):
    return matches.matching_statistics(_match_pairs(spark, sf_dir, texts), maximal=True)


@add("maximal_summary", f"WITH {_MS} SELECT query_id, CAST(count(*) AS BIGINT) AS matches, avg(length) AS average_length FROM mm GROUP BY query_id")
def maximal_summary(spark, sf_dir, texts=texts):
    return matches.maximal_sums(_match_pairs(spark, sf_dir, texts))


# ---- alignment -------------------------------------------------------------------------------------------------

_MERGED = f"""{PAIRS}, mo AS (SELECT pair_id, CAST(0 AS BIGINT) AS from_seq, unnest(range(0, length(ref) + 1)) AS pos, ref AS t FROM pr UNION ALL SELECT pair_id, 1, unnest(range(0, length(seq) + 1)), seq FROM pr),
mg AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY substring(t, pos + 1), from_seq) - 1 AS mutual_rank, from_seq, pos, length(t) AS n FROM mo)"""


@add("mutual_suffix_order", f"WITH {_MERGED} SELECT pair_id, mutual_rank, from_seq, pos FROM mg")
def mutual_suffix_order(spark, sf_dir, text_pairs=text_pairs):
    return align.merged_order(text_pairs(spark, sf_dir))


@add(
    "left_right_matches",
    f"""WITH {_MERGED}, nb AS (SELECT pair_id, from_seq, pos, n, lag(from_seq) OVER w AS bf, lag(pos) OVER w AS bp, lag(n) OVER w AS bn, lead(from_seq) OVER w AS af, lead(pos) OVER w AS ap, lead(n) OVER w AS an FROM mg WINDOW w AS (PARTITION BY pair_id ORDER BY mutual_rank)),
    h AS (SELECT pair_id, CAST(0 AS BIGINT) AS side, pos AS r, bp AS s FROM nb WHERE from_seq = 0 AND bf = 1 AND pos < n AND bp < bn
      UNION ALL SELECT pair_id, 1, pos, ap FROM nb WHERE from_seq = 0 AND af = 1 AND pos < n AND ap < an),
    g AS (SELECT *, r - row_number() OVER (PARTITION BY pair_id, side, r - s ORDER BY r) AS island FROM h)
    SELECT pair_id, side, min(r) AS ref_start, min(s) AS seq_start, CAST(count(*) AS BIGINT) AS length FROM g GROUP BY pair_id, side, r - s, island""",
)
def left_right_matches(spark, sf_dir, text_pairs=text_pairs):
    return align.neighbour_runs(text_pairs(spark, sf_dir))


@add("invariant_alignment")
def invariant_alignment(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir)
    return align.invariant_alignment(pairs, align.neighbour_matches(align.merged_order(pairs)))


_TAILS = "lambda acc, x: list_concat(acc[1:len(list_filter(acc, lambda y: y < x[1]))], list_concat([x[1]], acc[len(list_filter(acc, lambda y: y < x[1])) + 2:]))"


@add(
    "lcs_lengths",
    f"""WITH {PAIRS}, a AS (SELECT pair_id, unnest(range(1, length(ref) + 1)) AS i, ref, seq FROM pr), b AS (SELECT pair_id, unnest(range(1, length(seq) + 1)) AS j, seq FROM pr),
    m AS (SELECT a.pair_id, list([j] ORDER BY i, j DESC) AS v FROM a JOIN b ON a.pair_id = b.pair_id AND substring(a.ref, i, 1) = substring(b.seq, j, 1) GROUP BY a.pair_id)
    SELECT pair_id, CAST(len(list_reduce(list_prepend([v[1][1]], v), {_TAILS})) AS BIGINT) AS lcs FROM m""",
)
def lcs_lengths(spark, sf_dir):
    return align.lcs_lengths(align.lcs_alignment(text_pairs(spark, sf_dir)))


@add("lcs_map_position")
def lcs_map_position(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir)
    asked = pairs.select("pair_id", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 10, 50)])).alias("ref_pos"))
    return align.map_position(align.lcs_alignment(pairs), asked)


@add("alignment_in_suffix_order")
def alignment_in_suffix_order(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir)
    sides = [index.suffix_table(pairs.select(F.col("pair_id"), F.col(c).alias("text")), ["pos"], id_col="pair_id") for c in ("ref", "seq")]
    return align.to_suffix_order(align.lcs_alignment(pairs), *sides)


@add("block_alignment")
def block_alignment(spark, sf_dir, text_pairs=text_pairs):
    return align.block_alignment(text_pairs(spark, sf_dir), block=8, depth=8)


_PARTS = f"""{PAIRS}, ra AS (SELECT pair_id, ref AS t, unnest(range(0, length(ref) + 1)) AS pos FROM pr), rb AS (SELECT pair_id, seq AS t, unnest(range(0, length(seq) + 1)) AS pos FROM pr),
  oa AS (SELECT pair_id, substring(t, pos + 1, 4) AS seed, row_number() OVER (PARTITION BY pair_id ORDER BY substring(t, pos + 1)) - 1 AS rank FROM ra),
  ob AS (SELECT pair_id, substring(t, pos + 1, 4) AS seed, row_number() OVER (PARTITION BY pair_id ORDER BY substring(t, pos + 1)) - 1 AS rank FROM rb),
  ga AS (SELECT pair_id, seed, min(rank) AS ref_sp, max(rank) AS ref_ep FROM oa GROUP BY ALL), gb AS (SELECT pair_id, seed, min(rank) AS seq_sp, max(rank) AS seq_ep FROM ob GROUP BY ALL),
  bl AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY ref_sp) - 1 AS block_no, ref_sp, ref_ep, seq_sp, seq_ep FROM ga JOIN gb USING (pair_id, seed))"""


@add("alignment_partitions", f"WITH {_PARTS} SELECT * FROM bl")
def alignment_partitions(spark, sf_dir, text_pairs=text_pairs):
    return align.partitions(text_pairs(spark, sf_dir), block=1, depth=4)


@add(
    "partition_statistics",
    f"""WITH {_PARTS}, e AS (SELECT *, coalesce(lag(ref_ep) OVER w + 1, 0) AS re, coalesce(lag(seq_ep) OVER w + 1, 0) AS se FROM bl WINDOW w AS (PARTITION BY pair_id ORDER BY block_no)),
    s AS (SELECT pair_id, count(*) AS ranges, sum(least(ref_ep - ref_sp, seq_ep - seq_sp) + 1) AS x, sum(ref_sp - re) AS rg, sum(seq_sp - se) AS sg, max(ref_ep) AS rl, max(seq_ep) AS sl, count_if(ref_sp < re) AS ro, count_if(seq_sp < se) AS so FROM e GROUP BY pair_id),
    z AS (SELECT s.*, length(ref) + 1 AS rn, length(seq) + 1 AS sn FROM s JOIN pr USING (pair_id)), m AS (SELECT *, rg + rn - rl - 1 AS rm, sg + sn - sl - 1 AS sm FROM z)
    SELECT pair_id, CAST(ranges AS BIGINT) AS ranges, CAST(x AS BIGINT) AS intersection, CAST(rm AS BIGINT) AS ref_missed, CAST(sm AS BIGINT) AS seq_missed, CAST(rn - x - rm AS BIGINT) AS ref_lost,
      CAST(sn - x - sm AS BIGINT) AS seq_lost, CAST(ro AS BIGINT) AS ref_overlaps, CAST(so AS BIGINT) AS seq_overlaps FROM m""",
)
def partition_statistics(spark, sf_dir, text_pairs=text_pairs):
    return align.partition_sums(text_pairs(spark, sf_dir), block=1, depth=4)


_NO_FAULTS = f"WITH {PAIRS} SELECT pair_id, CAST(0 AS BIGINT) AS faults FROM pr"


@add("block_alignment_faults", _NO_FAULTS)
def block_alignment_faults(spark, sf_dir, text_pairs=text_pairs):
    return align.faults_of(text_pairs(spark, sf_dir), lambda refs, seqs: align.block_rows(refs, seqs, 8, 8, align.MOST_EDITS)).select("pair_id", "faults")


@add("run_alignment_faults", _NO_FAULTS)
def run_alignment_faults(spark, sf_dir, text_pairs=text_pairs):
    return align.faults_of(text_pairs(spark, sf_dir), align.run_rows).select("pair_id", "faults")


@add("run_alignment")
def run_alignment(spark, sf_dir, text_pairs=text_pairs):
    return align.run_alignment(text_pairs(spark, sf_dir))


@add("relative_lf", f"""WITH {PAIRS}, x AS (SELECT pair_id, seq, length(seq) + 1 AS n, unnest(range(0, length(seq) + 1)) AS pos FROM pr), o AS (SELECT pair_id, pos, n, row_number() OVER (PARTITION BY pair_id ORDER BY substring(seq, pos + 1)) - 1 AS rank, CASE WHEN pos = 0 THEN '' ELSE substring(seq, pos, 1) END AS ch FROM x)
  SELECT a.pair_id, a.rank, a.ch, row_number() OVER (PARTITION BY a.pair_id, a.ch ORDER BY a.rank) - 1 AS occ, b.rank AS lf FROM o a JOIN o b ON a.pair_id = b.pair_id AND b.pos = (a.pos - 1 + a.n) % a.n""")
def relative_lf(spark, sf_dir):
    """LF of seq through a relative index that was written and read again."""
    pairs = text_pairs(spark, sf_dir)
    ref, seq = _pair_indexes(pairs)
    aligned = cut(align.block_alignment(pairs))
    path = f"{shared_dir(spark).rstrip('/')}/relative-{uuid.uuid4().hex}"
    readers.save_relative({"aligned": aligned, "ref_rest": align.complement(ref, aligned, "ref"), "seq_rest": align.complement(seq, aligned, "seq")}, path)
    kept = readers.load_relative(spark, path)
    return align.relative_lf(ref, kept["seq_rest"], kept["aligned"])


def _pair_indexes(pairs):
    return [index.suffix_table(pairs.select("pair_id", F.col(c).alias("text")), ["pos", "ch"], id_col="pair_id") for c in ("ref", "seq")]


@add("rebuilt_bwt", f"WITH {PAIRS}, x AS (SELECT pair_id, seq, unnest(range(0, length(seq) + 1)) AS pos FROM pr) SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY substring(seq, pos + 1)) - 1 AS rank, CASE WHEN pos = 0 THEN '' ELSE substring(seq, pos, 1) END AS ch FROM x")
def rebuilt_bwt(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir)
    ref, seq = _pair_indexes(pairs)
    aligned = align.block_alignment(pairs)
    return align.rebuild_bwt(ref, align.complement(seq, aligned, "seq"), aligned)


@add("alignment_losses")
def alignment_losses(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir)
    sizes = pairs.select("pair_id", (F.char_length("ref") + 1).alias("ref_size"), (F.char_length("seq") + 1).alias("seq_size"))
    return align.alignment_losses(align.block_alignment(pairs), sizes)


@add(
    "alignment_seeds",
    f"""WITH {PAIRS}, ra AS (SELECT pair_id, ref AS t, unnest(range(0, length(ref) + 1)) AS pos FROM pr), rb AS (SELECT pair_id, seq AS t, unnest(range(0, length(seq) + 1)) AS pos FROM pr),
    oa AS (SELECT pair_id, substring(t, pos + 1, 4) AS seed, row_number() OVER (PARTITION BY pair_id ORDER BY substring(t, pos + 1)) - 1 AS rank FROM ra),
    ob AS (SELECT pair_id, substring(t, pos + 1, 4) AS seed, row_number() OVER (PARTITION BY pair_id ORDER BY substring(t, pos + 1)) - 1 AS rank FROM rb),
    ga AS (SELECT pair_id, seed, min(rank) AS ref_sp, max(rank) AS ref_ep FROM oa WHERE length(seed) = 4 GROUP BY ALL), gb AS (SELECT pair_id, seed, min(rank) AS seq_sp, max(rank) AS seq_ep FROM ob WHERE length(seed) = 4 GROUP BY ALL)
    SELECT pair_id, seed, ref_sp, ref_ep, seq_sp, seq_ep, ref_ep - ref_sp + seq_ep - seq_sp + 2 AS weight FROM ga JOIN gb USING (pair_id, seed)""",
)
def alignment_seeds(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir)
    ref, seq = (pairs.select("pair_id", F.col(c).alias("text")) for c in ("ref", "seq"))
    return align.seeds(*_pair_indexes(pairs), ref, seq)


@add(
    "common_char_top1",
    f"""WITH {PAIRS}, a AS (SELECT pair_id, ch, count(*) AS n FROM (SELECT pair_id, unnest(string_split(ref, '')) AS ch FROM pr WHERE ref <> '') GROUP BY ALL), b AS (SELECT pair_id, ch, count(*) AS n FROM (SELECT pair_id, unnest(string_split(seq, '')) AS ch FROM pr WHERE seq <> '') GROUP BY ALL),
    c AS (SELECT pair_id, ch, least(a.n, b.n) AS copies, row_number() OVER (PARTITION BY pair_id ORDER BY least(a.n, b.n) DESC, ch) AS k FROM a JOIN b USING (pair_id, ch)) SELECT pair_id, ch, copies FROM c WHERE k = 1""",
)
def common_char_top1(spark, sf_dir, text_pairs=text_pairs):
    return align.commonest_character(text_pairs(spark, sf_dir))


@add(
    "comp_mapping_asof",
    """WITH a AS (SELECT DISTINCT lang, ch FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '')), q AS (SELECT ch FROM a WHERE lang = 'fr'), r AS (SELECT ch FROM a WHERE lang = 'es')
    SELECT CAST(1 AS BIGINT) AS pair_id, q.ch, (SELECT min(r.ch) FROM r WHERE r.ch >= q.ch) AS ref_ch, coalesce((SELECT min(r.ch) FROM r WHERE r.ch >= q.ch) = q.ch, false) AS exact FROM q""",
)
def comp_mapping_asof(spark, sf_dir):
    chars = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.filter(F.split("text", ""), lambda x: x != ""))).alias("ch")).distinct()
    side = lambda lang: chars.filter(F.col("lang") == lang).select(F.lit(1).cast("bigint").alias("pair_id"), "ch")
    return align.map_alphabet(side("es"), side("fr"))


@add("alphabet_intersection", "WITH a AS (SELECT DISTINCT lang, ch FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '')) SELECT ch FROM a WHERE lang = 'fr' INTERSECT SELECT ch FROM a WHERE lang = 'es'")
def alphabet_intersection(spark, sf_dir):
    chars = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.filter(F.split("text", ""), lambda x: x != ""))).alias("ch"))
    return chars.filter("lang = 'fr'").select("ch").intersect(chars.filter("lang = 'es'").select("ch"))


# ---- relative columns, reports ---------------------------------------------------------------------------------


def _lcp_pairs(spark, sf_dir, text_pairs=text_pairs):
    pairs = text_pairs(spark, sf_dir)
    return [index.suffix_table(pairs.select("pair_id", F.col(c).alias("text")), ["lcp"], id_col="pair_id").select("pair_id", "rank", F.col("lcp").cast("bigint").alias("value")) for c in ("seq", "ref")]


@add("rlz_phrases")
def rlz_phrases(spark, sf_dir, text_pairs=text_pairs):
    return relative.phrases_of(text_pairs(spark, sf_dir))


@add("rlz_decode", f"WITH {L}, k AS (SELECT item_id, lag(item_id) OVER (ORDER BY item_id) AS pair_id FROM benchmark) SELECT k.pair_id, l.rank, CAST(l.lcp AS BIGINT) AS value FROM l JOIN k ON k.item_id = l.text_id WHERE k.pair_id IS NOT NULL")
def rlz_decode(spark, sf_dir):
    target, source = _lcp_pairs(spark, sf_dir)
    return relative.decode_phrases(relative.copy_phrases(target, source), source)


@add("rlz_statistics")
def rlz_statistics(spark, sf_dir, text_pairs=text_pairs):
    return relative.phrase_statistics(relative.phrases_of(text_pairs(spark, sf_dir)))


@add("size_report", "WITH p AS (SELECT lang AS grp, source AS part, sum(octet_length(encode(text))) AS bytes, max(n_chars) AS chars FROM documents GROUP BY ALL), a AS (SELECT * FROM p UNION ALL SELECT grp, 'total', sum(bytes), max(chars) FROM p GROUP BY grp) SELECT grp AS lang, part AS source, CAST(bytes AS BIGINT) AS bytes, CAST(bytes AS DOUBLE) / 1048576.0 AS mb, CAST(bytes AS DOUBLE) * 8.0 / chars AS bpc FROM a")
def size_report(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("lang", "source", F.octet_length("text").cast("bigint").alias("size"), "n_chars")
    return relative.size_report(parts, "lang", "source", "size", "n_chars")


@add("size_tree", "WITH p AS (SELECT lang, source, octet_length(encode(text)) AS b FROM documents) SELECT 'corpus' AS node, 1 AS level, CAST(sum(b) AS BIGINT) AS bytes FROM p UNION ALL SELECT 'corpus/' || lang, 2, CAST(sum(b) AS BIGINT) FROM p GROUP BY lang UNION ALL SELECT 'corpus/' || lang || '/' || source, 3, CAST(sum(b) AS BIGINT) FROM p GROUP BY lang, source")
def size_tree(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select(F.array(F.lit("corpus"), "lang", "source").alias("path"), F.octet_length("text").cast("bigint").alias("size"))
    return relative.size_tree(parts, "path", "size")


@add("bit_lengths", "SELECT o_orderkey, CAST(CASE WHEN o_custkey = 0 THEN 0 ELSE length(bin(o_custkey)) END AS INTEGER) AS bits, CASE WHEN o_custkey - 700 < 0 THEN -2 * (o_custkey - 700) - 1 ELSE 2 * (o_custkey - 700) END AS code, o_custkey - 700 AS back FROM orders")
def bit_lengths(spark, sf_dir):
    v = F.col("o_custkey") - 700
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.bit_length(F.col("o_custkey")).cast("int").alias("bits"), scalars.zigzag(v).alias("code"), scalars.from_positive_code(scalars.positive_code(v)).alias("back"))


@add(
    "value_digest",
    """WITH g AS (SELECT l_suppkey, list(CAST((l_orderkey >> (8 * b)) & 255 AS HUGEINT) ORDER BY n, b) AS v FROM (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS n FROM lineitem), range(0, 8) r(b) GROUP BY l_suppkey)
    SELECT l_suppkey, CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), v), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616) AS VARCHAR) AS digest FROM g""",
)
def value_digest(spark, sf_dir):
    rows = F.array_sort(F.collect_list("l_orderkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(rows.alias("v")).select("l_suppkey", scalars.fnv1a("v").alias("digest"))


# ---- sources ---------------------------------------------------------------------------------------------------


@add(
    "fasta_parse",
    """WITH s AS (SELECT doc_id AS text_id, string_split(text, chr(10)) AS v FROM documents WHERE text IS NOT NULL),
    j AS (SELECT text_id, len(list_filter(v, lambda x: starts_with(x, '>'))) AS sequences, regexp_replace(translate(array_to_string(list_filter(v, lambda x: NOT starts_with(x, '>')), ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'N+', 'N', 'g') AS t FROM s)
    SELECT text_id, CAST(sequences AS BIGINT) AS sequences, CAST(length(t) AS BIGINT) AS chars, t AS text FROM j""",
)
def fasta_parse(spark, sf_dir):
    return readers.fasta_of(documents(spark, sf_dir), collapse_n=True)


@add(
    "column_extract",
    """WITH s AS (SELECT doc_id AS text_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    c AS (SELECT text_id, i, substring(v, 4, 1) AS ch FROM s WHERE length(v) > 3), k AS (SELECT *, min(CASE WHEN regexp_matches(ch, '^[0-9]$') THEN i END) OVER (PARTITION BY text_id) AS stop FROM c)
    SELECT text_id, string_agg(ch, '' ORDER BY i) AS text FROM k WHERE stop IS NULL OR i < stop GROUP BY text_id""",
)
def column_extract(spark, sf_dir):
    return readers.column_of(documents(spark, sf_dir), 3)


@add("mutate")
def mutate(spark, sf_dir):
    return generators.mutate(documents(spark, sf_dir), 0.01)


@add("random_positions")
def random_positions(spark, sf_dir):
    return generators.random_positions(spark, 1000, 1_000_000)


@add("random_ranges")
def random_ranges(spark, sf_dir):
    return generators.random_ranges(spark, 1000, 1_000_000)


@add("dedup_patterns", "SELECT DISTINCT text AS pattern FROM documents")
def dedup_patterns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("text").alias("pattern")).distinct()


@add(
    "log_sizes",
    """WITH l AS (SELECT 'log' || l_suppkey AS file, 'Part ' || l_returnflag AS part, l_orderkey * 8 + l_linenumber AS n, CAST(printf('%.3f', l_extendedprice) AS DOUBLE) AS mb, CAST(printf('%.2f', l_quantity) AS DOUBLE) AS bpc FROM lineitem)
    SELECT file, part, arg_max(mb, n) AS mb, arg_max(bpc, n) AS bpc, CAST(NULL AS DOUBLE) AS seconds FROM l GROUP BY file, part""",
)
def log_sizes(spark, sf_dir):
    """Build-log lines made from the line items, then read again."""
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("log"), "l_suppkey").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), F.format_string("Part %s:  %.3f MB (%.2f bpc)", F.col("l_returnflag"), F.col("l_extendedprice"), F.col("l_quantity")).alias("value"))
    return readers.log_sizes(items)


# ---- the same queries over all documents -----------------------------------------------------------------------

for _query in (
    pattern_range, pattern_multi_summary, pattern_locate, pattern_strategy, pattern_checked, saved_find, saved_locate, saved_order_faults, tree_find, suffix_array,
    inverse_suffix_array, bwt, recode_text, sa_samples, isa_samples, lf_mapping, psi_mapping, psi_k, bwt_rank,
    bwt_rank_window, bwt_select, bwt_rank_at, backward_step, locate_ranks, inverse_positions, extract_bwt, char_range,
    lcp_array, lcp_large_values, lcp_slice, lcp_diff_encoded, lcp_diff_decoded, lcp_block_minima, rmq_leftmost,
    lcp_intervals, tree_node_count, tree_depth_hist, tree_parent, tree_children, tree_first_child, tree_select_child,
    tree_child_char, tree_sibling, tree_suffix_link, tree_leaf, tree_traversal_digest, matching_statistics, maximal_matches, maximal_summary,
):
    add(f"documents_{_query.__name__}")(partial(_query, texts=documents))
for _query in (
    mutual_suffix_order, left_right_matches, common_char_top1, block_alignment, alignment_partitions, partition_statistics,
    run_alignment, rlz_phrases, rlz_statistics,
):
    add(f"documents_{_query.__name__}")(partial(_query, text_pairs=document_pairs))

_DOC_PAIRS = "pr AS (SELECT * FROM (SELECT doc_id AS pair_id, text AS ref, lead(text) OVER (ORDER BY doc_id) AS seq FROM documents) WHERE seq IS NOT NULL AND ref IS NOT NULL)"
for _query in (block_alignment_faults, run_alignment_faults):
    add(f"documents_{_query.__name__}", f"WITH {_DOC_PAIRS} SELECT pair_id, CAST(0 AS BIGINT) AS faults FROM pr")(partial(_query, text_pairs=document_pairs))


@add("documents_rlz_faults", f"WITH {_DOC_PAIRS} SELECT pair_id, CAST(length(seq) + 1 AS BIGINT) AS places, CAST(0 AS BIGINT) AS faults FROM pr")
def documents_rlz_faults(spark, sf_dir):
    """Places of each pair's column that its phrases don't give back."""
    return relative.phrase_faults(document_pairs(spark, sf_dir))


@add("documents_passage_matches")
def documents_passage_matches(spark, sf_dir):
    """The passages against all documents: for each the maximal matches, the documents that hold it whole, the longest match."""
    passages = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return matches.passage_sums(documents(spark, sf_dir), passages.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
