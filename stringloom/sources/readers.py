"""Readers of text inputs: raw files, FASTA, one column of lines, pattern files, build logs; and index tables on disk."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, text): each file under the path as one text; the id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("text_id"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, text): each file as one text whose characters stand for its bytes, so positions are byte positions."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("text_id"), F.decode("content", "ISO-8859-1").alias("text"))


def read_patterns(spark: SparkSession, path: str, skip_empty: bool = True) -> DataFrame:
    """(pattern): the lines of the files under the path. Kept empty lines include the last one after a final newline."""
    if skip_empty:
        return spark.read.text(path).select(F.col("value").alias("pattern")).filter(F.length("pattern") > 0)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.split("value", "\n")).alias("pattern"))


def lines_of(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, value) of each text's lines, from 0."""
    return texts.filter(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "value"))


def fasta(lines: DataFrame, collapse_n: bool = False, id_col: str = "text_id") -> DataFrame:
    """(id, sequences, chars, text): header lines (``>``) dropped and counted, the other lines joined in order, ASCII letters in
    upper case; ``collapse_n`` makes one N of every run, also across headers and lines."""
    header = F.col("value").startswith(">")
    rows = F.array_sort(F.collect_list(F.when(~header, F.struct("line_no", "value"))))
    whole = lines.groupBy(id_col).agg(F.count_if(header).alias("sequences"), F.translate(F.array_join(F.transform(rows, lambda r: r["value"]), ""), ascii_lowercase, ascii_uppercase).alias("text"))
    text = F.regexp_replace("text", "N+", "N") if collapse_n else F.col("text")
    return whole.select(id_col, "sequences", F.char_length(text).cast("bigint").alias("chars"), text.alias("text"))


def column(lines: DataFrame, col: int, id_col: str = "text_id") -> DataFrame:
    """(id, text): the character at column ``col`` (from 0) of each long enough line, in order, up to the first line
    whose character there is a digit."""
    own = Window.partitionBy(id_col)
    chars = lines.filter(F.char_length("value") > col).select(id_col, "line_no", F.substring("value", col + 1, 1).alias("ch"))
    stop = F.min(F.when(F.col("ch").rlike("^[0-9]$"), F.col("line_no"))).over(own)
    kept = chars.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop")))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "ch")))
    return kept.groupBy(id_col).agg(F.array_join(F.transform(rows, lambda r: r["ch"]), "").alias("text"))


def fasta_of(texts: DataFrame, collapse_n: bool = False, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``fasta``, for whole texts: the lines of a text stay together, so nothing is dealt."""
    lines = F.split(text_col, "\n")
    whole = texts.filter(F.col(text_col).isNotNull()).select(id_col, lines.alias("_lines"))
    header = lambda x: x.startswith(">")
    joined = F.translate(F.array_join(F.filter("_lines", lambda x: ~header(x)), ""), ascii_lowercase, ascii_uppercase)
    text = F.regexp_replace(joined, "N+", "N") if collapse_n else joined
    made = whole.select(id_col, F.size(F.filter("_lines", header)).cast("bigint").alias("sequences"), text.alias("text"))
    return made.select(id_col, "sequences", F.char_length("text").cast("bigint").alias("chars"), "text")


def column_of(texts: DataFrame, col: int, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """As ``column``, for whole texts, without a shuffle."""
    long = F.filter(F.split(text_col, "\n"), lambda x: F.char_length(x) > col)
    chars = texts.select(id_col, F.array_join(F.transform(long, lambda x: F.substring(x, col + 1, 1)), "").alias("_chars"))
    return chars.select(id_col, F.regexp_extract("_chars", "^[^0-9]*", 0).alias("text")).filter("text <> ''")


def log_sizes(lines: DataFrame) -> DataFrame:
    """(file, part, mb, bpc, seconds) from build logs' lines (file, line_no, value) such as
    ``Name:  12.5 MB (1.1 bpc)`` or ``Name: 3.2 seconds``; a part that stands twice in a file keeps its last line."""
    number = r"([0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?)"
    pick = lambda p: F.try_to_number(F.regexp_extract("value", p, 1), F.lit("9" * 18 + "." + "9" * 9)).cast("double")
    found = lines.select(
        "file", "line_no", F.regexp_extract("value", r"^\s*([^:]+?)\s*:", 1).alias("part"), pick(number + r"\s*MB").alias("mb"),
        pick(number + r"\s*bpc").alias("bpc"), pick(number + r"\s*seconds").alias("seconds"),
    ).filter("part <> '' and (mb is not null or seconds is not null)")
    last = F.max_by(F.struct("mb", "bpc", "seconds"), "line_no").alias("x")
    return found.groupBy("file", "part").agg(last).select("file", "part", "x.mb", "x.bpc", "x.seconds")


def save_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Keep a suffix table (or any table of this library) as Parquet."""
    index.write.mode(mode).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def build_or_load(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built and kept there first if it isn't there yet. The path may be in any store that Spark
    reads; files of a write that did not end are not seen, as Spark commits them together."""
    try:
        return load_index(spark, path)
    except AnalysisException:
        save_index(build(), path)
        return load_index(spark, path)


RELATIVE = ("aligned", "ref_rest", "seq_rest")


def save_relative(parts: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Keep a relative index: the alignment of two Burrows-Wheeler columns (pair_id, ref_rank, seq_rank) and what it leaves of both
    sides (pair_id, rank, ch), a table each under ``path``."""
    for name in RELATIVE:
        parts[name].write.mode(mode).parquet(f"{path}/{name}")


def load_relative(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``save_relative``; with ref's index ``align.relative_lf`` answers for seq."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in RELATIVE}
