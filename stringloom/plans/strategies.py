"""Choices between physical forms of one question."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stringloom.operators import search

SCAN_PATTERNS = 16


def pattern_counts(texts: DataFrame, patterns: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, cnt): a look-ahead scan for a few patterns, one suffix array per text for many.

    A scan reads a text once for each pattern and builds nothing; a suffix array costs about a sort of the
    text and answers each further pattern in logarithmic time.
    """
    found = search.collect_patterns(patterns)
    if len(found) <= SCAN_PATTERNS:
        return search.count_scan(texts, found, id_col, text_col)
    return search.find(texts, found, id_col, text_col).select(id_col, "pattern", "cnt")
