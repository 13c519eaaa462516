"""Line dedup by repeated three-line windows, in DataFrame functions only.

Every run of ``window`` consecutive lines is hashed; a window that occurs earlier in
the corpus (by id, then by line) is a repetition, and its lines are covered. Covered
positions of overlapping windows are merged and those lines removed, so a passage of
any length goes from all documents but the first. Two shuffles carry hashes: one counts
each window and finds its first place with partial aggregation, one brings that place
back to the windows. Only then do covered positions meet the texts.

Lines are separated by line feeds and compared without outer blanks; a window needs at
least one line that is not blank. Texts of fewer lines have no window and stay.

Defined results: null texts stay null; repeated rows (same id and text) are one
document and lose the same lines; same ids with different texts are ordered by a hash
of the text; rows without id come first. Texts of any length are taken whole: a text is split
in one row, and each of its windows is a row of one hash. Columns may have any name. No rows
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.session import written

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, at, hash) of every window of ``docs`` (doc_id, row, text)."""
    trimmed = F.transform(_lines(F.col("text")), lambda line: F.trim(line))
    cut = docs.select("doc_id", "row", trimmed.alias("lines")).filter(F.size("lines") >= window)
    starts = F.sequence(F.lit(0), F.size("lines") - window)
    joined = F.transform(starts, lambda i: F.array_join(F.slice("lines", i + 1, window), "\n"))
    found = cut.select("doc_id", "row", F.posexplode(joined).alias("at", "seen"))
    return found.filter(~F.col("seen").rlike(r"^\s*$")).select(
        "doc_id", "row", "at", F.unhex(F.md5("seen")).alias("hash")
    )


def repeated_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """(doc_id, row, covered): line numbers (from 0) covered by later occurrences.

    ``row`` is the hash of the text. Rows of ``docs`` that lose nothing are left out.
    """
    whole = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("row"), whole.alias("text"))
    seen = written(windows(rows, window), "windows")
    first = (
        seen.groupBy("hash")
        .agg(F.min(F.struct("doc_id", "row", "at")).alias("first"), F.count(F.lit(1)).alias("times"))
        .filter("times > 1")
    )
    here = F.struct("doc_id", "row", "at")
    later = seen.join(first.drop("times"), "hash").filter(~here.eqNullSafe(F.col("first")))
    covered = F.flatten(F.collect_set(F.sequence("at", F.col("at") + window - 1)))
    return later.groupBy("doc_id", "row").agg(F.array_sort(F.array_distinct(covered)).alias("covered"))


def remove_repeated_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    into: str = "lines_removed",
) -> DataFrame:
    """``docs`` with its columns, and ``into``; ``text`` has lost covered lines.

    Columns of ``docs`` travel as one struct, so their names clash with nothing; a column named
    ``into`` is replaced.
    """
    found = repeated_lines(docs, doc_id=doc_id, text=text, window=window)
    found = found.select(F.col("doc_id").alias("id"), F.col("row").alias("of"), "covered")
    whole = docs.select(
        F.struct(*docs.columns).alias("all"),
        F.col(doc_id).alias("mine"),
        F.xxhash64(F.col(text).cast("string")).alias("hash"),
    )
    met = whole.join(found, F.col("mine").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of")), "left")
    kept = F.filter(
        F.transform(_lines(F.col("all")[text]), lambda line, at: F.struct(at.alias("at"), line.alias("line"))),
        lambda x: ~F.array_contains("covered", x["at"]),
    )
    less = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    cut = F.when(F.col("covered").isNull(), F.col("all")[text]).otherwise(less)
    return met.select(
        *[(cut if c == text else F.col("all")[c]).alias(c) for c in docs.columns if c != into],
        F.coalesce(F.size("covered"), F.lit(0)).alias(into),
    )
