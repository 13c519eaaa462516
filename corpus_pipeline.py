"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a table. All but the last return the
columns of ``documents``; ``run`` writes each stage's result as Parquet to the shared
folder, hands it to the next and deletes what else the stage has written. Rows without text,
or without a word, are clean and pass through. Extra columns are kept, whatever their names.

* toxicity: rows scored 0.7 or more go. Labels come from ``labels``.
* line dedup: lines in later occurrences of repeated three-line windows are cut out; a
  row left without any word is a copy and goes.
* near-duplicates: 256-bit SimHash over distinct five-word shingles names candidates; texts
  whose sets of shingles have a Jaccard similarity of 0.8 or more are united. One row of
  each class stays, the one with the smallest id; of equal ids the one with the smaller hash of
  its text. Rows without a word all stay.
* decontamination: passages of ``benchmark`` items are cut out, rows with more than
  half of their words hit go.
* mixing: every row gets its slot in the Pfair schedule over sources; rows are written
  in that order, with slot, block, release, deadline and place.

``n_chars`` follows the text wherever a stage shortens it. ``ORACLE_SQL`` is None: the
scores of a fitted model cannot be had in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.llm import decontaminate, lines, mixing, simhash, toxicity
from gridload.session import configure, discard, discard_since, made, written

ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``docs``."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _resized(docs: DataFrame, before: str) -> DataFrame:
    """Set ``n_chars`` of rows whose text changed and drop the old text."""
    changed = ~F.col("text").eqNullSafe(F.col(before))
    size = F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return docs.withColumn("n_chars", size).drop(before)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mark = _free(docs, "_toxicity")
    scored = toxicity.score(docs, model, into=mark)
    return scored.filter(F.col(mark)["score"] < toxicity.THRESHOLD).drop(mark)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before, removed = _free(docs, "_before"), _free(docs, "lines_removed")
    cut = lines.remove_repeated_lines(docs.withColumn(before, F.col("text")), into=removed)
    emptied = (F.col(removed) > 0) & ~F.col("text").rlike(r"\S")
    return _resized(cut.filter(~F.coalesce(emptied, F.lit(False))), before).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_similar(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    before = _free(docs, "_before")
    cut = decontaminate.remove_leaks(docs.withColumn(before, F.col("text")), bench)
    return _resized(cut, before).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate_documents),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    previous = None
    for name, stage in STAGES:
        before = made()
        docs = written(stage(spark, docs, sf_dir), name)
        discard_since(spark, before, docs)
        if previous is not None:
            discard(previous)
        previous = docs
    return docs
