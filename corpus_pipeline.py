"""The corpus pipeline: stages over the documents table, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.llm import lines, packing, quality, simhash, toxicity
from inkmark.llm.common import stored, table
from inkmark.llm.queries import tokenizer_path

#: Rows that an executor hands to Python at once. Whole texts go there: Spark's 10,000 rows are tens of megabytes for
#: each task and direction, outside of the heap, and as much again in Python.
ROWS_AT_ONCE = 1_000


def _small_batches(spark: SparkSession) -> None:
    """Batches of ROWS_AT_ONCE at most, for this session: plans read the setting when they run. A lower one stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.

    Null and empty texts and null ids stay, repeated rows stay or go together, an empty table gives none; texts are
    scored whole and columns may have any names.
    """
    _small_batches(spark)
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy's rules reject go: null and empty texts among them, null ids by their text.

    Repeated rows stay or go together, an empty table gives none; texts are measured whole, columns may have any names.
    """
    return quality.kept(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines the first, by id and place, stays; n_chars follows the text.

    Null and empty texts and rows without an id stay as they are, rows that share an id lose the same places, an empty
    table gives none. Lines are compared whole; columns may have any names, as the counters take free ones.
    """
    _small_batches(spark)
    n_lines, n_gone = (next(n for n in (x + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns) for x in ("lines", "gone"))
    found = lines.deduplicated(docs, counts=(n_lines, n_gone))
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col(n_gone) > 0, n).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id.

    Null and empty texts are of one group, rows without an id stay, of rows that share an id one stays, an empty table
    gives none. Texts are read whole; columns may have any names.
    """
    _small_batches(spark)
    return simhash.kept(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences.

    Null and empty texts have the closing id alone, rows with a null id or a repeated one are packed as rows of their
    own, an empty table gives none. Texts are encoded whole; columns may have any names.
    """
    _small_batches(spark)
    return packing.pack(docs, tokenizer_path(), **packing.PRODUCTION).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: Learned scores, fingerprints and a tokenizer: not in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
