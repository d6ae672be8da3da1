"""A corpus pipeline over ``documents``: filter, deduplicate, clean and pack.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame that is
written and read again as the next one's ``docs``. All but the last return the columns of
``documents``. Stages judge their own input as a whole: models are trained and counts are made
over the rows that reach them. A stage's result may read working tables; whoever calls the stage owns
them (``common.recorded``), else they go when the application ends. ``run`` deletes them as it goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.llm import jaccard_join, queries, secret_scan, suffix_dedup, toxicity
from tilefold.llm.common import delete, recorded, scratch, table, written

#: Documents with this score or more are rejected as toxic.
TOXIC = 0.3
#: Near duplicates: five-word shingles, Jaccard similarity of 0.8 or more.
NEAR = jaccard_join.Rule(width=5, percent=80)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with(docs: DataFrame, out: DataFrame, changed: F.Column, text: F.Column) -> DataFrame:
    """The columns of ``docs``, held in ``out`` as the struct ``row``, with another text and its length where it is changed."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[F.when(changed, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _as_row(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` for an operator, and all columns as the struct ``row``, so that none clashes with its results."""
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is ``TOXIC`` or more go; all others stay as they are.

    Null and empty texts are scored as texts without evidence; rows with a null id are scored and
    not learnt from; repeated rows get equal scores; an empty table gives an empty table; labels of
    other documents are not used.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_as_row(docs), model, keep=("row",), text_col="row.text").where(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the smallest id (nulls last).

    Rows that repeat a document are one document, and a row whose id is that of another document is
    judged by its own text. Null and empty texts are nobody's duplicates, so all such rows stay; an
    empty table gives an empty table; extra columns are kept.
    """
    return jaccard_join.representatives(docs, NEAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out; untouched rows stay as they are.

    A character stays if any of its bytes does. No row goes; null texts stay null, and a text of
    which nothing is left is empty. A null id counts as larger than all others; rows of equal ids
    leave each other alone; an empty table gives an empty table; extra columns are kept.
    """
    out = suffix_dedup.dedup(_as_row(docs), keep=("row",), whole_characters=True)
    return _with(docs, out, F.size("spans") > 0, F.decode(F.col("kept"), "UTF-8"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by ``[kind]``; rows without one stay as they are.

    No row goes; null texts stay null and empty ones empty; repeated rows and rows with null ids
    are treated as any other; an empty table gives an empty table; extra columns are kept.
    """
    out = secret_scan.find_secrets(_as_row(docs), keep=("row",))
    return _with(docs, out, F.size("spans") > 0, F.col("redacted"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences that hold every id of every row once.

    Null and empty texts are documents of the end id alone; repeated rows are packed each; null ids
    stay null; an empty table gives no pieces; other columns are left out.
    """
    return queries.packed_pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the working tables of each go as soon as its rows are stored, and those rows once the next ones are."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        now: list[str] = []
        with recorded(now), scratch(spark):
            docs = written(step(spark, docs, sf_dir), name, lasting=True)
        delete(spark, before)
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and tokenizers are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
