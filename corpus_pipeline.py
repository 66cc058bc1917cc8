"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Other columns, of any
name, are carried along. Null ids and null, empty and very long texts, ties and repeated rows have the results that the stages' operators
state; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm import minhash, packing, secrets, substrings, toxicity
from rillgraph.runtime import Scratch, table


def _own(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by their places, so that no name clashes with an operator's, and the new names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier takes for toxic; it is fitted on the labelled documents of ``sf_dir``.

    Every row is judged by its whole text, a null one as empty; repeated rows share their fate. Ids do not matter.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    own, names = _own(docs)
    scored = toxicity.score(own, model, names["text"], carry=own.columns)
    return scored.where("score < 0.5").drop("score").toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Rows with null ids or without words stay."""
    return minhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of 20 words that occur earlier. Documents that lose all their words go; those that came without words stay."""
    return substrings.remove_repeats(docs, emptied=False)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With every secret replaced by a mark; no document goes. Null texts stay null; n_chars is counted anew where a text changes."""
    own, names = _own(docs)
    found, text = secrets.scan(own, names["text"], carry=own.columns), names["text"]
    new = F.when(F.size("spans") > 0, secrets.redacted(F.col(text), F.col("spans"))).otherwise(F.col(text))
    cols = dict.fromkeys(names.values())
    if "n_chars" in names:
        cols[names["n_chars"]] = F.when(F.size("spans") > 0, F.length("new")).otherwise(F.col(names["n_chars"])).cast(docs.schema["n_chars"].dataType)
    cols[text] = F.col("new")
    return found.withColumn("new", new).select(*[(F.col(c) if x is None else x).alias(c) for c, x in cols.items()]).toDF(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1024 tokens. A null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_copies), ("substring_dedup", cut_repeats), ("secrets", redact_secrets), ("packing", pack_windows)]

#: No stage but the fourth can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before it are written to the shared folder."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
