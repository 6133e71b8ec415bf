"""From raw documents to packed training sequences, in five stages.

toxicity: documents that the field rejects go. near_duplicates: one document of each component stays (the one with the
smallest id; of rows of equal id and text the first in the order of their other columns, taken from left to right, nulls
first). substrings: words of repeated passages go. secrets: secrets are replaced by a mark. packing: what is left is dealt to
sequences. Every stage but the last returns the columns of documents, whatever their names: while a stage runs they have names
of their own, so no result of an operator can take the place of one. Only text changes, and n_chars with it. Null texts count as
empty and stay null; rows that are equal in all columns go to one in near_duplicates; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.llm import _base, neardup, packing, secrets, substring, toxicity


class Aside:
    """A table under other names: rows has the columns _0, _1, ...; doc_id and text are the names of those two in it."""

    def __init__(self, docs: DataFrame):
        self.names, self.types = docs.columns, [f.dataType for f in docs.schema]
        self.rows = docs.toDF(*(f"_{i}" for i in range(len(self.names))))
        self.doc_id, self.text = (f"_{self.names.index(c)}" for c in ("doc_id", "text"))

    def back(self, rows: DataFrame) -> DataFrame:
        """The table's own columns of rows, n_chars counted anew."""

        def column(i: int, name: str) -> Column:
            counted = name == "n_chars" and f"_{i}" not in (self.doc_id, self.text)
            return (F.length(self.text).cast(self.types[i]) if counted else F.col(f"_{i}")).alias(name)

        return rows.select(*(column(i, name) for i, name in enumerate(self.names)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = Aside(docs)
    known = own.rows.select(F.col(own.doc_id).alias("doc_id"), F.col(own.text).alias("text"))
    field = toxicity.fit(known, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score(own.rows, field, own.doc_id, own.text).where("toxicity < 0.5")
    return kept.select(*own.rows.columns).toDF(*own.names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = Aside(docs)
    found = neardup.near_duplicates(own.rows, doc_id=own.doc_id, text=own.text)
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    keyed = own.rows.withColumns({"id": F.col(own.doc_id).cast("long"), "key": _base.text_key(own.doc_id, own.text)})
    rows = keyed.join(kept, (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    # Maps and variants have no order of their own: their text stands for them.
    order = [F.col(c).cast("string") if any(x in t for x in ("map<", "variant")) else F.col(c) for c, t in own.rows.dtypes if c != own.text]
    one = rows.groupBy("id", "key").agg(F.min_by(F.struct(*own.rows.columns), F.struct(*order)).alias("row"))
    return one.select(*(F.col(f"row.{c}").alias(name) for c, name in zip(own.rows.columns, own.names, strict=True)))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = Aside(docs)
    return own.back(substring.remove_repeats(own.rows, doc_id=own.doc_id, text=own.text))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = Aside(docs)
    found = secrets.scan(own.rows, doc_id=own.doc_id, text=own.text)
    return own.back(found.withColumn(own.text, secrets.redact(F.col(own.text), F.col("secret_spans"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Neither the trained field nor the packing can be said in SQL; tests hold every stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. What a stage has written for itself, and its input, is deleted when its output stands; the last stage's is not, as its result is read later."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        since = _base.mark()
        docs = _base.save(stage(spark, docs, sf_dir), f"stage-{name}")
        _base.sweep(spark, since, docs)
        if before is not None:
            _base.release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
