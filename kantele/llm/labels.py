"""A bounded sample of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

#: Labelled documents that a fit sees at most; the broadcast of their ids has this bound.
SAMPLE = 10_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, where=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents, lowest id hash first.

    Rows without an id or a label are left out, as are ids with labels that disagree.
    Of documents that share an id the text with the least hash stands for it (a null
    text only if there is no other), so that the bound holds for rows as it does for
    ids. ``where`` is a condition on doc_id. Other columns take no part; empty tables
    give no row.
    """
    known = columns(labels, doc_id=id_col, label=label).where("doc_id is not null and label is not null")
    known = known.where(where) if where is not None else known
    known = known.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # Before the texts meet, each task has picked its own least text of an id.
    found = columns(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
    order = F.struct(F.col("text").isNull(), F.xxhash64("text"), F.col("text"))
    return found.groupBy("doc_id").agg(F.min_by("text", order).alias("text"), F.first("label").alias("label"))
