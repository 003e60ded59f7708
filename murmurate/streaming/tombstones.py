"""Removal of documents that are gone at their source: a probe queue, a ledger, deletes that later loads honour, and receipts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import REMOVED
from ..sources.staging import staged
from ..sources.upserts import delete_from, read_table, upsert_into

LEDGER = "doc_id {kind}, rows long, brands array<string>, reason string, detected_at timestamp, purged_at timestamp, revalidated_at timestamp"


def probe_queue(mentions: DataFrame, checked: DataFrame, doc: str, loaded: str, limit: int) -> DataFrame:
    """The documents to look up next: those never checked first, then the least recently checked, then the first loaded.

    ``checked`` has ``doc`` and ``checked_at``; every document that was probed is in it, those that live included,
    or the same head of the queue would be served for ever.
    """
    last = checked.groupBy(doc).agg(F.max("checked_at").alias("checked_at"))
    docs = mentions.groupBy(doc).agg(F.min(loaded).alias("__loaded"))
    return docs.join(last, doc, "left").orderBy(F.asc_nulls_first("checked_at"), F.asc_nulls_first("__loaded"), doc).limit(limit).select(doc, "checked_at")


def verdicts(queue: DataFrame, answers: DataFrame, doc: str, body: str, author: str, answered: DataFrame | None = None) -> DataFrame:
    """``doc`` and ``gone`` of the probed documents: those without an answer, blanked out or without an author are gone.

    ``answered`` lists the documents of the requests that came back; others are neither gone nor checked.
    """
    live = answers.where(~F.coalesce(F.col(body).isin(*REMOVED) | (F.col(author) == "[deleted]"), F.lit(False))).select(doc).distinct()
    asked = queue.select(doc).distinct() if answered is None else queue.select(doc).distinct().join(answered.select(doc).distinct(), doc, "left_semi")
    return asked.join(live.withColumn("__live", F.lit(True)), doc, "left").select(doc, F.col("__live").isNull().alias("gone"))


@dataclass(frozen=True)
class Tombstones:
    """A table of mentions and the ledger of what was removed from it, both kept by the counting upsert sink.

    The ledger comes first, then the purge, then its stamp: a pass that dies in between leaves rows
    that :meth:`defects` shows and that the next pass ends. ``schema`` and ``keys`` are the mentions'.
    """

    spark: SparkSession
    mentions_path: str
    ledger_path: str
    schema: str
    keys: tuple[str, ...]
    doc: str
    brand: str

    def _ledger_schema(self) -> str:
        fields = T._parse_datatype_string(self.schema)
        return LEDGER.format(kind=fields[self.doc].dataType.simpleString())

    def ledger(self) -> DataFrame:
        return read_table(self.spark, self.ledger_path, self._ledger_schema())

    def mentions(self) -> DataFrame:
        """What is there and not removed: deletes count as soon as they are in the ledger."""
        gone = self.ledger().select(F.col("doc_id").alias(self.doc))
        return read_table(self.spark, self.mentions_path, self.schema).join(gone, self.doc, "left_anti")

    def ingest(self, new: DataFrame) -> dict[str, int]:
        """Inserts what is not there; removed documents that come again are refused (``refused`` rows)."""
        gone = self.ledger().select(F.col("doc_id").alias(self.doc))
        told = staged(new.join(gone.withColumn("__gone", F.lit(True)), self.doc, "left"), "ingest")
        counts = upsert_into(self.mentions_path, told.where("__gone IS NULL").drop("__gone"), list(self.keys), update=False)
        return counts | {"refused": told.where("__gone").count()}

    def remove(self, found: DataFrame, as_of: Column, reason: str = "source_deleted") -> dict[str, int]:
        """One pass over :func:`verdicts`: ledger, purge, stamp. Documents of earlier passes that were not purged are purged now."""
        rows = read_table(self.spark, self.mentions_path, self.schema)
        gone = staged(found.where("gone").select(self.doc).distinct(), "gone")
        hit = rows.join(gone, self.doc, "left_semi").groupBy(F.col(self.doc).alias("doc_id")).agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.col(self.brand).cast("string"))).alias("brands"))
        never = F.lit(None).cast("timestamp")
        new = hit.select("doc_id", "rows", "brands", F.lit(reason).alias("reason"), as_of.cast("timestamp").alias("detected_at"), never.alias("purged_at"), never.alias("revalidated_at"))
        noted = upsert_into(self.ledger_path, new, ["doc_id"], update=False)
        open_ = self.ledger().where("purged_at IS NULL")
        purged = delete_from(self.mentions_path, self.schema, list(self.keys), open_.select(F.col("doc_id").alias(self.doc)))
        upsert_into(self.ledger_path, self.ledger().where("purged_at IS NULL").withColumn("purged_at", as_of.cast("timestamp")), ["doc_id"])
        return {"noted": noted["inserted"], "purged": purged["deleted"]}

    def revalidated(self, docs: DataFrame, as_of: Column) -> dict[str, int]:
        """Stamps the receipt of purged documents whose pages were made anew."""
        done = self.ledger().where("purged_at IS NOT NULL AND revalidated_at IS NULL").join(docs.select(F.col(self.doc).alias("doc_id")).distinct(), "doc_id", "left_semi")
        return upsert_into(self.ledger_path, done.withColumn("revalidated_at", as_of.cast("timestamp")), ["doc_id"])

    def defects(self) -> DataFrame:
        """``doc_id`` and ``defect``: noted but not purged, purged but still in the table, purged but not revalidated."""
        ledger = self.ledger()
        there = read_table(self.spark, self.mentions_path, self.schema).select(F.col(self.doc).alias("doc_id")).distinct()
        unpurged = ledger.where("purged_at IS NULL").select("doc_id", F.lit("not purged").alias("defect"))
        back = ledger.where("purged_at IS NOT NULL").join(there, "doc_id", "left_semi").select("doc_id", F.lit("still there").alias("defect"))
        stale = ledger.where("purged_at IS NOT NULL AND revalidated_at IS NULL").select("doc_id", F.lit("not revalidated").alias("defect"))
        return unpurged.unionByName(back).unionByName(stale)
