"""Auditing documents as they arrive.

The operators that judge one document at a time keep no state between documents, so
each micro-batch is audited as a table of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusward.functions.lineage import cut
from corpusward.operators import hygiene
from corpusward.operators.report import merge_reports
from corpusward.sources import documents


def document_audit(facts: hygiene.Facts, standard: str) -> Callable[[DataFrame], DataFrame]:
    """Parse and hygiene findings of a table of documents (doc_id, text)."""

    def audit(docs: DataFrame) -> DataFrame:
        nodes = cut(documents.to_nodes(docs))
        return merge_reports(documents.parse_findings(nodes, standard), hygiene.hygiene(documents.parsed(nodes), facts, standard))

    return audit


def audit_stream(stream: DataFrame, audit: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start auditing ``stream``; findings of micro-batch n are the folder ``epoch=n`` under ``path``.

    A batch that runs again after a failure replaces its folder, so each document's
    findings are there once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        audit(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
