"""Keep a segmented search index in step with a stream of changed products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelfseek.operators.documents import documents_for, without
from shelfseek.plans import segments


def sync_stream(changes: DataFrame, tables: Callable[[], tuple[DataFrame, ...]], root: str, checkpoint: str,
                embed: Callable[[DataFrame], DataFrame] | None = None,
                trigger: dict | None = None) -> StreamingQuery:
    """Write the documents of every batch of changed ids as one segment of the index at ``root``.

    ``tables`` gives products, details and the three taxonomy tables as of now;
    ids without a product any more are deleted. ``embed`` gets the batch's ids
    and returns new vectors of some of them, which go into the same segment. A
    repeated batch writes the same rows again, so reading is not changed by it.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select("product_id").filter("product_id is not null").distinct()
        if ids.isEmpty():
            return
        products, *others = tables()
        known = products.selectExpr("id as product_id")
        segments.change(batch.sparkSession, root, documents=documents_for(ids, products, *others),
                        embeddings=None if embed is None else embed(ids), deleted=without(ids, known))

    return (changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
