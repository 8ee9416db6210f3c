"""Streams of queries and of new base rows, against a static model; stateless, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vexel.operators import search
from vexel.operators.ti import Index
from vexel.operators.training import Vaq


def answer(queries: DataFrame, model: Vaq, codes: DataFrame, k: int, path: str, checkpoint: str, base: DataFrame | None = None, refine: int = 0, index: Index | None = None) -> StreamingQuery:
    """Writes the neighbours of a stream of (query_id, qe) to ``path``; with ``refine``, so many candidates are ordered by exact distance.

    A model that searches by TI needs the ``index`` of the codes.
    """

    def batch(rows: DataFrame, number: int) -> None:
        found = model.search(rows, codes, max(k, refine), index=index)
        if base is not None and refine >= k:
            found = search.reranked(found, rows, base, k, max(k, refine))
        # A batch that runs again writes the same folder anew.
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(rows: DataFrame, model: Vaq, path: str, checkpoint: str) -> StreamingQuery:
    """Encodes a stream of (vec_id, e) and adds the codes to ``path``."""

    def batch(part: DataFrame, number: int) -> None:
        model.encode(part).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
