"""Complete page records of a stream: the operators are projections, so they need no state and no watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.audit import complete_records


def stream_records(pages: DataFrame, as_of: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the records of ``pages``, a stream of fetched pages, to ``path`` as they come; all that is there at once."""
    return complete_records(pages, as_of).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
