"""Decoders as SQL table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillspark.sources import records
from quillspark.sources.layouts import RecordError


@udtf(returnType="seq bigint, tag int, level int, size bigint, payload binary, error string")
class FrameRecords:
    """Records of a stream's bytes; one that is cut off gives its whole records and a row with an error, null gives nothing."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        seq = 0
        try:
            for seq, (tag, level, payload) in enumerate(records.frame(data or b""), 1):
                yield seq - 1, tag, level, len(payload), payload, None
        except RecordError as e:
            yield seq, None, None, None, None, str(e)


def register(spark: SparkSession) -> None:
    """Makes ``frame_records(bytes)`` known to SQL: ``select s.doc, r.* from streams s, lateral frame_records(s.data) r``."""
    spark.udtf.register("frame_records", FrameRecords)
