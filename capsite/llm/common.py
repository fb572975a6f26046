"""Helpers that the operators share."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from capsite.sources.staging import staged  # noqa: F401

#: Bytes of text that a numpy step handles at once.
PIECE = 1 << 20
LAST_ID = (1 << 63) - 1


def id_key(doc_id: str) -> Column:
    """The id as bigint; null ids come after all others."""
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST_ID))


def text_bytes(text: str) -> Column:
    """UTF-8 of the text; null is empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def int_batch(**columns) -> pa.RecordBatch:
    """A batch of bigint columns from numpy arrays."""
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v).astype(np.int64, copy=False)) for v in columns.values()], list(columns))
