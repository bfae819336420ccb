"""Token counts of whole texts by a compiled transducer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, map_arrow, slices
from .transducer import compiled


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row; no shuffle.

    A null or empty text has no tokens; repeated rows are counted again; a null doc_id stays null; other columns are
    left out. A worker holds some MB of texts, their distinct chunks and the transitions and pairs compiled so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys = column(batch, "doc_id")
            for a, texts in slices(batch, limit=4 << 20):
                n = compiled(tokenizer).counts(texts)
                yield {"doc_id": keys.slice(a, len(texts)), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
