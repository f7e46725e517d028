"""Token counts of whole texts, by overlap resynchronisation for long ones (see tokens.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from surveyq.llm.common import tuned, with_text_batches
from surveyq.llm.tokens import WordCounts, loaded, read_vocabulary


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text as the tokenizers library counts them.

    vocabulary is the path of a tokenizers .json file, read on the driver.
    Special tokens' strings inside a text are handled as the library does by
    default; none is added. Returns id, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit).

    Null and empty texts have 0 bytes and tokens; a null id is kept; equal
    texts count alike. Only id and text are read; an empty table gives none.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(WordCounts, source.value)
        for batch, texts in with_text_batches(batches, "text"):
            counts = np.array([tokenizer.count(texts.bytes_of(i).decode()) for i in range(len(texts))], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(texts.bounds)), pa.array(counts), pa.array(counts > limit)],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)[id_col]
    tuned(docs.sparkSession)
    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
