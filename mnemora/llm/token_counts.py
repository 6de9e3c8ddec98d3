"""Token counts with the whole-token shortcut.

Before any text is read, the driver proves which vocabulary strings encode alone as one token. Tasks count
pre-tokens found in that set (its size is the vocabulary's) directly and merge only the rest.

Edge cases: null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as the
library's default has it; repeated rows each get a row; empty in, empty out.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.shared import only, utf8
from mnemora.llm.tokens import Counter, proven_whole

_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 2048, at_once: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, row by row: no shuffle."""
    whole = docs.sparkSession.sparkContext.broadcast(proven_whole(path))

    def run(batches):
        if path not in _counters:
            _counters[path] = Counter(path, whole.value)
        counter = _counters[path]
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                text = part.column("text")
                size = pc.fill_null(pc.cast(pc.binary_length(text), pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(counter.count(utf8(text)))], ["doc_id", "n_bytes", "n_tokens"])

    source = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
