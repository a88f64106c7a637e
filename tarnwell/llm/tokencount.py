"""Token counts with a whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwell.llm.bpe import WholeWords, prove_whole_tokens
from tarnwell.llm.common import rows_of


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, over whole texts; null counts as the empty text, 0 tokens.

    The strings that encode alone as one token are proven once, on the driver, and sent along (their number is
    bounded by the vocabulary). Workers count those directly and merge the rest. One pass, no shuffle.
    Repeated rows are alike; an empty table gives an empty result; other columns are ignored, whatever their names.
    The tokenizer's file must be at ``tokenizer_path`` on every machine.
    """
    proven = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(tokenizer_path))

    def run(batches):
        words = WholeWords(tokenizer_path, proven.value)
        for batch in batches:
            for part in rows_of(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = words.counts(texts)
                size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("_id", id_col)
