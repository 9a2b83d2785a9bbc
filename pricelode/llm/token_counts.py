"""Token counts of whole texts by the whole-token shortcut."""

import os

import pandas as pd
from pyspark.sql import functions as F

from .common import small_batches
from .word_tokens import worker_encoder

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def count_tokens(docs, tokenizer_path, id_col="doc_id", text_col="text", limit=2048):
    """Per row: id_col, n_bytes, n_tokens and over_limit (more than `limit` tokens).

    A null text counts as empty: 0 bytes, 0 tokens. Rows stay as they are, so
    repeated rows give repeated results and an empty table an empty one; further
    columns of docs, whatever their names, are ignored. Special strings inside a
    text count as their one token each, which is the library's default.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_encoder(tokenizer_path, len, sum)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": encoder.batch(batch["text"].tolist())})

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    counted = narrow.mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_whole_token_counts(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
