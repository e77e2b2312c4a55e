"""Document sizes in tokens of a byte-level tokenizer: one token per UTF-8 byte, no end mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probloom.schema import plain


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes of a text; 0 for null and for a text without any visible character."""
    return F.when(text.rlike(r"(?U)\S"), F.octet_length(text).cast("long")).otherwise(F.lit(0).cast("long"))


def sized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size) of the documents that are items; source trimmed and in lower case, NULL where blank."""
    source = plain(F.col("source"))
    return documents.select("doc_id", F.when(source != "", source).alias("source"), byte_tokens(F.col("text")).alias("size")).where("size > 0")
