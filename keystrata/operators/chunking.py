"""Texts for embedding: cleaned, cut into overlapping windows of words, and named by their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned(text: Column) -> Column:
    """Runs of blanks as one space, at most two line breaks in a row, nothing at the ends."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, "^[ \n]+|[ \n]+$", "")


def chunks(df: DataFrame, id_column: str, text: str, size: int = 200, overlap: int = 40) -> DataFrame:
    """(id, doc, idx, chunk): windows of size words, each overlap words into the last; id is doc:idx:md5. Texts without words have none."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is at least 0 and less than the size")
    step = size - overlap
    words = F.filter(F.split(cleaned(F.col(text)), "[ \n]+"), lambda w: w != "")
    d = df.select(F.col(id_column).alias("doc"), words.alias("words")).filter(F.size("words") > 0)
    # the last window is the first that reaches the end
    last = F.greatest(F.ceil((F.size("words") - size) / F.lit(step)), F.lit(0))
    d = d.select("doc", "words", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("idx"))
    d = d.withColumn("chunk", F.array_join(F.slice("words", (F.col("idx") * step + 1).cast("int"), F.lit(size)), " "))
    name = F.concat_ws(":", F.col("doc").cast("string"), F.col("idx").cast("string"), F.substring(F.md5("chunk"), 1, 12))
    return d.select(name.alias("id"), "doc", "idx", "chunk")
