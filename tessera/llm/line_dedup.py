"""Line dedup: drop lines that many documents share (DataFrame functions only).

Every text is split at ``\\n``, every line normalised to a key (white space
stripped at both ends, A-Z lower-cased) and hashed to 128 bits.  The distinct
documents of each hash are counted; lines whose hash reaches the threshold go
from every document, and the rest is put together again by position.

Shuffles carry hashes and positions, never line texts; the text itself moves
once, in the join that brings the positions to drop back to the documents.
The count drops repeats of (key, document) first, spread over both, so a line
of a third of all documents meets one task only as partial sums.  The frequent
hashes are written as a table of their own, so the semi join that follows is a
broadcast where the table is below Spark's size limit, and else one with an
exchange on either side, which adaptive execution can split.

Defined cases: a null or empty text is one empty line; an empty key is never
counted or dropped below ``min_chars`` = 1.  A document is a distinct id (null
is one id), so a row that repeats an id does not count twice; each row still
yields one row.  Columns named like the outputs are replaced; others pass
through.  An empty table yields an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, ascii_lower, materialise, without


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points: id, text tag, position, key hash."""
    text = F.col(f"`{text_col}`")
    lines = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.xxhash64(text).alias("_tag"),
        F.posexplode(_lines(ascii_lower(text))).alias("_pos", "_line"),
    ).withColumn("_key", F.btrim("_line", F.lit(WHITE)))
    return lines.filter(F.char_length("_key") >= min_chars).select(
        "_id",
        "_tag",
        "_pos",
        F.xxhash64("_key").alias("_h1"),
        F.xxhash64(F.lit("second"), "_key").alias("_h2"),
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
) -> DataFrame:
    """``docs`` with ``text_col`` rid of the lines whose key occurs in ``min_docs`` documents or more.

    Adds ``n_lines`` (before) and ``n_dropped``.
    """
    lines = line_table(docs, id_col, text_col, min_chars)
    frequent = (
        lines.select("_h1", "_h2", "_id").distinct().groupBy("_h1", "_h2").count().filter(F.col("count") >= min_docs)
    )
    frequent = materialise(frequent.select("_h1", "_h2"), "frequent-lines")
    cuts = (
        lines.join(frequent, ["_h1", "_h2"], "left_semi")
        .groupBy("_id", "_tag")
        .agg(F.array_sort(F.collect_set("_pos")).alias("_cuts"))
    )
    base = without(docs, "n_lines", "n_dropped")
    text = F.col(f"`{text_col}`")
    joined = base.withColumn("_doc_tag", F.xxhash64(text)).join(
        cuts, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_doc_tag") == F.col("_tag")), "left"
    )
    # the stretches between two cuts, so that long documents with many cuts stay linear
    bounds = F.concat(F.array(F.lit(-1)), F.col("_cuts"), F.array(F.size("_split")))
    stretches = F.transform(
        F.sequence(F.lit(1), F.size("_bounds") - 1),
        lambda i: F.slice(
            F.col("_split"),
            F.element_at("_bounds", i) + 2,
            F.element_at("_bounds", i + 1) - F.element_at("_bounds", i) - 1,
        ),
    )
    out = (
        joined.withColumn("_split", _lines(text))
        .withColumn("_bounds", F.when(F.col("_cuts").isNotNull(), bounds))
        .withColumn(
            "_kept",
            F.when(F.col("_cuts").isNull(), F.coalesce(text, F.lit(""))).otherwise(
                F.array_join(F.flatten(stretches), "\n")
            ),
        )
        .withColumn("n_lines", F.size("_split").cast("long"))
        .withColumn("n_dropped", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size("_cuts")).cast("long"))
    )
    columns = [F.col("_kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in base.columns]
    return out.select(*columns, "n_lines", "n_dropped")
