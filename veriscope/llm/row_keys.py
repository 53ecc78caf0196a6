"""Numbers for rows that hold at every reading, and rows chosen by them without moving texts.

A row of a Parquet table is named by its file and its place in it, so that a second pass, or
a task that runs again elsewhere, gives it the same number.  A choice of rows is kept as bits,
4096 rows a line, and laid beside the scan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope.shared import MAX_BROADCAST_BYTES, broadcast_if_small, settle

PLACE_BITS = 40  # rows of a file, as a power of two
LINE_BITS = 12  # rows of a line of bits
LINE_BYTES = 2048  # more than a line takes


def _as_stored(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``df`` with the file and the place of its rows; written out first if they do not come from Parquet files."""
    try:
        hidden = df.metadataColumn("_metadata")
        df.select(hidden["row_index"]).schema
    except AnalysisException:
        df = settle(df)
        hidden = df.metadataColumn("_metadata")
    return df, hidden["file_path"], hidden["row_index"]


def keyed(df: DataFrame) -> DataFrame:
    """``_row``, the row's number, and ``_given``, its columns in one struct: none of them can
    clash with a name used beside it."""
    stored, path, place = _as_stored(df)
    # one row per file
    files = stored.select(path.alias("_path")).distinct().select(
        "_path", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_path")) - 1).cast("long").alias("_no"))
    rows = stored.select(path.alias("_path"), place.alias("_place"), F.struct(*[stored[c] for c in df.columns]).alias("_given"))
    number = F.shiftleft("_no", PLACE_BITS).bitwiseOR(F.col("_place"))
    return rows.join(broadcast_if_small(settle(files)), "_path").select(number.alias("_row"), "_given")


def marked(rows: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """Add ``name``: whether the row's ``_row`` is among those of ``chosen``.

    Lines of bits are broadcast if they are small (some 130 million rows); a larger table is
    joined by line, which then moves the rows.
    """
    words = chosen.groupBy(F.shiftright("_row", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_row & 63 AS INT))")).alias("_bits"))
    entry = F.struct(F.expr("CAST(_word & 63 AS INT)").alias("at"), "_bits")
    lines = settle(words.groupBy(F.shiftright("_word", LINE_BITS - 6).alias("_line")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_words")), compact=True)
    if lines.count() * LINE_BYTES <= MAX_BROADCAST_BYTES:
        lines = F.broadcast(lines)
    placed = rows.withColumn("_line", F.shiftright("_row", LINE_BITS)).join(lines, "_line", "left")
    bits = F.coalesce(F.try_element_at("_words", F.expr("CAST((_row >> 6) & 63 AS INT)")), F.lit(0).cast("long"))
    return placed.select(*rows.columns, (F.getbit(bits, F.expr("CAST(_row & 63 AS INT)")) == 1).alias(name))
