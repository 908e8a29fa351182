"""Line dedup by overlapping windows of consecutive lines, with DataFrame functions only.

Every run of ``width`` consecutive lines is hashed (128 bits). A window that occurs more than once anywhere keeps its
first occurrence; the lines that later occurrences cover are removed: the starts of a document's later windows are put
in order, and what lies between them is kept in stretches, so the work is linear in a text's lines. Since an occurrence is only ever removed for the
sake of an earlier one, every removed line survives somewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NAMED, pick, wrap, written


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with ``text`` cut and with ``n_lines`` and ``n_removed`` added.

    Occurrences are ordered by doc_id (null last), a hash of the text and the line's place. Rows of equal doc_id and
    text are one document that is stored more than once: they get the same result. Lines are what stands between
    newlines; texts of fewer than ``width`` lines, empty and null texts stay as they are (null: n_lines 0). A text
    whose every line goes becomes empty and its row stays. Columns named n_lines or n_removed are replaced; no other
    column clashes. An empty table gives no rows.
    """
    columns = docs.columns
    docs = wrap(docs)
    lines = F.split("text", "\n", -1)
    base = pick(docs, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("doc_hash"), lines.alias("lines")).where(F.size("lines") >= width)
    at = lambda i: F.xxhash64(*[F.get("lines", i + k) for k in range(width)])
    at2 = lambda i: F.xxhash64(F.lit(1), *[F.get("lines", i + k) for k in range(width)])
    spans = F.transform(F.sequence(F.lit(0), F.size("lines") - width), lambda i: F.struct(i.alias("line"), at(i).alias("h1"), at2(i).alias("h2")))
    windows = base.select("doc_id", "doc_hash", F.explode(spans).alias("w")).select("doc_id", "doc_hash", "w.line", "w.h1", "w.h2").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "doc_hash", "line")
    # written: the join below then has plain exchanges on both sides, which adaptive execution splits where a window is hot
    first = written(windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first"), "first-windows")
    later = windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("doc_id", "doc_hash").agg(F.array_sort(F.collect_set("line")).alias("starts"))
    # starts in order; between the end of one window's lines and the next start lies a stretch of lines that stay
    before = F.concat(F.array(F.lit(-width)), F.slice("starts", 1, F.size("starts") - 1))
    kept_runs = F.zip_with(before, "starts", lambda a, b: F.struct((a + width).alias("from"), (b - a - width).alias("n")))
    gone = starts.select(
        F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash"),
        F.filter(kept_runs, lambda r: r["n"] > 0).alias("__runs"), (F.element_at("starts", -1) + width).alias("__rest"),
    )
    out = docs.withColumn("__text_hash", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    pieces = F.concat(F.col("__runs"), F.array(F.struct(F.col("__rest").alias("from"), (F.size("__lines") - F.col("__rest")).alias("n"))))
    out = out.withColumn("__lines", lines)
    stay = F.flatten(F.transform(pieces, lambda r: F.slice("__lines", r["from"] + 1, r["n"])))
    out = out.withColumn("__stay", F.when(F.col("__runs").isNotNull(), stay))
    kept = F.when(F.col("__stay").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "__stay"))
    total = F.coalesce(F.when(F.col("text").isNotNull(), F.size("__lines")), F.lit(0)).cast("long")
    removed = F.coalesce(F.size("__lines") - F.size("__stay"), F.lit(0)).cast("long")
    own = [(kept if c == "text" else F.col(c if c in NAMED else f"__c{i}")).alias(c) for i, c in enumerate(columns) if c not in ("n_lines", "n_removed")]
    return out.select(*own, total.alias("n_lines"), removed.alias("n_removed"))
