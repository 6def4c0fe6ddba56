"""Line dedup in content-defined chunks of lines, with DataFrame functions only.

A text is split at line feeds. A run is a stretch of lines that are all known from elsewhere in the corpus or all not, with
none of more than ``PASSAGE_WORDS`` words; such a long line is a run of its own. A chunk ends where a run ends, and inside a
run after a line where a rolling hash over the hashes of that line and the one before it is 0 modulo ``DIVISOR``, unless
that would leave one line by itself. The hash starts anew with each run. So boundaries follow content: an
inserted line moves no boundary further away than two lines, and a repeated passage is cut alike whatever stands around it.

A chunk that occurs more than once in the corpus and has several lines, or is one such long line, stays where it
occurs first (smallest doc_id, then place) and is removed elsewhere, after its bytes were compared with those that
stay. Single shorter lines are never removed.

Only hashes are shuffled to find chunks: one partial aggregate counts lines, one counts chunks, so a line or
chunk that a third of all documents hold is one row per task. Boundaries are window functions over the lines of a
document, one row a line, so the work is linear in lines. Texts are shuffled twice, to fetch the chunks for
the comparison and to rebuild.

Defined cases: a null text stays null, an empty one empty; a document whose chunks are all removed keeps its row with
an empty text; rows equal in doc_id and text count as one document and get one result each; a null doc_id sorts first, and
so does, of rows equal in doc_id alone, the one with the smaller text hash; a long text is one row a line, whatever its length;
an empty table gives no rows; extra columns pass through unchanged whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.common import stage

DIVISOR, PASSAGE_WORDS = 8, 50
KEY = ["doc_id", "text_key"]


def number(text: Column) -> Column:
    """60 bits of the md5 digest of a string."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def chunk_table(lines: DataFrame, divisor: int) -> DataFrame:
    """(doc_id, text_key, start, size, chunk) of the repeated chunks a document could lose.

    ``lines`` has one row per line: place, hash, whether the line is known from elsewhere and whether it is long.
    """
    order = Window.partitionBy(*KEY).orderBy("place")
    known, long, number = F.col("known"), F.col("long"), F.col("hash") % 1000003
    # The window functions of one document share one sort; the ends of a run are always boundaries.
    run = lines.withColumn("run_ends", F.coalesce((known != F.lead("known").over(order)) | long | F.lead("long").over(order), F.lit(True)))
    run = run.withColumn("run_starts", F.coalesce(F.lag("run_ends").over(order), F.lit(True)))
    before = F.when(F.col("run_starts"), 0).otherwise(F.lag(number).over(order))
    cut = run.withColumn("cut", F.col("run_ends") | ((before * 31 + number) % divisor == 0))
    lone = F.col("run_starts") | F.lead("cut").over(order)
    ends = cut.withColumn("ends", F.col("run_ends") | (F.col("cut") & ~F.coalesce(lone, F.lit(False))))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    part = ends.withColumn("part", F.coalesce(F.sum(F.col("ends").cast("int")).over(upto), F.lit(0)))
    hashes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"].cast("string")), ",")
    return (
        part.groupBy(*KEY, "part")
        .agg(F.min("place").alias("start"), F.count("*").cast("int").alias("size"), F.bool_and("known").alias("known"), F.bool_or("long").alias("long"), F.md5(hashes.cast("binary")).alias("chunk"))
        .where("known AND (size > 1 OR long)").select(*KEY, "start", "size", "chunk")
    )


def removals(docs: DataFrame, divisor: int = DIVISOR, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, text_key, gone): per document the sorted (start, size) line ranges to remove."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    line = F.col("line")
    long = (F.length(line) > 2 * passage_words) & (F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) > passage_words)
    lines = stage(
        keyed.where(F.col("text").isNotNull()).select(*KEY, F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
        .select(*KEY, "place", number(line).alias("hash"), long.alias("long")),
        "lines",
    )
    # Known from elsewhere means at two places; rows equal in id and text are one document and have the same places.
    at = F.struct(*KEY, "place")
    counted = lines.groupBy("hash").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("hash", F.lit(True).alias("known"))
    marked = stage(lines.join(stage(counted, "known-lines"), "hash", "left").withColumn("known", F.coalesce("known", F.lit(False))), "marked-lines")
    # Dealt by document once: the distinct, the windows and the chunks all keep to it.
    chunks = stage(chunk_table(marked.repartition(*KEY).distinct(), divisor), "chunks")
    repeated = chunks.groupBy("chunk").agg(
        F.count("*").alias("n"), F.min(F.struct(*KEY, "start")).alias("first")
    ).where("n > 1").select("chunk", "first")
    found = chunks.join(repeated, "chunk").select(
        *KEY, F.struct("start", "size", "chunk", F.struct(*KEY, "start").eqNullSafe(F.col("first")).alias("stays")).alias("c")
    )
    wanted = found.groupBy(*KEY).agg(F.collect_set("c").alias("found"))
    texts = stage(
        keyed.join(wanted, same_document(keyed, wanted)).select(keyed["doc_id"], keyed["text_key"], "text", "found")
        .select(*KEY, lines_of(F.col("text")).alias("lines"), F.explode("found").alias("c"))
        .select(*KEY, "c.*", F.array_join(F.expr("slice(lines, c.start + 1, c.size)"), "\n").alias("bytes")),
        "chunk-texts",
    )
    first = texts.where("stays").groupBy("chunk").agg(F.any_value("bytes").alias("bytes"))
    equal = texts.where("NOT stays").alias("t").join(first.alias("f"), "chunk").where("t.bytes = f.bytes")
    return equal.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("gone"))


def without(lines: Column, gone: str) -> Column:
    """The lines outside the ranges of the named column."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(gone)),
        lambda k: F.slice(lines, _after(gone, k) + 1, _next(gone, lines, k) - _after(gone, k)),
    )
    return F.flatten(pieces)


def _after(gone: str, k: Column) -> Column:
    before = F.try_element_at(F.col(gone), F.when(k > 0, k).otherwise(F.lit(None)).cast("int"))
    return F.coalesce(before["start"] + before["size"], F.lit(0)).cast("int")


def _next(gone: str, lines: Column, k: Column) -> Column:
    here = F.try_element_at(F.col(gone), (k + 1).cast("int"))
    return F.coalesce(here["start"], F.size(lines)).cast("int")


def line_dedup(docs: DataFrame, divisor: int = DIVISOR, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_lines, removed_chunks, removed_lines, text (what is left) and row (the document as it was)."""
    gone = removals(docs, divisor, passage_words)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = keyed.join(gone, same_document(keyed, gone), "left").select(keyed["doc_id"], "row", "gone")
    lines = lines_of(F.col("row.text"))
    return joined.select(
        "doc_id",
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("removed_chunks"),
        F.coalesce(F.expr("aggregate(gone, 0L, (a, g) -> a + g.size)"), F.lit(0)).cast("bigint").alias("removed_lines"),
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(without(lines, "gone"), "\n")).alias("text"),
        "row",
    )
