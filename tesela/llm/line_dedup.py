"""Removal of repeated runs of lines by fingerprints of lines, in DataFrame operations only.

Lines are what newlines part, with ASCII white space at both ends left out of the comparison; it parts words too.
Blank lines are never compared or removed. Each document becomes an array of 64-bit line hashes. Runs of MIN_LINES
lines or of MIN_WORDS words that occur at an earlier place (by the document's id, then its text's hash, then the line)
are removed from the later place. A document can repeat itself too, also where the two places overlap: of one line
repeated only the first stays.

Fingerprints are those of winnowing with a window of one: every unit of neighbouring lines that is a run to remove by
itself, which is MIN_LINES lines, or fewer that have MIN_WORDS words together. A line lies in a repeated run exactly
if it lies in a unit that occurred earlier, so runs need no partner and no alignment. A unit is left out where smaller
units inside it cover all its lines. A wider window would choose among the units, and lose those repeats whose units
lead to places that share less.

Each unit's first place in the corpus is found with a partial aggregate, and every later place is joined to that; so a
unit that a third of all documents hold makes one row for each of its places, never a row for a pair of them, and those
rows stay where they are while the unit's first place is sent to them. Units are compared by the 64-bit hashes of all
their lines; those of one or two lines by another 64-bit hash as well, so at least by 128 bits.

Defined results: null and empty texts have no lines to compare. Rows with the same id and the same text are one
document and get the same result; a null id comes first. What an earlier document keeps is never removed from all
places, since each removed line matches an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import join_counted, materialize, text_of, work_path

MIN_LINES = 3
MIN_WORDS = 50
WHITE_SPACE = " \t\n\v\f\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE_SPACE))


def line_table(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row for each document: key (id, hash of the text), two hashes, word counts and numbers of its lines."""
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("at"), trimmed(x).alias("line")))
    rows = rows.select("id", "text_hash", F.filter(lines, lambda x: x["line"] != "").alias("lines"))
    return rows.select(
        F.struct("id", "text_hash").alias("key"),
        F.transform("lines", lambda x: F.xxhash64(x["line"])).alias("hashes"),
        F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x["line"])).alias("seconds"),
        F.transform("lines", lambda x: F.size(F.split(x["line"], f"[{WHITE_SPACE}]+"))).alias("words"),
        F.transform("lines", lambda x: x["at"]).alias("numbers"),
    )


def fingerprints(lines: DataFrame) -> DataFrame:
    """(hash0, hash1, .., key, at): each unit's line hashes, then second hashes, and the numbers of its lines."""
    n = F.size("hashes")

    def enough(i, size):
        """Whether the size lines from i on have MIN_WORDS words."""
        words = F.get("words", i)
        for k in range(1, size):
            words = words + F.get("words", i + k)
        return words >= MIN_WORDS

    def unit(i, size):
        """The size lines from i on, if they are a unit; else null."""
        whole = F.lit(True) if size == MIN_LINES else enough(i, size)
        if size > 1:
            # Units of one line fewer on both sides, or what covers them, cover all lines.
            whole = whole & ~(enough(i, size - 1) & enough(i + 1, size - 1))
        hashes = [F.get("hashes", i + k) for k in range(size)]
        if size < MIN_LINES:
            hashes.append(F.xxhash64(*(F.get("seconds", i + k) for k in range(size))))
        hashes += [F.lit(0).cast("bigint")] * (MIN_LINES - len(hashes))
        named = [h.alias(f"hash{k}") for k, h in enumerate(hashes)]
        return F.when((i + size <= n) & whole, F.struct(*named, F.slice("numbers", i + 1, size).alias("at")))

    units = F.transform("hashes", lambda _, i: F.array(*(unit(i, size) for size in range(1, MIN_LINES + 1))))
    units = F.filter(F.flatten(units), lambda u: u.isNotNull())
    return lines.select("key", F.explode(units).alias("u")).select("u.*", "key")


def repeated_lines(lines: DataFrame, path: str) -> DataFrame:
    """(key, removed): numbers of the lines to remove, some more than once, for documents that have some.

    path: for the first places of the units that occur again.
    """
    prints = fingerprints(lines).withColumn("place", F.struct("key", F.get("at", F.lit(0)).alias("line")))
    unit = [f"hash{k}" for k in range(MIN_LINES)]
    first = (
        prints.groupBy(*unit)
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(*unit, "first", "n")
    )
    first = materialize(first, path)
    repeated = first.agg(F.sum("n")).first()[0] or 0
    later = join_counted(prints, first, unit, "n", repeated, "merge").where(F.col("place") != F.col("first"))
    return later.groupBy("key").agg(F.flatten(F.collect_list("at")).alias("removed"))


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, text): each row's text without its repeated runs."""
    spark = docs.sparkSession
    # One row a document, by key: equal rows would meet each other on every alignment.
    lines = line_table(docs, id_column, text_column).dropDuplicates(["key"])
    lines = materialize(lines, work_path(spark, "lines"))
    removed = repeated_lines(lines, work_path(spark, "first-places")).select(
        F.col("key.id").alias("id"), F.col("key.text_hash").alias("text_hash"), "removed"
    )
    text = text_of(text_column)
    # Split below the join: above it, each lookup of a line would split the text anew.
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.split(text, "\n", -1).alias("lines"), F.xxhash64(text).alias("text_hash")
    )
    same = rows["doc_id"].eqNullSafe(removed["id"]) & (rows["text_hash"] == removed["text_hash"])
    # The documents with runs grow with the corpus, so they are never broadcast, however few a small corpus has.
    rows = rows.join(removed.hint("merge"), same, "left").select("doc_id", "lines", "removed")
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    kept = F.when(F.col("removed").isNull(), F.col("lines")).otherwise(
        F.transform(numbers, lambda i: F.get("lines", i))
    )
    filled = lambda lines: F.size(F.filter(lines, lambda x: trimmed(x) != "")).cast("bigint")
    rows = rows.select("doc_id", filled("lines").alias("n_lines"), kept.alias("kept"))
    return rows.select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - filled("kept")).alias("n_removed"),
        F.array_join("kept", "\n").alias("text"),
    )
