"""Line de-duplication by winnowing over line hashes.

The lines of a document (trimmed of white space, blank ones aside) give a row of hashes with word counts.  A window
starts at every line and ends where it holds `min_words` words, and another ends at every line and starts where it
holds as many.  A window's fingerprint is its smallest line hash (the first of equal ones).  Any run of lines of
`min_words` words or more is made up of such windows, and a window depends on its own lines only, so a run that stands
in two places has the same fingerprints at the same lines of both: they are guaranteed.

Positions of fingerprints are joined by hash; a fingerprint that stands at one position only drops out.  Around the
others the match is extended both ways, over all lines of the window on either side, and compared by a hash of those
lines: a position meets the first position (in (doc_id, line) order) of each of its extensions, not all others, so the
join gives no pairs within a group however common a fingerprint is.  An extension that stands before is a repeat: its
lines go, and overlapping ones add up to the whole run, in whatever place it stood before.  Every line that goes has
an equal one before it.

Defined cases
-------------
* Null text: no lines; it stays null.  An empty text stays empty.  Blank lines neither match nor go.
* Words are counted by the spaces in a trimmed line.  White space is space, tab, CR, VT and FF.
* Repeats inside one document count too, overlapping ones included.  Of equal rows (doc_id and text) each has the same
  lines removed: copies of a row are no repeats of each other.  Rows that share only a doc_id are ordered by a hash of
  the text.
* A null doc_id sorts first.  Empty tables give empty results.  Very long texts take time in proportion to their lines.
* Other columns stay as they are, whatever their names, except that `text` is replaced and n_lines and n_deleted are
  added and replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import keep, parts

#: A run of lines is a repeat from so many words.
MIN_WORDS = 25
WHITE = " \t\r\v\f"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, pos, h and g (two line hashes) and w (words) of every line that isn't blank."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    # hashed and split in a step of its own: once for each text, not for each line
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.split(text, "\n").alias("lines"))
    lines = lines.select("doc_id", "text_key", F.posexplode("lines").alias("pos", "raw"))
    lines = lines.select("doc_id", "text_key", "pos", trimmed(F.col("raw")).alias("line")).filter("line <> ''")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = lines.select("doc_id", "text_key", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), words.cast("long").alias("w"))
    return lines.repartition(parts(spark), "doc_id", "text_key").dropDuplicates(["doc_id", "text_key", "pos"])


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Every window of `min_words` words: doc_id, text_key, first_line, last_line, mark (the fingerprint), at (its line), and one and two (hashes of all lines)."""
    doc = Window.partitionBy("doc_id", "text_key")
    lines = lines.withColumn("after", F.sum("w").over(doc.orderBy("pos"))).withColumn("before", F.col("after") - F.col("w"))
    on, back = doc.orderBy("before").rangeBetween(0, min_words - 1), doc.orderBy("after").rangeBetween(-(min_words - 1), 0)

    def held(frame: Window) -> Column:
        return F.collect_list(F.struct("h", "pos", "g")).over(frame)

    lines = lines.withColumn("total", F.max("after").over(doc)).withColumn("on", held(on)).withColumn("back", held(back)).withColumn("start", F.min("before").over(back))
    # a window backwards that is full without its last line is another one than the window on from its first line
    both = F.array(F.when(F.col("total") - F.col("before") >= min_words, F.col("on")), F.when(F.col("before") - F.col("start") >= min_words, F.col("back")))
    found = lines.select("doc_id", "text_key", F.explode(F.array_compact(both)).alias("x")).withColumn("m", F.array_min("x"))
    return found.select(
        "doc_id",
        "text_key",
        F.element_at("x.pos", 1).alias("first_line"),
        F.element_at("x.pos", -1).alias("last_line"),
        F.col("m.h").alias("mark"),
        F.col("m.pos").alias("at"),
        F.xxhash64("x.h").alias("one"),
        F.xxhash64(F.lit(1), "x.g").alias("two"),
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key and the first and last line of every window that stands before."""
    found = keep(windows(line_rows(docs), min_words))
    # second keys make Spark deal both sides anew, so that it can split the rows of a very common line or window
    by_mark, by_window = F.pmod("mark", F.lit(1024)), F.pmod("one", F.lit(1024))
    place = F.struct("doc_id", "text_key", "at")
    marks = found.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("mark")
    live = keep(found.withColumn("k", by_mark).join(marks.withColumn("k", by_mark), ["mark", "k"], "left_semi").drop("k", "at"))
    # of each extension around a mark the first place
    place, key = F.struct("doc_id", "text_key", "first_line"), ["mark", "one", "two"]
    firsts = live.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pairs = live.withColumn("k", by_window).join(firsts.withColumn("k", by_window), [*key, "k"]).filter(~place.eqNullSafe(F.col("first")))
    return pairs.select("doc_id", "text_key", "first_line", "last_line")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later repeats; n_lines counts the lines before, n_deleted those that went."""
    runs = repeated_runs(docs, min_words)
    gone = runs.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first_line", "last_line")).alias("runs"))
    # columns of the caller travel in one struct, so that no name can clash
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("own"))
    own = own.withColumn("key", F.xxhash64(F.coalesce("own.text", F.lit(""))))
    out = own.join(gone, own["own.doc_id"].eqNullSafe(gone["doc_id"]) & (own["key"] == gone["text_key"]), "left").select("own", "runs")
    touched = F.col("runs").isNotNull()
    # the lines are a column of their own, so that a text is split once and not for each line
    out = out.withColumn("lines", F.when(touched, F.split("own.text", "\n")))
    blank = F.transform(F.filter(F.transform("lines", lambda x, i: F.struct(trimmed(x).alias("x"), i.alias("i"))), lambda z: z["x"] == ""), lambda z: z["i"])
    # blank lines between the lines of a run stay
    repeated = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first_line"], r["last_line"]))))
    out = out.withColumn("gone", F.array_except(repeated, blank))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(touched, F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).otherwise(F.col("own.text"))
    own_text = F.col("own.text")
    breaks = F.length(own_text) - F.length(F.replace(own_text, F.lit("\n"), F.lit(""))) + 1
    return out.select(
        *[F.col(f"own.`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_deleted")],
        text.alias("text"),
        F.when(own_text.isNull(), 0).otherwise(F.coalesce(F.size("lines"), breaks)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
    )
