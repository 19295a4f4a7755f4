"""Line dedup: content-defined chunks of lines that occur more than once in the corpus are removed after the first.

Everything is a DataFrame or SQL expression; no Python runs on the executors.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: A chunk ends after a line if the hash rolled over so many lines up to it is 0 modulo DIVISOR.
ROLLED, DIVISOR = 4, 4
#: Of the rolling hash: a prime below 2^31, so that no product passes 64 bits, and a factor.
PRIME, FACTOR = 2_147_483_647, 1_103_515_245
#: The query and the pipeline drop a single repeated line too if it has so many words.
LONE_WORDS = 40
#: What can't be told from an empty line.
_BLANK = r"^[\x20\x09-\x0D]*$"
CHUNK, PAIR, LINE = 0, 1, 2


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def rolled(hashes: list[Column]) -> Column:
    """The polynomial of some neighbouring lines' hashes, null if there are fewer lines."""
    own = [F.pmod(h, F.lit(PRIME)) for h in hashes]
    return functools.reduce(lambda r, h: F.pmod(r * F.lit(FACTOR) + h, F.lit(PRIME)), own)


def _of(*columns: str) -> Column:
    """A join key that no aggregation is dealt by, so that both sides of the join are dealt anew and Spark may split what
    is hot."""
    return F.struct(*columns).alias("k")


def hashed_lines(docs: DataFrame) -> DataFrame:
    """Rows (id, th, seq, pos, to, h, p, starts, ends, size), one for each line that isn't blank; docs has id, th, text.

    pos numbers all lines of the document, seq those that aren't blank, to is the next such line's pos plus one. h is
    the line's hash, p that of it and the next. ends: the hash rolled over the last ROLLED lines is 0 modulo DIVISOR, or the
    document ends; starts: the line before ends. So boundaries come from the lines alone and are the same wherever ROLLED
    lines follow each other, whatever stands around them.
    """
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    filled = F.filter(numbered, lambda x: ~x["line"].rlike(_BLANK))
    own = F.transform(filled, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("h"), F.octet_length(x["line"]).alias("size")))
    # Repeated rows become one before lines are rows; those of a document are then together, and no window deals them anew.
    once = docs.where("id is not null and text is not null").select("id", "th", own.alias("x")).dropDuplicates(["id", "th"])
    rows = once.select("id", "th", F.posexplode("x").alias("seq", "x")).select("id", "th", "seq", "x.*")
    by = Window.partitionBy("id", "th").orderBy("seq")
    one, on = F.lag("h").over(by), F.lead("h").over(by)
    rows = rows.withColumn("rolled", rolled([F.lag("h", k).over(by) if k else F.col("h") for k in reversed(range(ROLLED))]))
    cut = F.pmod("rolled", F.lit(DIVISOR)) == 0
    starts, ends = one.isNull() | F.coalesce(F.lag(cut).over(by), F.lit(False)), on.isNull() | F.coalesce(cut, F.lit(False))
    return rows.select("id", "th", "seq", "pos", (F.lead("pos").over(by) + 1).alias("to"), "h", F.when(on.isNotNull(), F.xxhash64("h", on)).alias("p"), starts.alias("starts"), ends.alias("ends"), "size")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """rows whose key occurs more than once, with again: whether an earlier row of that key exists."""
    place = F.struct("id", "th", "seq")
    often = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select(_of(key), "first")
    return rows.withColumn("k", _of(key)).join(often, "k").withColumn("again", place != F.col("first")).drop("k", "first")


def chunks(lines: DataFrame) -> DataFrame:
    """Rows (id, th, seq, n, pos, to, h): the chunks of two lines or more that hold only repeated lines.

    lines has just the repeated lines: a chunk is whole if it begins where a chunk starts, ends where one ends and has
    no gap.
    """
    rows = lines.withColumn("chunk", F.col("start"))
    of = F.transform(F.array_sort(F.collect_list(F.struct("seq", "h"))), lambda x: x["h"])
    whole = rows.groupBy("id", "th", "chunk").agg(F.min("seq").alias("seq"), F.count("*").cast("int").alias("n"), F.min("pos").alias("pos"), (F.max("pos") + 1).alias("to"), F.min_by("starts", "seq").alias("starts"), F.max_by("ends", "seq").alias("ends"), F.xxhash64(of).alias("h"))
    return whole.where("starts and ends and n > 1").select("id", "th", "seq", "n", "pos", "to", "h")


def candidates(docs: DataFrame, lone_words: int | None = None, chunked: bool = True) -> DataFrame:
    """Rows (id, th, kind, seq, n, pos, to, h) of what occurs more than once by its hash; docs has id, th, text.

    First whole chunks. What stands at the ends of a repeated passage shares its chunk with other lines; it is found at
    the finest scale, as pairs of neighbouring lines. Pairs inside a chunk that an earlier one repeats are left out: they
    occur in the earlier one, so what chunks find is neither paired nor compared line by line (chunked: False leaves chunks
    out, to see what they save). Lines long enough for lone_words words are candidates too, but for those in such a chunk.
    """
    lines = checkpointed(hashed_lines(docs))
    often = lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(_of("h"))
    lines = lines.withColumn("k", _of("h")).join(often, "k", "left_semi").drop("k")
    by = Window.partitionBy("id", "th").orderBy("seq")
    lines = lines.withColumn("fresh", F.coalesce(F.col("starts") | (F.lag("seq").over(by) != F.col("seq") - 1), F.lit(True)))
    lines = lines.withColumn("start", F.max(F.when(F.col("fresh"), F.col("seq"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    lines = checkpointed(lines.drop("fresh"))
    whole = checkpointed(repeated(chunks(lines.where(F.lit(chunked))), "h"))
    gone = whole.where("again").select("id", "th", F.col("seq").alias("start"), F.col("n").alias("long"))
    left = lines.join(gone, ["id", "th", "start"], "left")
    pairs = left.where("p is not null and (long is null or seq = start + long - 1)").select("id", "th", "seq", F.lit(2).alias("n"), "pos", "to", F.col("p").alias("h"))
    out = whole.select("id", "th", F.lit(CHUNK).alias("kind"), "seq", "n", "pos", "to", "h")
    out = out.union(repeated(pairs, "h").select("id", "th", F.lit(PAIR), "seq", "n", "pos", "to", "h"))
    if lone_words is not None:
        out = out.union(left.where((F.col("size") >= 2 * lone_words - 1) & F.col("long").isNull()).select("id", "th", F.lit(LINE), "seq", F.lit(1), "pos", F.col("pos") + 1, "h"))
    return out


def removals(docs: DataFrame, lone_words: int | None = None) -> DataFrame:
    """Rows (id, th, kept, n_gone): of documents that lose lines, the stretches (from, n) of lines that stay, and how many go.

    docs has id, th, text and row (all other columns).
    """
    listed = candidates(docs, lone_words).groupBy("id", "th").agg(F.collect_list(F.struct("kind", "seq", "n", "pos", "to", "h")).alias("parts"))
    own = docs.join(listed.toDF("i", "t", "parts"), (F.col("id") == F.col("i")) & (F.col("th") == F.col("t")), "left")
    # dedup_lines joins the documents once more. Spark shuffles them once for both joins if both are outer and read all
    # columns, so this one adds a 0 made of row to a place, and rows without parts go only after explode_outer.
    filled = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(_BLANK))
    own = own.select("id", "th", "parts", F.when(F.col("parts").isNotNull(), filled).alias("lines"), F.pmod(F.hash("row"), F.lit(1)).alias("zero"))
    held = F.transform("parts", lambda c: F.struct(c.alias("c"), F.array_join(F.slice("lines", c["seq"] + 1 + F.col("zero"), c["n"]), "\n").alias("bytes")))
    own = own.select("id", "th", F.explode_outer(held).alias("x")).where("x is not null").select("id", "th", "x.c.*", "x.bytes")
    if lone_words is not None:
        own = own.where((F.col("kind") != LINE) | (n_words(F.col("bytes")) >= lone_words))
    # Equal hashes are compared byte by byte: the first of each content stays, whatever else shares its hash.
    first = own.groupBy("kind", "h", "bytes").agg(F.min(F.struct("id", "th", "seq")).alias("first")).select(_of("kind", "h", "bytes"), "first")
    again = own.withColumn("k", _of("kind", "h", "bytes")).join(first, "k").where(F.struct("id", "th", "seq") != F.col("first"))
    again = again.select("id", "th", "seq", (F.col("seq") + F.col("n")).alias("end"), "pos", "to")
    by = Window.partitionBy("id", "th").orderBy("seq", "end")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("seq") > F.max("end").over(before), F.lit(True))
    again = again.withColumn("run", F.sum(apart.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = again.groupBy("id", "th", "run").agg(F.min("pos").alias("pos"), F.max("to").alias("to"))
    since = F.coalesce(F.lag("to").over(Window.partitionBy("id", "th").orderBy("run")), F.lit(0))
    runs = runs.withColumn("since", since)
    stay = F.sort_array(F.collect_list(F.struct(F.col("since").alias("from"), (F.col("pos") - F.col("since")).alias("n"))))
    rest = F.array(F.struct(F.max("to").alias("from"), F.lit(2**31 - 1).alias("n")))
    return runs.groupBy("id", "th").agg(F.concat(stay, rest).alias("kept"), F.sum(F.col("to") - F.col("pos")).cast("bigint").alias("n_gone"))


def dedup_lines(docs: DataFrame, lone_words: int | None = None) -> DataFrame:
    """docs with repeated runs of lines removed from text, and the counts n_lines and n_removed added.

    A run is two neighbouring lines or more; or, if lone_words is given, a single line of that many words. Of each run that the corpus holds
    more than once, byte for byte, the occurrence of the smallest doc_id, then the first in it, stays: a line goes if it
    and a neighbour stand side by side somewhere earlier too. So the first occurrence of each line always stays. Runs
    are found as content-defined chunks, and at their ends as pairs of lines, whatever lines stand before and after.
    Blank lines (empty or white space) part no run; between lines that go they go too, others stay. Only equal bytes are ever
    removed; of two runs that differ but share a 64-bit hash the later's repeats may stay.

    A null text stays null and has no lines; empty texts and texts of any length are taken whole. Repeated rows are one
    document: each gives its row, and they don't repeat each other. Rows of the same doc_id but other texts are
    documents of their own, in order of their hash. Rows without doc_id stay as they are and repeat nothing. Columns
    n_lines and n_removed of docs are replaced; any other names are free. An empty table gives none.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text", F.struct(*[F.col(f"`{c}`") for c in kept if c != "text"]).alias("row"))
    gone = removals(docs.where("id is not null"), lone_words).toDF("i", "t", "kept", "n_gone")
    out = docs.where("id is not null").join(gone, (F.col("id") == F.col("i")) & (F.col("th") == F.col("t")), "left").select("text", "row", "kept", "n_gone")
    out = out.union(docs.where("id is null").select("text", "row", F.lit(None).cast(out.schema["kept"].dataType), F.lit(None).cast("bigint")))
    out = out.select("text", "row", "kept", "n_gone", F.split("text", "\n").alias("lines"))
    stretches = F.transform(F.filter("kept", lambda g: (g["n"] > 0) & (g["from"] < F.size("lines"))), lambda g: F.array_join(F.slice("lines", g["from"] + 1, F.least(g["n"], F.size("lines") - g["from"])), "\n"))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(stretches, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("bigint")
    return out.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept], n_lines.alias("n_lines"), F.coalesce("n_gone", F.lit(0)).cast("bigint").alias("n_removed"))
