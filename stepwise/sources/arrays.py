"""JSON array files read in many tasks.

A JSON array, compact or pretty, is one value, so a parser has to start at its
first character.  Here a file is read in pieces that end at ``}`` (the text
reader's ``lineSep``), which splits like any line file.  What a piece means
depends on two things before it: whether a string is open, and how many
brackets are.  Both are prefix sums:

1. Every piece gives its number of quotes (escaped ones left out) and its
   change of depth for either start, outside and inside a string.
2. Within a split the two starts are followed in order; a split passes on one
   row: its quotes and its change of depth for either start.  Prefix sums over
   these rows (one a split) tell how each split really starts.
3. A piece that ends outside strings at depth one ends an element.  Numbering
   the ends, again by split and within, gives every piece its element, and an
   element's pieces are put together: no task holds more than a split or an
   element.

Elements that are no objects (numbers, strings, arrays) have no end of their
own and come with the next object; they are told apart there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwise.session import written

#: Where a record stands: file, split, row in the split, item among those that came together.  It sorts as the files do.
POSITION = "struct<file: string, block: bigint, row: bigint, item: int>"


def file_place() -> tuple[Column, Column, Column]:
    """File, start of the split and running row of a scan, taken in the scan itself."""
    return (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"))


def position(item: Column | int = 0) -> Column:
    item = F.lit(item) if isinstance(item, int) else item
    return F.struct("file", "block", "row", item.cast("int").alias("item")).alias("position")


def _count(text: Column, char: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(char), F.lit("")))


def _pieces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Pieces that end at ``}``: quotes ``q`` (0 or 1) and change of depth ``d0``, ``d1`` for a start outside, inside a string."""
    pieces = spark.read.option("lineSep", "}").text(list(paths)).select(*file_place(), "value")
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    parts = F.split(plain, '"')
    pieces = pieces.withColumn("_parts", parts)
    every_second = lambda k: F.array_join(F.filter("_parts", lambda _, i: i % 2 == k), "")
    depth = lambda t: _count(t, "{") + _count(t, "[") - _count(t, "]")
    pieces = pieces.withColumns({"q": (F.size("_parts") - 1) % 2, "_out": every_second(0), "_in": every_second(1)})
    return pieces.withColumns({"d0": depth(F.col("_out")), "d1": depth(F.col("_in"))}).drop("_parts", "_out", "_in")


def _followed(pieces: DataFrame) -> DataFrame:
    """Both starts of a split followed through its pieces: string open at a piece's end ``e0``, ``e1`` and depth ``t0``, ``t1``."""
    upto = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = pieces.withColumn("e0", F.sum("q").over(upto) % 2).withColumn("e1", 1 - F.col("e0"))
    for h in (0, 1):
        start = (F.col(f"e{h}") + F.col("q")) % 2
        # the piece's own brackets, and the one that ended it
        change = F.when(start == 0, F.col("d0")).otherwise(F.col("d1")) - F.when(F.col(f"e{h}") == 0, 1).otherwise(0)
        out = out.withColumn(f"_c{h}", change).withColumn(f"t{h}", F.sum(f"_c{h}").over(upto))
    return out.drop("_c0", "_c1", "d0", "d1")


def _split_starts(followed: DataFrame) -> DataFrame:
    """One row a split: string open (``open_``) and depth (``depth``) at its start, and both at its end."""
    last = lambda c: F.max_by(c, "row").alias(c)
    blocks = followed.groupBy("file", "block").agg(F.sum("q").alias("q"), last("t0"), last("t1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("open_", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    blocks = blocks.withColumn("change", F.when(F.col("open_") == 0, F.col("t0")).otherwise(F.col("t1")))
    return blocks.select("file", "block", "open_", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"),
                         ((F.col("open_") + F.col("q")) % 2).alias("open_after"), "change")


def array_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(raw, position)``: the elements of the array files ``paths`` as JSON text, on one line each.

    Where a file is no well-formed list of elements, a record that is no JSON
    stands for the place, so that validation sees it.
    """
    followed = _followed(_pieces(spark, paths))
    starts = written(_split_starts(followed), "array-splits")
    placed = followed.join(starts.select("file", "block", "open_", "depth"), ["file", "block"])
    closed = F.when(F.col("open_") == 0, F.col("e0")).otherwise(F.col("e1")) == 0
    after = F.col("depth") + F.when(F.col("open_") == 0, F.col("t0")).otherwise(F.col("t1"))
    placed = written(placed.select("file", "block", "row", "value", (closed & (after == 1)).alias("is_end")), "array-pieces")

    ends = placed.groupBy("file", "block").agg(F.count_if("is_end").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    earlier = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (placed.withColumn("nth", F.coalesce(F.count_if("is_end").over(earlier), F.lit(0)))
                .join(ends, ["file", "block"]).withColumn("nth", F.col("first") + F.col("nth")))
    elements = numbered.groupBy("file", "nth").agg(
        F.sort_array(F.collect_list(F.struct("block", "row", "value"))).alias("pieces"), F.max("is_end").alias("ended"))
    text = F.array_join(F.transform("pieces", lambda p: p["value"]), "}")
    elements = elements.select("file", "nth", "ended", F.col("pieces")[0]["block"].alias("block"), F.col("pieces")[0]["row"].alias("row"),
                               F.when(F.col("ended"), F.concat(text, F.lit("}"))).otherwise(text).alias("text"))

    # each element follows "[" or ","; what follows the last one is "]", perhaps after elements that are no objects
    opener = F.when(F.col("nth") == 0, F.lit(r"^\s*\[\s*")).otherwise(F.lit(r"^\s*,\s*"))
    tail = ~F.col("ended")
    inner = F.when(F.regexp_like("text", opener), F.regexp_replace("text", opener, F.lit("")))
    rest = F.when(F.col("text").rlike(r"^\s*\]\s*$") & (F.col("nth") > 0), "").otherwise(
        F.when(inner.rlike(r"(?s)\]\s*$"), F.regexp_replace(inner, r"(?s)\s*\]\s*$", "")))
    rest = F.when((F.col("nth") == 0) | (rest != "") | ~F.startswith("text", F.lit(",")), rest)  # nothing after a comma
    elements = elements.withColumn("body", F.when(tail, rest).otherwise(inner))
    one_line = F.regexp_replace("body", r"[\r\n]+", " ")
    several = F.variant_get(F.try_parse_json(F.concat(F.lit("["), F.col("body"), F.lit("]"))), "$", "array<variant>")
    listed = F.transform(several, lambda v: F.to_json(v))
    wrong = F.array(F.concat(F.lit("["), F.regexp_replace("text", r"[\r\n]+", " ")))
    items = (F.when(F.col("body").isNull(), wrong).when(F.col("ended") & F.col("body").startswith("{"), F.array(one_line))
             .when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.coalesce(listed, wrong)))
    records = elements.select("file", "block", "row", F.posexplode(items).alias("item", "raw")).select("raw", position(F.col("item")))

    # a file that ends inside a string or with open brackets lacks its end
    # (the last piece, after the last "}", was not ended by a bracket)
    total = starts.groupBy("file").agg(F.sum("change").alias("depth"), F.max_by("open_after", "block").alias("open_"),
                                       F.max("block").alias("block"))
    broken = total.where("depth <> -1 or open_ <> 0").select(
        F.concat(F.lit("[ no proper end: "), "file").alias("raw"), F.struct("file", "block", F.lit((1 << 63) - 1).alias("row"), F.lit(0).alias("item")).alias("position"))
    return records.unionByName(broken)
