"""Record files: JSON arrays, JSON lines and parquet folders.

Every reader says where a record stood (``position``: file, split, row in
the split, item), so that the order of the input survives shuffles.  JSON
array files split like line files (see ``stepwise.sources.arrays``).
Buffers whose semantics depend on key presence are read as raw JSON text
per record (see ``stepwise.operators.search.parse_buffer``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwise.session import path_exists, scratch_path, written
from stepwise.sources.arrays import POSITION, array_records, file_place, position


def strict_json(c) -> "F.Column":
    """True when the text is exactly one JSON value (nothing after it).

    The parser stops after the first value; wrapped in brackets, a second
    value or trailing text becomes a syntax error.
    """
    wrapped = F.concat(F.lit("["), c, F.lit("]"))
    return F.coalesce(F.try_parse_json(wrapped).isNotNull() & (F.json_array_length(wrapped) == 1), F.lit(False))


def survey(spark: SparkSession, paths: str | Sequence[str], validate: bool = False, glob: str | None = None,
           recursive: bool = False) -> DataFrame:
    """One row per split: ``file, block, lines, first, head, bad``, in one pass that moves no text.

    ``head`` is the first non-blank character; ``bad`` (with ``validate``) the
    place of the first non-blank line that is not JSON.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text([paths] if isinstance(paths, str) else list(paths)).select(*file_place(), "value")
    char = F.regexp_extract("value", r"(\S)", 1)
    wrong = (char != "") & ~strict_json(F.col("value")) if validate else F.lit(False)
    return lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.min("row").alias("first"),
        F.min_by(F.when(char != "", char), F.when(char != "", F.col("row"))).alias("head"),
        F.min(F.when(wrong, F.col("row"))).alias("bad"))


def _heads(splits: DataFrame) -> dict[str, str]:
    """First non-blank character of each file that has one (one row a file, like the file listing itself)."""
    heads = splits.where("head is not null").groupBy("file").agg(F.min_by("head", "block").alias("head"))
    return {unquote(r["file"]): r["head"] for r in heads.toLocalIterator()}


def _bad_line(splits: DataFrame) -> tuple[str, int] | None:
    """(file, 1-based number) of the first bad line: the lines of the splits before, and the place in its own."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = splits.withColumn("line", F.coalesce(F.sum("lines").over(before), F.lit(0)) + F.col("bad") - F.col("first") + 1)
    bad = numbered.where("bad is not null").orderBy("file", "line").limit(1).collect()
    return (unquote(bad[0]["file"]), int(bad[0]["line"])) if bad else None


def first_bad_line(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """(file, 1-based line number) of the first non-blank line that is not JSON, else None."""
    return _bad_line(survey(spark, path, validate=True))


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(raw, position)`` of the non-blank lines of line files."""
    lines = spark.read.text(list(paths)).select(*file_place(), F.col("value").alias("raw"))
    return lines.where(F.length(F.trim("raw")) > 0).select("raw", position())


def _records_of(spark: SparkSession, heads: dict[str, str]) -> DataFrame:
    """``(raw, position)`` of all records; a file that starts with ``[`` is an array, any other holds lines."""
    arrays, lines = ([f for f, h in sorted(heads.items()) if (h == "[") == kind] for kind in (True, False))
    parts = [read(spark, files) for read, files in ((array_records, arrays), (_lines, lines)) if files]
    if not parts:
        return spark.createDataFrame([], f"raw string, position {POSITION}")
    return reduce(DataFrame.unionByName, parts)


def _typed(spark: SparkSession, records: DataFrame, schema: StructType | None) -> DataFrame:
    """Records parsed to columns, beside ``position``; a record that does not parse fails the job."""
    if schema is None:
        path = scratch_path(spark, "records-to-infer")
        records.select("raw").write.text(path)
        schema = spark.read.option("mode", "FAILFAST").json(path).schema
    parsed = records.select(F.from_json("raw", schema, {"mode": "FAILFAST"}).alias("_r"), "position")
    return parsed.select("_r.*", "position")


def read_json_records(spark: SparkSession, path: str, schema: StructType | None = None,
                      validate: bool = False, with_position: bool = False) -> DataFrame:
    """JSON array files or JSON lines, told apart file by file by the first non-blank character.

    Malformed input fails the job (FAILFAST); blank lines are skipped.  With
    ``validate`` JSON-lines input is checked first and the error names the
    file and line number of the first malformed line.  ``with_position`` adds
    the place of each record in the files.
    """
    splits = written(survey(spark, path, validate), "survey")
    heads = _heads(splits)
    if validate:
        bad = _bad_line(splits.where(~F.col("file").isin([f for f, h in heads.items() if h == "["])))
        if bad:
            raise ValueError(f"Failed to parse line {bad[1]} in {bad[0]} as JSON")
    if "[" not in heads.values() and not with_position:
        reader = spark.read.option("mode", "FAILFAST")
        return (reader.schema(schema) if schema is not None else reader).json(path)
    out = _typed(spark, _records_of(spark, heads), schema)
    return out if with_position else out.drop("position")


def raw_json_records(spark: SparkSession, path: str) -> DataFrame:
    """Each record as raw JSON text (``raw``), keeping explicit nulls apart from absent keys, with its ``position``.

    JSON lines: one record per non-blank line.  A JSON array file: its
    elements, read in many tasks; where it is no well-formed array, a record
    that is no JSON, so that validation sees it.
    """
    return _records_of(spark, _heads(survey(spark, path)))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """One record a file (an object spread over several lines)."""
    return spark.read.text(path, wholetext=True).select(*file_place(), F.trim("value").alias("raw")).select("raw", position())


def read_buffer(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Search buffer as raw records with their ``position``.

    Lenient (default): a missing, empty, non-object or corrupt buffer is an
    empty table.  Strict: a missing file or an unparsable record raises; an
    empty file is an empty table.
    """
    empty = spark.createDataFrame([], f"raw string, position {POSITION}")
    if not path_exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return empty
    heads = _heads(survey(spark, path))
    if not heads:
        return empty
    raw = _records_of(spark, heads)
    bad = raw.where(~strict_json(F.col("raw")) | F.json_object_keys("raw").isNull()).limit(1).count()
    if bad:
        # one object spread over several lines is a valid one-record buffer
        whole = _whole(spark, path)
        if whole.where(~strict_json(F.col("raw")) | F.json_object_keys("raw").isNull()).limit(1).count() == 0:
            return whole
        if strict:
            raise ValueError(f"{path}: JSON content must be a list or dict")
        return empty
    return raw


def read_answer_records(spark: SparkSession, path: str, id_key: str = "id",
                        answer_key: str = "answer") -> DataFrame:
    """Prediction or gold answers: objects only, id and answer as text, with their ``position``.

    ``id`` stays null when the key is absent; ``answer`` is the scalar's
    JSON text (strings unquoted).
    """
    raw = raw_json_records(spark, path)
    if raw.where(~strict_json(F.col("raw"))).limit(1).count():
        # not JSON lines: either one object spread over several lines, or an error
        whole = _whole(spark, path)
        # wrapped in brackets, anything after the first value (a second object,
        # trailing garbage) becomes a syntax error: strict whole-text parsing
        if whole.where(~strict_json(F.col("raw"))).limit(1).count() == 0:
            raw = whole
        else:
            bad = first_bad_line(spark, path)
            raise ValueError(f"Failed to parse line {bad[1]} in {bad[0]} as JSON" if bad else f"{path}: invalid JSON")
    obj = raw.where(F.json_object_keys("raw").isNotNull())   # non-object elements are dropped
    return obj.select(F.get_json_object("raw", f"$.{id_key}").alias("id_text"),
                      F.get_json_object("raw", f"$.{answer_key}").alias("answer"),
                      F.col("raw"), F.col("position"))


def read_record_dir(spark: SparkSession, path: str, class_pattern: str | None = None, schema: StructType | None = None) -> DataFrame:
    """Every ``.json`` / ``.jsonl`` file under a folder, concatenated in the order of their names.

    Each file's own first character says whether it is an array (pretty or
    compact, read in many tasks) or JSON lines.  ``source_file`` names the file
    of each row and ``position`` its place; with ``class_pattern`` (a regex
    with one group over the file path) a ``source_class`` column is derived
    from it.  Column sets may differ between files; with ``schema`` nothing is
    read to find them.
    """
    splits = written(survey(spark, path, validate=True, glob="*.{json,jsonl}", recursive=True), "survey")
    heads = _heads(splits)
    if splits.isEmpty():
        raise ValueError(f"no .json/.jsonl files under {path}")
    arrays = [f for f, h in heads.items() if h == "["]
    bad = _bad_line(splits.where(~F.col("file").isin(arrays)))
    if bad:
        raise ValueError(f"malformed JSON line {bad[1]} in {bad[0]}")
    out = _typed(spark, _records_of(spark, heads), schema)
    out = out.withColumn("source_file", F.col("position.file"))
    if class_pattern:
        out = out.withColumn("source_class", F.regexp_extract("source_file", class_pattern, 1))
    return out


def read_parquet_folder(spark: SparkSession, path: str, required: tuple[str, ...] = (),
                        keep: tuple[str, ...] | None = None, max_samples: int | None = None,
                        order_by: tuple[str, ...] = ()) -> DataFrame:
    """All parquet files of a folder as one table, checked and pruned.

    ``required`` columns must exist; ``keep`` prunes to those columns (the
    scan then reads only them); ``max_samples`` takes the first rows in
    ``order_by`` order (a top-k, not a global sort).
    """
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"dataset must contain columns {list(required)}; missing {missing}")
    if keep is not None:
        df = df.select(*keep)
    if max_samples is not None:
        if order_by:
            df = df.orderBy(*order_by)
        df = df.limit(max_samples)
    return df


def write_records(df: DataFrame, path: str, fmt: str = "json", partition_by: tuple[str, ...] = (),
                  order_by: tuple[str, ...] = ()) -> str:
    """Write a table as JSON lines (or parquet), one file per task.

    ``order_by`` sorts globally at the sink (range partitioning, so files are
    in key order without a single-task sort).
    """
    if order_by:
        df = df.orderBy(*order_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    getattr(w, fmt)(path)
    return path


def write_report(summary: DataFrame, records: DataFrame, path: str, id_col: str = "id", fmt: str = "json",
                 **others: DataFrame) -> tuple[str, ...]:
    """Report sink: the one-row summary, the records and further tables (wrong, ignored) as one version.

    All parts are written to a fresh folder, sorted by ``id_col`` where they
    have it; one marker, made last, then names the folder.  Readers go by the
    latest marker, so a write that breaks off leaves the report as it was.
    Returns the folders of the parts.
    """
    spark = summary.sparkSession
    version = uuid.uuid4().hex
    parts = {"summary": summary.coalesce(1), "records": records, **others}
    folders = tuple(write_records(df, f"{path}/versions/{version}/{name}", fmt, order_by=(id_col,) if id_col in df.columns else ())
                    for name, df in parts.items())
    fs, folder = _file_system(spark, f"{path}/commits")
    fs.mkdirs(folder)
    latest = _latest_commit(spark, path)
    number = int(latest.split("-")[0]) + 1 if latest else 0
    fs.mkdirs(_file_system(spark, f"{path}/commits/{number:08d}-{version}")[1])
    return folders


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _latest_commit(spark: SparkSession, path: str) -> str | None:
    fs, folder = _file_system(spark, f"{path}/commits")
    return max((f.getPath().getName() for f in fs.listStatus(folder)), default=None) if fs.exists(folder) else None


def read_report(spark: SparkSession, path: str, part: str = "records", schema: StructType | str | None = None, fmt: str = "json") -> DataFrame:
    """One part of the report that was committed last."""
    latest = _latest_commit(spark, path)
    if latest is None:
        raise FileNotFoundError(f"no committed report under {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return getattr(reader, fmt)(f"{path}/versions/{latest.split('-')[1]}/{part}")
