"""Call logs in three formats, one call a file, as turns; files that can't be read go to quarantine.

``call_id, subscriber_id, started_at, ended_at, turn_id, role, content, said_at, path``. Lengths are tested
before stripping in JSON, after it in CSV and text files; numbers have gaps in JSON and CSV, none in text files.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from dialoglens.functions.text import stem, strip
from dialoglens.sources.storage import kept

ROLES = ("user", "bot", "system")
JSON = (
    "call_id string, subscriber_id string, started_at string, ended_at string, "
    "turns array<struct<role: string, content: string, timestamp: string>>, metadata map<string, string>, _corrupt_record string"
)
COLUMNS = ["call_id", "subscriber_id", "started_at", "ended_at", "turn_id", "role", "content", "said_at", "path"]
# The header and the turn lines of text logs.
HEADER = r"(?i)^\[CALL_ID:\s*(.+?)\].*\[SUBSCRIBER:\s*(.+?)\]"
TURN = r"(?i)^\[(.+?)\]\s*(USER|BOT|SYSTEM):\s*(.+)"


def moment(text: Column) -> Column:
    """An ISO time; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def known_roles(turns: DataFrame) -> DataFrame:
    """Calls in which any turn has another role are left out whole."""
    bad = F.max((~F.col("role").isin(*ROLES)).cast("int")).over(Window.partitionBy("path"))
    return turns.withColumn("bad_", bad).where("bad_ = 0").drop("bad_")


def read_json(spark: SparkSession, folder: str, shortest: int = 5) -> DataFrame:
    raw = spark.read.schema(JSON).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    raw = raw.select("*", F.col("_metadata.file_path").alias("path")).where("_corrupt_record is null")
    rows = raw.select(
        F.coalesce("call_id", stem(F.col("path"))).alias("call_id"),
        F.coalesce("subscriber_id", F.lit("unknown")).alias("subscriber_id"),
        moment(F.col("started_at")).alias("started_at"),
        moment(F.col("ended_at")).alias("ended_at"),
        F.posexplode("turns").alias("turn_id", "t"),
        "path",
    ).where(F.length(F.coalesce("t.content", F.lit(""))) >= shortest)
    rows = rows.withColumns({"role": F.coalesce("t.role", F.lit("user")), "content": strip(F.col("t.content")), "said_at": moment(F.col("t.timestamp"))})
    return known_roles(rows).select(COLUMNS)


def read_csv(spark: SparkSession, folder: str, shortest: int = 5) -> DataFrame:
    """Ids come from a file's first row; the row's place in its file is the turn's number."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("header", True).option("multiLine", True).option("escape", '"')
    raw = whole.schema("call_id string, subscriber_id string, timestamp string, role string, content string").csv(folder)
    # a multi-line file is read by one task from its start, so this number rises with the row
    raw = raw.select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"))
    w = Window.partitionBy("path").orderBy("at")
    rows = raw.withColumns({"turn_id": F.row_number().over(w) - 1, "call": F.first("call_id").over(w), "subscriber": F.first("subscriber_id").over(w), "content": strip(F.coalesce("content", F.lit("")))})
    rows = rows.where(F.length("content") >= shortest).select(
        F.coalesce("call", stem(F.col("path"))).alias("call_id"), F.coalesce("subscriber", F.lit("unknown")).alias("subscriber_id"), F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("ended_at"), "turn_id", F.coalesce("role", F.lit("user")).alias("role"), "content", moment(F.col("timestamp")).alias("said_at"), "path",
    )
    return known_roles(rows).select(COLUMNS)


def read_text(spark: SparkSession, folder: str, shortest: int = 5) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("wholetext", True).text(folder)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("at", "line")).withColumn("line", strip(F.col("line")))
    header = F.col("line").rlike(HEADER)
    ids = lines.where(header).groupBy("path").agg(F.max_by("line", "at").alias("h"))
    said = lines.where(~header & F.col("line").rlike(TURN)).withColumn("content", strip(F.regexp_extract("line", TURN, 3)))
    said = said.where(F.length("content") >= shortest).withColumn("turn_id", F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1)
    rows = said.join(ids, "path", "left")
    return rows.select(
        F.coalesce(strip(F.regexp_extract("h", HEADER, 1)), stem(F.col("path"))).alias("call_id"), F.coalesce(strip(F.regexp_extract("h", HEADER, 2)), F.lit("unknown")).alias("subscriber_id"),
        F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"), "turn_id", F.lower(F.regexp_extract("line", TURN, 2)).alias("role"), "content",
        moment(F.regexp_extract("line", TURN, 1)).alias("said_at"), "path",
    )


def read_call_logs(spark: SparkSession, folder: str, shortest: int = 5) -> DataFrame:
    """All logs under a folder; other suffixes are not read."""
    return read_json(spark, folder, shortest).unionByName(read_csv(spark, folder, shortest)).unionByName(read_text(spark, folder, shortest))


@dataclass(frozen=True)
class Logs:
    """``turns`` of the files that could be read; ``rejected``: ``path, reason`` of all others."""

    turns: DataFrame
    rejected: DataFrame


class Rejected(Exception):
    """A file that is no call log, and why."""


def json_turns(text: str, shortest: int) -> tuple[dict, list[tuple]]:
    try:
        found = json.loads(text)
    except ValueError:
        raise Rejected("not JSON") from None
    listed = found.get("turns", []) if isinstance(found, dict) else None
    if not isinstance(listed, list) or not all(isinstance(t, dict) for t in listed):
        raise Rejected("no list of turns")
    rows = [(i, t.get("role") or "user", t.get("content") or "", t.get("timestamp")) for i, t in enumerate(listed)]
    return found, [r for r in rows if len(r[2]) >= shortest]


def csv_turns(text: str, shortest: int) -> tuple[dict, list[tuple]]:
    table = csv.DictReader(io.StringIO(text, newline=""))
    if not {"role", "content"} <= set(table.fieldnames or ()):
        raise Rejected("no columns role and content")
    rows = list(table)
    said = [(i, r["role"] or "user", (r["content"] or "").strip(), r.get("timestamp")) for i, r in enumerate(rows)]
    return (rows[0] if rows else {}), [r for r in said if len(r[2]) >= shortest]


def text_turns(text: str, shortest: int) -> tuple[dict, list[tuple]]:
    ids, rows = {}, []
    for line in map(str.strip, re.split(r"\r\n|\n|\r", text)):
        if head := re.match(HEADER, line):
            ids = {"call_id": head[1].strip(), "subscriber_id": head[2].strip()}
        elif (said := re.match(TURN, line)) and len(said[3].strip()) >= shortest:
            rows.append((len(rows), said[2].lower(), said[3].strip(), said[1]))
    return ids, rows


#: Tasks for each core that read a folder's files; a task holds some of them at a time.
TASKS = 8
KINDS = {"json": json_turns, "csv": csv_turns, "txt": text_turns}
PARSED = "path string, reason string, call_id string, subscriber_id string, started_at string, ended_at string, turns array<struct<turn_id: int, role: string, content: string, said_at: string>>"


def parsed(path: str, content: bytes, shortest: int) -> dict:
    """One file's ids and turns, or the reason why it has none."""
    name = path.rsplit("/", 1)[-1]
    stem_, _, suffix = name.rpartition(".")
    try:
        if suffix.lower() not in KINDS:
            raise Rejected("unknown suffix")
        try:
            text = content.decode("utf-8-sig")
        except UnicodeDecodeError:
            raise Rejected("not UTF-8") from None
        ids, rows = KINDS[suffix.lower()](text, shortest)
        if bad := next((r[1] for r in rows if r[1] not in ROLES), None):
            raise Rejected(f"unknown role: {bad}")
        if not rows:
            raise Rejected("no turns")
    except Rejected as reason:
        return dict(path=path, reason=str(reason))
    turns = [dict(turn_id=i, role=role, content=said.strip(), said_at=at) for i, role, said, at in rows]
    return dict(path=path, call_id=ids.get("call_id") or stem_, subscriber_id=ids.get("subscriber_id") or "unknown", started_at=ids.get("started_at"), ended_at=ids.get("ended_at"), turns=turns)


def scan_call_logs(spark: SparkSession, folder: str, shortest: int = 5) -> Logs:
    """All files under a folder in one scan: each gives turns or stands among the rejected, none both, none neither.

    A file lies in one task whole, as a call log is one call. Turns are those of ``read_call_logs``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    # Spark deals a few files to a task, and each task would write a file of its own
    raw = raw.coalesce(TASKS * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed(p, c, shortest) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = to_arrow_schema(StructType.fromDDL(PARSED))
    found = kept(raw.mapInArrow(run, PARSED), "logs")
    ids = ["call_id", "subscriber_id", moment(F.col("started_at")).alias("started_at"), moment(F.col("ended_at")).alias("ended_at")]
    rows = found.where("reason is null").select(*ids, F.explode("turns").alias("t"), "path").select("call_id", "subscriber_id", "started_at", "ended_at", "t.turn_id", "t.role", "t.content", moment(F.col("t.said_at")).alias("said_at"), "path")
    return Logs(rows.select(COLUMNS), found.where("reason is not null").select("path", "reason"))


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """``path, reason`` of the files that give no turns."""
    return scan_call_logs(spark, folder).rejected


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """``qa_id, metric, human_score`` of JSON-lines files; bad lines are skipped, the last of equal keys counts.

    Lines go by file, then by their place in it, however the files are split.
    """
    raw = spark.read.schema("qa_id string, metric string, human_score double").option("mode", "DROPMALFORMED").json(path)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    rows = raw.select("*", at.alias("at")).where("qa_id is not null and metric is not null")
    return rows.groupBy("qa_id", "metric").agg(F.max_by("human_score", "at").alias("human_score"))
