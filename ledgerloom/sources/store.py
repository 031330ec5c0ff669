"""Observation stores, their manifests, file discovery and ordered scans."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import plain_count
from ledgerloom.operators.pairs import fingerprint
from ledgerloom.schema import FEATURE_VERSION
from ledgerloom.sources.views import numbered

CHUNK_ROWS = 65_536


# --- documents ---


def canonical(document) -> str:
    return json.dumps(document, sort_keys=True, separators=(",", ":"))


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def write_document(spark: SparkSession, path: str, document: dict, overwrite: bool = False) -> dict:
    """Writes JSON with its fingerprint to any file system Spark knows: a temporary file, then a rename."""
    full = document | {"fingerprint": fingerprint(document)}
    final, fs = _path(spark, path)
    if fs.exists(final) and not overwrite:
        raise FileExistsError(path)
    part, _ = _path(spark, path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(canonical(full).encode()))
    out.close()
    if overwrite:
        fs.delete(final, False)
    if not fs.rename(part, final):
        raise OSError(f"cannot write {path}")
    return full


def read_document(spark: SparkSession, path: str, **expected) -> dict:
    """Reads JSON; refuses a fingerprint that isn't its own and fields other than expected (lineage)."""
    where, fs = _path(spark, path)
    stream = fs.open(where)
    try:
        document = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    body = {k: v for k, v in document.items() if k != "fingerprint"}
    if fingerprint(body) != document.get("fingerprint"):
        raise ValueError(f"{path}: its fingerprint isn't that of its content")
    for k, v in expected.items():
        if document.get(k) != v:
            raise ValueError(f"{path}: {k} is {document.get(k)!r}, not {v!r}")
    return document


def file_digests(spark: SparkSession, path: str, recurse: bool = False) -> DataFrame:
    """path, length, sha256 of files; recurse: of those in folders below too."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower()).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


# --- observation stores ---


def verified_files(spark: SparkSession, root: str, records: DataFrame) -> DataFrame:
    """path, problem (null if none) of frozen files: records hold path, relative to root, and sha256.

    A path that leads out of the root isn't read: problem 'outside'. Others are 'missing' or 'changed'.
    """
    base = root.rstrip("/")
    parts = F.split("path", "/")
    outside = F.col("path").rlike("^(/|[a-zA-Z][a-zA-Z0-9+.-]*:)") | F.array_contains(parts, "..") | F.array_contains(parts, "")
    # what the reader calls the root, to cut it off
    where, fs = _path(spark, base)
    full = fs.makeQualified(where).toString().rstrip("/")
    found = file_digests(spark, base, recurse=True).select(F.expr(f"substring(path, {len(full) + 2})").alias("path"), F.col("sha256").alias("found"))
    both = records.select("path", "sha256", outside.alias("out")).join(found, "path", "left")
    problem = F.when(F.col("out"), "outside").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed")
    return both.select("path", problem.alias("problem"))


def read_verified(spark: SparkSession, root: str, records: DataFrame) -> DataFrame:
    """The Parquet rows of frozen files, after verified_files() has found nothing wrong with any."""
    bad = verified_files(spark, root, records).filter("problem is not null").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['path']}: {r['problem']}" for r in bad))
    return spark.read.parquet(*(f"{root.rstrip('/')}/{r['path']}" for r in records.select("path").collect()))  # a path a file


def freeze(spark: SparkSession, path: str, document: dict) -> dict:
    """Writes a document once: an equal one that is there stays, another is an error."""
    if not exists(spark, path):
        return write_document(spark, path, document)
    there = read_document(spark, path)
    if {k: v for k, v in there.items() if k != "fingerprint"} != json.loads(canonical(document)):
        raise ValueError(f"{path}: frozen with other content")
    return there


def write_store(observations: DataFrame, path: str, chunk_rows: int = CHUNK_ROWS) -> dict:
    """A store partitioned by session, in files of at most chunk_rows, with an inventory and a manifest; never over an existing one.

    The inventory has a row a file (its sha256, bytes, rows and row ids) and one for each run of a segment in it.
    """
    spark = observations.sparkSession
    if observations.isEmpty():
        raise ValueError("no rows were written")
    rows = observations.withColumn("schema_version", F.lit(FEATURE_VERSION))
    chunk = F.call_function("div", F.col("row_id"), F.lit(chunk_rows))  # a long session is written by many tasks
    rows.repartition("session", chunk).sortWithinPartitions("session", "row_id").write.mode("errorifexists").option("maxRecordsPerFile", chunk_rows).partitionBy("session").parquet(path)
    stored = spark.read.parquet(path)
    sums = stored.groupBy("session").agg(F.count("*").alias("rows"), F.min("row_id").alias("first"), F.max("row_id").alias("last")).orderBy("session").collect()
    broken = [r["session"] for r in sums if r["last"] - r["first"] + 1 != r["rows"]]
    if broken:
        raise ValueError(f"row ids with gaps in sessions {broken[:5]}")
    run = F.col("segment") if "segment" in stored.columns else F.lit(0)
    kept = stored.select("session", "row_id", run.cast("bigint").alias("segment"), F.substring_index(F.col("_metadata.file_path"), "/", -2).alias("file"))
    runs = kept.groupBy("session", "file", "segment").agg(F.count("*").alias("rows"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    digests = file_digests(spark, f"{path}/session=*/*.parquet").select(F.substring_index("path", "/", -2).alias("file"), F.col("length").alias("bytes"), "sha256")
    runs.join(digests, "file").write.parquet(f"{path}/_chunks")
    chunks = spark.read.parquet(f"{path}/_chunks")
    files = chunks.select("file", "bytes", "sha256").distinct()
    total = files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), _digest_of_all().alias("digest")).first()
    return write_document(spark, f"{path}/_manifest.json", {"version": FEATURE_VERSION, "columns": stored.columns, "sessions": [r.asDict() for r in sums], "files": total["files"], "bytes": total["bytes"], "digest": str(total["digest"])})


def _digest_of_all():
    """One number of all files' names and digests, whatever their order, from one aggregation."""
    each = F.conv(F.substring(F.sha2(F.concat_ws(":", "file", "sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.sum(each)


def write_archive(observations: DataFrame, path: str) -> dict:
    """One session's observations (session, row_id, segment, mid, ...) with `y`, the return on the row before in the segment, 0 at its start."""
    from ledgerloom.operators.runs import step_returns

    ticks = observations.withColumn("run", F.col("segment")).withColumn("brk", F.lit(False))
    y = step_returns(ticks).select("session", "row_id", F.col("step_return").alias("y"))
    return write_store(observations.join(y, ["session", "row_id"]), path)


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The archive; refuses one of another feature version, or without y."""
    rows = open_store(spark, path)
    if "y" not in rows.columns or rows.filter(F.col("y").isNull() | F.isnan("y")).limit(1).count():
        raise ValueError(f"{path}: an archive needs y in every row")
    return rows.select(*columns) if columns else rows


def open_store(spark: SparkSession, path: str, columns: list[str] | None = None, verify: bool = False) -> DataFrame:
    """The store, its manifest and inventory checked; only the wanted columns are read. verify: every file's digest too."""
    manifest = read_document(spark, f"{path}/_manifest.json", version=FEATURE_VERSION)
    chunks = spark.read.parquet(f"{path}/_chunks")
    total = chunks.select("file", "bytes", "sha256").distinct().agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), _digest_of_all().alias("digest")).first()
    if (total["files"], total["bytes"], str(total["digest"])) != (manifest["files"], manifest["bytes"], manifest["digest"]):
        raise ValueError("the store's inventory isn't that of its manifest")
    have = chunks.groupBy("session").agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last")).orderBy("session").collect()
    if [r.asDict() for r in have] != manifest["sessions"] or any(r["last"] - r["first"] + 1 != r["rows"] for r in have):
        raise ValueError("the store's rows aren't those of its manifest")
    if verify and not (bad := store_problems(spark, path)).isEmpty():
        raise ValueError("; ".join(f"{r['file']}: {r['problem']}" for r in bad.limit(5).collect()))
    rows = spark.read.parquet(path)
    if rows.columns != manifest["columns"]:
        raise ValueError("the store's columns aren't those of its manifest")
    return rows.select(*columns) if columns else rows


def store_problems(spark: SparkSession, path: str) -> DataFrame:
    """file, problem ('missing', 'changed', 'unexpected') of a store's files against its inventory."""
    listed = spark.read.parquet(f"{path}/_chunks").select("file", "sha256").distinct()
    found = file_digests(spark, f"{path}/session=*/*.parquet").select(F.substring_index("path", "/", -2).alias("file"), F.col("sha256").alias("found"))
    both = listed.join(found, "file", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("found") != F.col("sha256"), "changed")
    return both.select("file", problem.alias("problem")).filter("problem is not null")


def read_rows(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by id, as often and in the order of `place` as asked for; ids: place, session, row_id."""
    return ids.join(rows.select("session", "row_id", *columns), ["session", "row_id"]).select("place", "session", "row_id", *columns)


def read_ranges(rows: DataFrame, ranges: DataFrame, columns: list[str], block: int = 4096) -> DataFrame:
    """Rows whose id lies in a half-open range of their session, once per range: ranges meet the blocks of rows that they touch."""

    def of(row: Column) -> Column:
        return F.call_function("div", row, F.lit(block))

    touched = ranges.filter("stop > start").select("session", "start", "stop", F.explode(F.sequence(of(F.col("start")), of(F.col("stop") - 1))).alias("_block"))
    met = touched.join(rows.select("session", "row_id", *columns).withColumn("_block", of(F.col("row_id"))), ["session", "_block"])
    return met.filter((F.col("row_id") >= F.col("start")) & (F.col("row_id") < F.col("stop"))).select("session", "row_id", *columns)


def ordered_parts(parts: list[DataFrame], order: str, block: int = 1 << 20) -> DataFrame:
    """Parts one after the other with a global ordinal `source_row`: each part's start is the sum of those before.

    Rows are numbered in blocks of the order column's values, so no part goes through one task; one job counts all parts.
    Parts with other columns or types than the first, or with other identities (publisher_id, instrument_id, where there
    are any) are refused.
    """
    if not parts:
        raise ValueError("no parts")
    for k, part in enumerate(parts[1:], 1):
        if part.dtypes != parts[0].dtypes:
            raise ValueError(f"part {k} has other columns than part 0")
    tagged = [part.withColumn("part", F.lit(k)) for k, part in enumerate(parts)]
    whole = tagged[0]
    for part in tagged[1:]:
        whole = whole.unionByName(part)
    identity = [c for c in ("publisher_id", "instrument_id") if c in parts[0].columns]
    counts = whole.groupBy("part").agg(F.count("*").alias("n"), *(F.min(c).alias(f"lo_{c}") for c in identity), *(F.max(c).alias(f"hi_{c}") for c in identity)).collect()  # a row a part
    for c in identity:
        values = {r[f"{end}_{c}"] for r in counts for end in ("lo", "hi")}
        if len(values) > 1:
            raise ValueError(f"parts of several {c}s: {sorted(values)[:5]}")
    n, start = {r["part"]: r["n"] for r in counts}, [0]
    for k in range(len(parts)):
        start.append(start[-1] + n.get(k, 0))
    rows = numbered(whole, "part", [order], F.floor(F.col(order) / block))
    first = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in start[:-1])), F.col("part") + 1)
    return rows.withColumn("source_row", F.col("row_id") + first).drop("row_id")


def merge_records(raw: DataFrame, deltas: DataFrame) -> DataFrame:
    """Raw records with their decoded deltas, by session and sequence: only adds, cancels, modifies and clears have one.

    `problem` says where that isn't so: 'no delta', 'unexpected delta' (of another action, or of no record), 'repeated'.
    """
    keys = ["session", "sequence"]
    own = deltas.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*(c for c in deltas.columns if c not in keys))).alias("delta"))
    both = raw.join(own, keys, "full_outer")
    changes = F.col("action").isin("A", "C", "M", "R")
    problem = F.when(F.col("_n") > 1, "repeated").when(F.col("action").isNull() | ~changes & F.col("_n").isNotNull(), "unexpected delta").when(changes & F.col("_n").isNull(), "no delta")
    return both.withColumn("problem", problem).drop("_n")


def until_stop(events: DataFrame, stop_ns: int) -> DataFrame:
    """Records before the first completed event at or after the stop time, per session."""
    first = events.filter((F.col("ts") >= stop_ns) & F.col("is_last")).groupBy("session").agg(F.min("source_row").alias("stop_row"))
    return events.join(first, "session", "left").filter(F.col("stop_row").isNull() | (F.col("source_row") < F.col("stop_row"))).drop("stop_row")


# --- discovery ---

_NAME = r"-(\d{8})\.([a-z]+)\.([^.]+?)(?:\.(\d+))?\.dbn\.zst$"


def discover_jobs(files: DataFrame) -> DataFrame:
    """day, parts (in numeric order), definition, problem: order-log files paired with the day's one definition file.

    All files of a day must name one instrument.
    """
    named = files.select("path", *(F.regexp_extract("path", _NAME, k).alias(c) for k, c in enumerate(("day", "kind", "instrument", "part"), 1)))
    named = named.filter("day <> ''").withColumn("part", F.when(F.col("part") == "", 0).otherwise(F.expr("try_cast(part as int)")))
    logs = named.filter("kind = 'mbo'").groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "path"))), lambda s: s["path"]).alias("parts"), F.collect_set("instrument").alias("of_logs"))
    definitions = named.filter("kind = 'definition'").groupBy("day").agg(F.array_sort(F.collect_list("path")).alias("definitions"), F.collect_set("instrument").alias("of_definitions"))
    both = logs.join(definitions, "day", "full_outer")
    instruments = F.array_union(F.coalesce("of_logs", F.array().cast("array<string>")), F.coalesce("of_definitions", F.array().cast("array<string>")))
    problem = (
        F.when(F.col("parts").isNull(), "no log").when(F.col("definitions").isNull(), "no definition").when(F.size("definitions") > 1, "several definitions").when(F.size(instruments) > 1, "several instruments")
    )
    return both.select("day", "parts", F.get("definitions", F.lit(0)).alias("definition"), problem.alias("problem"))


def pending_jobs(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    return jobs.join(finished.select("day"), "day", "left_anti")


def run_jobs(spark: SparkSession, days: list[str], work: Callable[[str], dict], folder: str, at_once: int = 6) -> list[dict]:
    """work(day) for each day that `folder` has no document of, at_once at a time; one result a day, in order.

    work starts Spark jobs of its own and returns what to keep of them. Its document is written when it's done, so a later
    call does what is left. A failing day is reported with its error and stops no other.
    """

    def one(day: str) -> dict:
        path = f"{folder}/{day}.json"
        if exists(spark, path):
            return read_document(spark, path) | {"day": day, "status": "finished before"}
        began = time.monotonic()
        try:
            found = work(day)
        except Exception as e:  # whatever a day's log may hold
            return {"day": day, "status": "failed", "error": f"{type(e).__name__}: {e}"[:1000]}
        return write_document(spark, path, found | {"seconds": round(time.monotonic() - began, 3)}) | {"day": day, "status": "finished"}

    with ThreadPoolExecutor(plain_count(at_once, "at_once")) as pool:
        return list(pool.map(one, sorted(days)))


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows (a session, a day) as JSON lines; never over another."""
    report.write.mode("errorifexists").json(path)


def preflight(events: DataFrame) -> DataFrame:
    """session, ok: a log begins with a snapshot clear, or with a clear and a whole snapshot before any live order event."""
    live = F.col("action").isin("A", "M", "C") & ~F.col("is_snapshot")
    firsts = events.groupBy("session").agg(
        F.min("source_row").alias("first"),
        F.min(F.when((F.col("action") == "R") & F.col("is_snapshot"), F.col("source_row"))).alias("snapshot_clear"),
        F.min(F.when(F.col("action") == "R", F.col("source_row"))).alias("clear"),
        F.min(F.when(F.col("is_snapshot") & F.col("is_last"), F.col("source_row"))).alias("snapshot_end"),
        F.min(F.when(live, F.col("source_row"))).alias("live"),
    )
    whole = (F.col("clear") == F.col("first")) & F.col("snapshot_end").isNotNull() & (F.col("live").isNull() | (F.col("snapshot_end") < F.col("live")))
    return firsts.select("session", F.coalesce((F.col("snapshot_clear") == F.col("first")) | whole, F.lit(False)).alias("ok"))


def contiguous(ranges: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """Ranges that don't begin where the one before ends, with what is wrong: 'gap' or 'overlap'."""
    before = F.lag(stop).over(Window.partitionBy("session").orderBy(start, stop))
    rows = ranges.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col(start) != F.col("before")))
    return rows.withColumn("problem", F.when(F.col(start) > F.col("before"), "gap").otherwise("overlap"))


# --- request planning ---


def parse_utc(text: str) -> datetime:
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def plan_requests(start: str, end: str, rolls: list[str] = ()) -> list[tuple[str, str]]:
    """Half-open UTC intervals of [start, end), cut at weekday midnights and at symbol rolls."""
    a, b = parse_utc(start), parse_utc(end)
    if a >= b:
        raise ValueError("the start must lie before the end")
    day = a.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=1)
    cuts = {parse_utc(x) for x in rolls}
    while day < b:
        if day.weekday() < 5:
            cuts.add(day)
        day += timedelta(days=1)
    marks = [a, *sorted(c for c in cuts if a < c < b), b]
    return [(x.isoformat(), y.isoformat()) for x, y in zip(marks, marks[1:], strict=False)]


def weekday_sessions(spark: SparkSession, first: str, count: int) -> DataFrame:
    """The first `count` weekdays from a date on."""
    if isinstance(count, bool) or not isinstance(count, int) or count < 1:
        raise ValueError("the number of sessions must be a positive whole number")
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", first):
        raise ValueError(f"{first!r} is no date")
    days = spark.sql(f"select explode(sequence(date'{first}', date_add(date'{first}', {2 * count + 7}), interval 1 day)) as day")
    return days.filter(F.weekday("day") <= 4).orderBy("day").limit(count)


def stable_seed(seed: int, date: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{date}".encode()).digest()[:4], "big") % (2**32 - 1)
