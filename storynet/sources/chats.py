"""Reading, versioning and storing chat messages, replies and results."""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINE = "mes string, name string, is_user boolean, is_system boolean, swipe_id long, send_date string"


def read_chat_messages(spark: SparkSession, path: str, prefix: str = "source_") -> DataFrame:
    """JSONL chats, one file each: chat_id, floor, source_id, version, ref, role, speaker, raw_content, content.

    Lines without ``mes`` are skipped, a malformed line fails the read; floors are physical lines unless given. Files are read
    whole, since a split read loses line numbers; only newlines end a line. A host writes a message's floor, id and version into
    ``extra`` under names that begin with ``prefix``.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("chat_id"), F.posexplode(F.split("value", "\n")).alias("line", "json")
    )
    line = f"{LINE}, extra struct<{prefix}floor:bigint,{prefix}id:string,{prefix}version:string>"
    rows = files.filter("trim(json) <> ''").withColumn("m", F.from_json("json", line, {"mode": "FAILFAST"})).filter("m.mes is not null")
    role = F.when(F.col("m.is_system"), "system").when(F.col("m.is_user"), "user").otherwise("assistant")
    floor = F.coalesce(f"m.extra.{prefix}floor", F.col("line").cast("long"))
    rows = rows.select(
        "chat_id", floor.alias("floor"), role.alias("role"), F.col("m.name").alias("speaker"), F.col("m.mes").alias("raw_content"),
        F.replace(F.col("m.mes"), F.lit("\0"), F.lit("")).alias("content"),
        F.coalesce(f"m.extra.{prefix}id", F.concat(F.lit("floor-"), floor.cast("string"))).alias("source_id"),
        F.coalesce(f"m.extra.{prefix}version", F.sha2("m.mes", 256)).alias("version"),
    )
    return rows.withColumn("ref", source_ref())


def source_ref() -> Column:
    """m{floor}.{first 12 of version}.{role}."""
    return F.concat(F.lit("m"), F.col("floor").cast("string"), F.lit("."), F.left("version", F.lit(12)), F.lit("."), F.col("role"))


def stamp_versions(messages: DataFrame) -> DataFrame:
    """Adds version, a digest of all that an edit can change (text, speaker, kind of speaker, swipe, id), and ref.

    ``messages``(floor, role, content, source_id) may have speaker and swipe_id; a speaker without a name is called by what it is.
    """
    has = lambda c: F.col(c).cast("string") if c in messages.columns else F.lit(None).cast("string")
    is_user, is_system = F.col("role") == "user", F.col("role") == "system"
    name = F.coalesce(F.nullif(has("speaker"), F.lit("")), F.when(is_user, "user").otherwise("assistant"))
    flags = [F.coalesce(x, F.lit(False)).cast("string") for x in (is_user, is_system)]
    parts = [F.coalesce("content", F.lit("")), name, *flags, F.coalesce(has("swipe_id"), F.lit("null")), F.coalesce("source_id", F.concat(F.lit("floor-"), F.col("floor").cast("string")))]
    parts = F.to_json(F.array(*parts))
    return messages.withColumn("version", F.sha2(parts, 256)).withColumn("ref", source_ref())


def new_sources(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stored`` and ``new`` have chat_id, ref, sha: the records of ``new`` to add, and conflicts (same ref, other digest), which keep the old.

    Of several contents of one new ref that with the least digest is added, and the others are conflicts with it.
    """
    keys = ["chat_id", "ref"]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("sha"))
    added = new.join(stored.select(*keys), keys, "left_anti").withColumn("rank", rank).filter("rank = 1").drop("rank")
    old = stored.unionByName(added.select(*stored.columns)).select(*keys, F.col("sha").alias("kept_sha"))
    conflicts = new.join(old, keys).filter("sha <> kept_sha").select(*keys, "kept_sha", F.col("sha").alias("new_sha")).distinct()
    return added.select(*new.columns), conflicts


def append_sources(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All records with the new ones of ``new_sources`` added, and the conflicts."""
    added, conflicts = new_sources(stored, new)
    return stored.unionByName(added), conflicts


def read_entities(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows``(chat_id, entity_json): entities (chat_id, id, type, description) and components (chat_id, entity_id, entity_type, component, schema_version, data)."""
    shell = F.from_json("entity_json", "id string, type string, description string, components map<string,string>")
    parsed = rows.select("chat_id", shell.alias("e"))
    entities = parsed.select("chat_id", "e.id", "e.type", "e.description")
    each = parsed.select("chat_id", F.col("e.id").alias("entity_id"), F.col("e.type").alias("entity_type"), F.explode("e.components").alias("component", "body"))
    return entities, each.select(
        "chat_id", "entity_id", "entity_type", "component",
        F.get_json_object("body", "$.schema_version").alias("schema_version"), F.get_json_object("body", "$.data").alias("data"),
    )


STATUSES = ("ok", "ok_after_trailing_comma", "array_reply", "no_object", "truncated", "multiple_objects", "not_object")


def scan_reply(text: str) -> tuple[str | None, str]:
    """The single top-level JSON object of a reply and its status; brackets are never added."""
    start, depth, quoted, escaped, spans = -1, 0, False, False, []
    head = text.lstrip()
    if head.startswith("["):
        return None, "array_reply"
    for i, c in enumerate(text):
        if depth and quoted:
            escaped, quoted = (c == "\\" and not escaped), (c != '"' or escaped)
        elif depth and c == '"':
            quoted = True
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                spans.append((start, i + 1))
    if depth:
        return None, "truncated"
    if not spans:
        return None, "no_object"
    if len(spans) > 1:
        return None, "multiple_objects"
    body = text[spans[0][0] : spans[0][1]]
    for found, status in ((body, "ok"), (_without_trailing_commas(body), "ok_after_trailing_comma")):
        try:
            return (found, status) if isinstance(json.loads(found), dict) else (None, "not_object")
        except ValueError:
            continue
    return None, "not_object"


def _without_trailing_commas(body: str) -> str:
    out, quoted, escaped = [], False, False
    for c in body:
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), (c != '"' or escaped)
        elif c == '"':
            quoted = True
        elif c in "}]":
            k = len(out) - 1
            while k >= 0 and out[k].isspace():
                k -= 1
            if k >= 0 and out[k] == ",":
                del out[k]
        out.append(c)
    return "".join(out)


def triage_replies(replies: DataFrame) -> DataFrame:
    """Adds plan (JSON text of the reply's object, or null) and status to ``replies`` with a column reply."""
    wrapped = replies.select(F.struct("*").alias("row"), "reply")

    def scan(batches):
        for b in batches:
            found = [scan_reply(t or "") for t in b.column("reply").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], ["row", "plan", "status"])

    kind = wrapped.select("row", F.lit(None).cast("string").alias("plan"), F.lit(None).cast("string").alias("status")).schema
    return wrapped.mapInArrow(scan, kind).select("row.*", "plan", "status")


def _files(spark: SparkSession, path: str):
    """A path of the shared store and its file system, by Spark's own Hadoop client."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, folder: str, batch_key: str):
    return _files(spark, f"{folder}/_commits/{hashlib.sha256(batch_key.encode()).hexdigest()}.json")


def is_committed(spark: SparkSession, folder: str, batch_key: str) -> bool:
    at, fs = _manifest(spark, folder, batch_key)
    return fs.exists(at)


def write_commit(tables: dict[str, DataFrame], folder: str, batch_key: str, partition_by: str | None = None) -> bool:
    """Writes all tables of one batch, state and receipts alike, then its manifest: readers use committed keys only, and a key commits once.

    The manifest is a file named by the key, created only if it is not there, which the store decides: of several writers one commits, and what
    the others wrote is never read and goes.
    """
    spark = next(iter(tables.values())).sparkSession
    at, fs = _manifest(spark, folder, batch_key)
    if fs.exists(at):
        return False
    commit = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("append").partitionBy(*([partition_by] if partition_by else [])).parquet(f"{folder}/{name}/commit_id={commit}")
    fs.mkdirs(at.getParent())
    try:
        out = fs.create(at, False)
    except Py4JJavaError as error:
        if fs.exists(at):
            for name in tables:
                fs.delete(_files(spark, f"{folder}/{name}/commit_id={commit}")[0], True)
            return False
        raise error
    out.write(bytearray(json.dumps({"batch_key": batch_key, "commit_id": commit}).encode()))
    out.close()
    return True


def committed_keys(spark: SparkSession, folder: str) -> DataFrame:
    schema = "batch_key string, commit_id string"
    at, fs = _files(spark, f"{folder}/_commits")
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{folder}/_commits").filter("commit_id is not null")


def read_committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return rows.join(committed_keys(spark, folder).select("commit_id"), "commit_id", "left_semi").drop("commit_id")


#: Folders of the audit log; a chat's entries lie in one of them.
AUDIT_PARTS = 64


def append_audit(spark: SparkSession, folder: str, entries: DataFrame) -> None:
    """``entries``(chat_id, category, action, detail): appended with the time, by a hash of the chat."""
    part = F.pmod(F.xxhash64("chat_id"), F.lit(AUDIT_PARTS)).cast("int")
    entries.withColumn("at", F.current_timestamp()).withColumn("part", part).write.mode("append").partitionBy("part").parquet(folder)


def read_audit(spark: SparkSession, folder: str, chat_id: str | None = None) -> DataFrame:
    """The log, or one chat's, for which one folder is read."""
    rows = spark.read.parquet(folder)
    if chat_id is not None:
        part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(chat_id)), F.lit(AUDIT_PARTS)).cast("int")).first()[0]
        rows = rows.filter((F.col("part") == part) & (F.col("chat_id") == chat_id))
    return rows.drop("part")


def state_report(events: DataFrame, memories: DataFrame, sources: DataFrame) -> DataFrame:
    """Per chat: events by status, memories, messages, characters and distinct versions of the sources."""
    by = events.groupBy("chat_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("forming", "pending_finalization", "finalized")]
    )
    own = memories.groupBy("chat_id").agg(F.count("*").alias("n_memories"))
    texts = sources.groupBy("chat_id").agg(
        F.count("*").alias("n_messages"), F.sum(F.length("content")).alias("n_chars"), F.countDistinct("version").alias("n_versions")
    )
    out = texts.join(by, "chat_id", "left").join(own, "chat_id", "left")
    return out.fillna(0, ["n_forming", "n_pending_finalization", "n_finalized", "n_memories"])
