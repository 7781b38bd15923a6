"""JSON records: crawled pages, chat logs, lorebooks, external observations. Each reads with an explicit schema, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRAWL = "url string, canonical_url string, title string, text string, fetched_at string, source_type string, meta map<string,string>"
EVENT = "event_id string, dedupe_key string, timeline_id string, speaker_role string, text string, occurred_at timestamp, superseded_at timestamp"
_HEADER = "user_name string, character_name string, create_date string, chat_metadata string"
_MESSAGE = "name string, is_user boolean, is_system boolean, send_date string, mes string, swipes array<string>, extra map<string,string>"
_ENTRY = T.MapType(T.StringType(), T.StructType([T.StructField(n, t) for n, t in (("comment", T.StringType()), ("content", T.StringType()), ("key", T.ArrayType(T.StringType())), ("disable", T.BooleanType()))]))


def crawl(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Crawl records; a stream's checkpoint takes the place of byte offsets."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(CRAWL).json(path)


def crawl_paragraphs(records: DataFrame) -> DataFrame:
    """(url, digest, k, paragraph) of admitted records, once per URL and text."""
    from ..functions import text as X

    admitted = records.filter(X.url_admission(F.col("url")).isNull() & X.page_admission(F.col("title"), F.col("text")).isNull())
    whole = admitted.select(X.normalize_url(F.coalesce("canonical_url", "url")).alias("url"), F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["url", "digest"])
    return whole.select("url", "digest", F.posexplode(X.windows(F.col("text"))).alias("k", "paragraph"))


def chat_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, character_name, user_name, k, role, name, sent, text, swipes) of chat logs, one JSON object a line, the first being the header.

    Logs whose header names no character or user are left out. A date keeps its text: a time zone is not invented. Lines keep their order by file and
    place, so a file is read by one task.
    """
    return chat_messages(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def chat_messages(logs: DataFrame) -> DataFrame:
    """chat_logs() of whole files (file, value); all of it stays within a row, so that streams of files can be read as well."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    head = logs.withColumn("lines", lines).withColumn("h", F.from_json(F.get("lines", F.lit(0)), _HEADER))
    head = head.filter("trim(coalesce(h.character_name, '')) != '' and trim(coalesce(h.user_name, '')) != ''")
    said = head.select("file", "h.character_name", "h.user_name", F.posexplode(F.slice("lines", F.lit(2), F.greatest(F.lit(0), F.size("lines") - 1))).alias("k", "line")).withColumn("m", F.from_json("line", _MESSAGE)).filter("m.mes is not null")
    role = F.when(F.col("m.is_system"), "system").when(F.col("m.is_user"), "user").otherwise("assistant")
    return said.select("file", "character_name", "user_name", "k", role.alias("role"), F.col("m.name").alias("name"), F.col("m.send_date").alias("sent"), F.col("m.mes").alias("text"), F.coalesce("m.swipes", F.array().cast("array<string>")).alias("swipes"))


def chat_stream(spark: SparkSession, path: str) -> DataFrame:
    """chat_messages() of a stream of files: a log that is written anew is read anew; poll() with the keys file and k appends what is new."""
    return chat_messages(spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def crawl_lines(pages: DataFrame) -> DataFrame:
    """Crawl records (CRAWL) of pages as JSON lines (value), for append-only files."""
    return pages.select(F.to_json(F.struct(*[F.col(c) for c in pages.columns])).alias("value"))


def lorebook(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, title, text, keys) of lorebooks: a JSON object with entries by name, or a list of them; disabled and empty entries are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.get_json_object("value", "$.entries").alias("e"))
    item = "struct<comment:string,content:string,key:array<string>,disable:boolean>"
    named = F.when(F.startswith(F.ltrim("e"), F.lit("[")), F.map_from_entries(F.transform(F.from_json("e", f"array<{item}>"), lambda x, k: F.struct(k.cast("string"), x)))).otherwise(F.from_json("e", _ENTRY))
    rows = whole.select("file", F.explode(named).alias("entry", "v")).filter("not coalesce(v.disable, false) and trim(coalesce(v.content, '')) != ''")
    return rows.select("file", "entry", F.coalesce("v.comment", F.element_at("v.key", 1)).alias("title"), F.col("v.content").alias("text"), F.coalesce("v.key", F.array().cast("array<string>")).alias("keys"))


def observation(rows: DataFrame, source: str, timeline: str = "liminal") -> DataFrame:
    """External observations (external_id, text, occurred_at) as events of a timeline, attributed to their source."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(source), "external_id"), 256)
    return rows.select(key.alias("event_id"), key.alias("dedupe_key"), F.lit(timeline).alias("timeline_id"), F.lit("external").alias("speaker_role"), "text", F.col("occurred_at").cast("timestamp").alias("occurred_at"), F.lit(None).cast("timestamp").alias("superseded_at"))
