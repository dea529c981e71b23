"""The library's input tables as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, if its files are fewer: for rows that cost much more to compute than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def k_of() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", k_of()).withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: a user is a recording, an event is an event."""
    kind = F.when(F.col("event_type").isin("error", "view"), F.lit("self-death")).otherwise(F.lit("own-kill"))
    action = F.when(F.col("event_type").isin("error", "click"), F.lit("knock")).otherwise(F.lit("eliminate"))
    e = events(spark, sf_dir)
    return e.select(
        F.col("user_id").alias("source_idx"), F.col("event_id").alias("det_idx"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"),
        F.lit(2592000.0).alias("duration_sec"), (F.col("us") / 1000000.0 - EPOCH).alias("event_sec"), kind.alias("target"), F.concat(kind, F.lit(":"), action, F.lit(":player"), F.col("k").cast("string")).alias("event_key"),
        F.when(F.col("k") < 10, F.lit("molotov")).otherwise(F.concat(F.lit("W"), (F.col("k") % 7).cast("string"))).alias("event_weapon"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("method"),
        F.concat(F.lit("t"), (F.col("event_id") % 11).cast("string")).alias("text"), F.concat(F.lit("0."), (F.col("event_id") % 10).cast("string")).alias("scores"), F.lit("det").alias("detector"), F.lit("en").alias("language"),
        F.lit("1").alias("event_count"), (F.col("event_id") % 5).alias("ocr_requests"), (F.col("event_id") % 4).alias("ocr_successes"), (F.col("event_id") % 3).alias("ocr_cache_hits"), (F.col("event_id") % 2).alias("ocr_skipped"),
        (F.col("event_id") % 6).alias("ocr_coarse_frames"), (F.col("event_id") % 2).alias("ocr_refine_frames"), (F.col("event_id") % 7).cast("double").alias("detect_seconds"), (F.col("event_id") % 9).cast("double").alias("ocr_seconds"),
        F.lit(18000.0).alias("clip_before_sec"), F.lit(3600.0).alias("clip_after_sec"), F.lit("default").alias("context_rule"), F.lit("").alias("event_secs"))


def texts_of(e: DataFrame) -> DataFrame:
    """One on-screen text for each event (user_id, event_id, event_type, k, us), with its language."""
    player, weapon = F.concat(F.lit("Player"), F.col("user_id").cast("string")), F.concat(F.lit("W"), F.col("k").cast("string"))
    kind = F.col("event_type")
    text = (F.when(kind == "click", F.concat(F.lit("YOU KNOCKED OUT "), player, F.lit(" with "), weapon)).when(kind == "purchase", F.concat(F.lit("你用"), weapon, F.lit("淘汰了"), player))
            .when(kind == "signup", F.concat(F.lit("您以"), weapon, F.lit("擊殺"), player)).when(kind == "error", F.concat(player, F.lit(" KNOCKED YOU out with "), weapon)).otherwise(F.lit("你在安全区外倒地了")))
    language = F.when(kind.isin("click", "error"), F.lit("en")).when(kind == "signup", F.lit("zh-Hant")).otherwise(F.lit("zh-Hans"))
    return e.select(F.col("user_id").alias("source_idx"), F.col("event_id"), F.expr("us div 1000").alias("ms"), "event_type", "k", text.alias("text"), language.alias("language"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts_of(spread(events(spark, sf_dir)))


def busy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with two events, an assist, a delayed kill, a death, a scoreboard and none, by the event's id."""
    u, w = F.col("user_id").cast("string"), F.concat(F.lit("W"), F.col("k").cast("string"))
    n, e = F.col("event_id") % 6, spread(events(spark, sf_dir))
    text = (F.when(n == 0, F.concat(F.lit("你使用"), w, F.lit("击倒了A"), u, F.lit("x你用"), w, F.lit("淘汰了B"), u)).when(n == 1, F.concat(F.lit("你用"), w, F.lit("淘汰了A"), u, F.lit("x助攻")))
            .when(n == 2, F.concat(F.lit("你终于淘汰了A"), u)).when(n == 3, F.concat(F.lit("A"), u, F.lit("用"), w, F.lit("淘汰了你\n你在安全区外倒地了"))).when(n == 4, F.concat(F.lit("你用"), w, F.lit("淘汰了A"), u, F.lit("x淘汰数2协助1"))).otherwise(F.lit("大吉大利")))
    return e.select("event_id", "user_id", "k", text.alias("text"), F.lit("zh-Hans").alias("language"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording's file name for each event."""
    kind = F.col("event_type")
    term = (F.when(kind == "click", F.lit("单次淘汰")).when(kind == "purchase", F.lit("Double kill")).when(kind == "signup", F.lit("單次擊殺")).when(kind == "error", F.lit("死亡")).otherwise(F.lit("淘汰")))
    name = F.concat(F.lit("REC "), F.date_format("ts", "yyyy.MM.dd - HH.mm.ss"), F.lit("."), F.col("k").cast("string"), F.lit("."), term, F.lit(".DVR.mp4"))
    e = spread(events(spark, sf_dir))
    return e.select("event_id", "user_id", "value", "ts", name.alias("name"), F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("path"))


def raw_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select(F.col("name").alias("Name"), F.when(F.col("event_id") % 3 == 0, F.col("value") + 1).cast("string").alias("OcrEventSec"), F.col("value").cast("string").alias("EventSec"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report row for each line item; its order is the source."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("source_idx"), F.col("l_linenumber").alias("ordinal"), F.col("l_orderkey").cast("string").alias("Name"), F.when(F.col("l_linestatus") == "F", F.lit("included")).otherwise(F.lit("skipped")).alias("Status"),
                     F.col("l_returnflag").alias("Method"), F.col("l_quantity").alias("DetectSeconds"), F.col("l_tax").alias("OcrSeconds"), F.col("l_partkey").alias("partkey"))


def run_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), "text", F.col("lang").alias("target"), F.col("source").alias("action"))
    return d.filter("frame_id % 10 <> 3"), d.filter("frame_id % 10 <> 7").withColumn("target", F.when(F.col("frame_id") % 4 == 0, F.lit("xx")).otherwise(F.col("target")))


def progress_lines(e: DataFrame) -> DataFrame:
    """Progress lines of events: every fourth number of either kind is absent, so that lines depend on what they inherit."""
    kind, n = F.col("event_type"), F.col("event_id")
    phase = F.when(kind == "click", F.lit("scan")).when(kind == "purchase", F.lit("dedupe")).when(kind == "signup", F.lit("trim")).when(kind == "error", F.lit("merge")).otherwise(F.lit("unknown"))
    return e.select(F.col("user_id").alias("run_id"), n.alias("seq"), phase.alias("phase"), F.when(n % 4 != 1, F.col("k")).cast("bigint").alias("current"), F.when(n % 4 != 2, 30 + n % 60).cast("bigint").alias("total"), "ts")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_lines(events(spark, sf_dir)).withColumn("ts_ms", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000")).drop("ts")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("codec"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    y, h = (F.col("l_linenumber") * 13) % 60, 10 + F.col("l_suppkey") % 20
    return li.select(F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 1000).cast("int").alias("x1"), y.cast("int").alias("y1"), (y + h).cast("int").alias("y2"), F.col("l_linenumber").cast("string").alias("text"), F.col("l_tax").alias("score"))
