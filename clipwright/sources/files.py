"""Recordings and hints as tables: listing, language, order, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: Terms of the file names that each language's recorder writes.
PROFILES = [
    {"language": "zh-Hans", "own": ["被击倒", "淘汰"], "kill": ["单次淘汰", "双次淘汰", "多杀"], "multi": ["双次淘汰", "多杀"], "end": ["比赛结束"], "replay": "淘汰画面|击倒画面"},
    {"language": "zh-Hant", "own": ["被擊倒", "死亡", "淘汰"], "kill": ["單次擊殺", "雙殺", "多殺", "多重擊殺", "擊倒"], "multi": ["雙殺", "多殺", "多重擊殺"], "end": ["對戰結束"], "replay": "死亡畫面|淘汰畫面|擊倒畫面"},
    {"language": "en", "own": ["Knockouted", "Death"], "kill": ["Knockout", "Single kill", "Double kill", "Triple kill", "Multi kill", "Multiple kill"],
     "multi": ["Double kill", "Triple kill", "Multi kill", "Multiple kill"], "end": ["Match end", "End of match", "Match ended", "Match complete", "Game over"], "replay": r"Death\s*cam|Kill\s*cam|Replay"},
]
TARGETS = {"self-death": ("own",), "own-kill": ("kill", "end"), "both": ("own", "kill", "end")}
_TIME = r"(\d{4})\.(\d{2})\.(\d{2})\s*-\s*(\d{2})\.(\d{2})\.(\d{2})"


def list_media(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime, name) of the mp4 files of a folder; contents are not read."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][pP]4").option("recursiveFileLookup", str(recursive).lower()).load(folder)
             .select("path", "length", "modificationTime"))
    return found.withColumn("name", basename(F.col("path")))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _terms(profile: dict, target: str) -> list[str]:
    return [t for kind in TARGETS[target] for t in profile[kind]]


def _suffix(terms: list[str]) -> str:
    return rf"(?iu)\.(?:{'|'.join(terms)})\.DVR(?:_\d+)?\.mp4$"


def is_replay(name: Column, profile: dict) -> Column:
    return F.regexp_like(name, F.lit(f"(?iu)(?:{profile['replay']})"))


def matches_profile(name: Column, profile: dict, target: str) -> Column:
    """The name ends as the profile's recorder writes it for the target, and is no replay."""
    return F.regexp_like(name, F.lit(_suffix(_terms(profile, target)))) & ~is_replay(name, profile)


def _score(name: Column, profile: dict, target: str) -> Column:
    """Signs of the longest term found anywhere in the name, by one pattern that looks at every place."""
    terms = sorted(_terms(profile, target), key=len, reverse=True)
    found = F.regexp_extract_all(name, F.lit(f"(?iu)(?=({'|'.join(terms)}))"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, F.char_length)), F.lit(0))


def _any_replay(name: Column) -> Column:
    return F.regexp_like(name, F.lit(f"(?iu)(?:{'|'.join(p['replay'] for p in PROFILES)})"))


def profile_scores(name: Column, target: str, explicit: bool = False) -> Column:
    """(neg, profile) of each profile that fits, best first: its score, negative, and its place; none for a replay among explicit files."""
    def fit(i: int, profile: dict) -> Column:
        # one score, asked twice
        scored = let(_score(name, profile, target), lambda n: F.when((n > 0) | F.lit(not explicit), F.struct((-F.greatest(n, F.lit(1))).alias("neg"), F.lit(i).alias("profile"))))
        return scored if explicit else F.when(matches_profile(name, profile, target), scored)

    fits = [fit(i, p) for i, p in enumerate(PROFILES)]
    scores = F.array_sort(F.filter(F.array(*fits), lambda x: x.isNotNull()))
    return F.when(~_any_replay(name), scores).otherwise(F.filter(scores, lambda x: F.lit(False))) if explicit else scores


def infer_languages(files: DataFrame, target: str) -> DataFrame:
    """``language`` of each file: its own if one profile fits best, else the best-voted of those that tie.

    Unambiguous files vote for their language; votes rank by number, then by
    total score, then by the profiles' order.  Files out of the target are
    classed by any term they hold and do not vote; those without one get null.
    """
    name = F.col("name")

    def best(scores: Column) -> Column:
        first = F.get(scores, F.lit(0))
        ties = F.transform(F.filter(scores, lambda x: x["neg"] == first["neg"]), lambda x: x["profile"])
        return F.struct(ties.alias("ties"), (-first["neg"]).alias("best"))

    rows = files.withColumn("_fit", let(profile_scores(name, target), best))
    sure = rows.select("_fit").filter(F.size("_fit.ties") == 1)
    votes = sure.groupBy(F.col("_fit.ties")[0].alias("profile")).agg(F.count("*").alias("n"), F.sum("_fit.best").alias("total"))
    # three rows at most: one for each profile
    rank = votes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("total")).alias("t"), "profile"))).alias("_rank"))
    rows = rows.join(F.broadcast(rank), how="cross")
    names = F.array(*[F.lit(p["language"]) for p in PROFILES])

    def chosen(ties: Column) -> Column:
        voted = F.get(F.filter(F.transform("_rank", lambda r: r["profile"]), lambda p: F.array_contains(ties, p)), F.lit(0))
        other = F.get(profile_scores(name, "both", explicit=True), F.lit(0))["profile"]
        return F.get(names, F.when(F.size(ties) == 1, ties[0]).when(F.size(ties) > 1, F.coalesce(voted, ties[0])).otherwise(other))

    return rows.withColumn("language", let(F.col("_fit.ties"), chosen)).drop("_fit", "_rank")


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n"))


def recorded_at(name: Column, strict: bool = False) -> Column:
    """Wall time in a file name as yyyy.MM.dd - HH.mm.ss; null if there is none.  An impossible one is null, or an error if strict."""
    plain = F.concat_ws(" ", F.concat_ws("-", *[F.regexp_extract(name, _TIME, i) for i in (1, 2, 3)]), F.concat_ws(":", *[F.regexp_extract(name, _TIME, i) for i in (4, 5, 6)]))
    found = F.regexp_like(name, F.lit(_TIME))
    time = F.when(found & (F.regexp_extract(name, _TIME, 1) != "0000"), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))
    if strict:
        time = F.when(found & time.isNull(), F.raise_error(F.concat(F.lit("Invalid recording timestamp: "), name)).cast("timestamp_ntz")).otherwise(time)
    return time


def in_time_order(files: DataFrame) -> DataFrame:
    """``source_idx`` from 1: by recorded time, then lower-cased name; files without a time last.

    The number is found by range-partitioned sort: a global row number over the
    small counts of key prefixes, hours or first signs of the name, and a local
    one within each.
    """
    named = F.concat(F.lit("9999"), F.left(F.lower("name"), F.lit(4)))
    rows = files.withColumn("recorded_at", recorded_at(F.col("name"))).withColumn("_day", F.coalesce(F.date_trunc("hour", "recorded_at").cast("string"), named, F.lit("9999")))
    days = rows.groupBy("_day").agg(F.count("*").alias("_n"))
    ahead = days.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_day").orderBy("recorded_at", F.lower("name"), "path"))
    return rows.join(ahead, "_day").withColumn("source_idx", (F.col("_ahead") + within).cast("int")).drop("_day", "_ahead")


def with_flags(files: DataFrame) -> DataFrame:
    """``match_end`` and ``force_full_scan`` by the file's language; both false where that is null."""
    ends, multi = F.lit(False), F.lit(False)
    for p in PROFILES:
        own = F.coalesce(F.col("language") == p["language"], F.lit(False))
        ends = ends | (own & F.regexp_like("name", F.lit(_suffix(p["end"]))))
        multi = multi | (own & F.regexp_like("name", F.lit(_suffix(p["multi"]))))
    return files.withColumn("match_end", ends).withColumn("force_full_scan", ends | multi)


def select_sources(files: DataFrame, target: str, explicit: bool = False) -> DataFrame:
    """The recordings of a run in order: of a folder those that fit the target, of an explicit list all."""
    if not explicit:
        fits = F.lit(False)
        for p in PROFILES:
            fits = fits | matches_profile(F.col("name"), p, target)
        files = files.filter(fits)
    return with_flags(in_time_order(infer_languages(files, target)))


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """(name, hint_sec) of a hint file with a header; see ``hints_of``."""
    return hints_of(spark.read.option("header", True).csv(path))


def hints_of(rows: DataFrame) -> DataFrame:
    """OcrEventSec unless empty, else EventSec; rows without a name or a finite number go."""
    have = [F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in ("OcrEventSec", "EventSec") if c in rows.columns]
    sec = F.coalesce(*have).try_cast("double") if have else F.lit(None).cast("double")
    return (rows.select(F.col("Name").alias("name"), sec.alias("hint_sec"))
            .filter((F.coalesce("name", F.lit("")) != "") & F.col("hint_sec").isNotNull() & ~F.isnan("hint_sec") & (F.abs("hint_sec") < float("inf"))))


def newest(files: DataFrame) -> DataFrame:
    """The path changed last, the larger path on a tie."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def with_hints(sources: DataFrame, hints: DataFrame) -> DataFrame:
    """``hints``: the sorted hint seconds of each source by file name, empty if none."""
    lists = hints.groupBy("name").agg(F.array_sort(F.collect_list("hint_sec")).alias("hints"))
    return sources.join(lists, "name", "left").withColumn("hints", F.coalesce("hints", F.array().cast("array<double>")))


def last_by_line(rows: DataFrame, key: str, line: str) -> DataFrame:
    """The row of each key with the greatest ``line``; rows without a key are passed over."""
    last = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), line).alias("_row"))
    return last.select("_row.*")


def read_json_rows(spark: SparkSession, path: str, schema: str, key: str = "frame_id") -> DataFrame:
    """JSON lines by key, the last of a key winning; blank lines are passed over.

    Lines follow each other by the path of their file, then by the begin of the
    part of the file that a task reads, then by their place in it, so several
    files and files in several parts have one order whatever tasks read them.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).withColumn("_line", place).filter(F.trim("value") != "")
    return last_by_line(lines.select(F.from_json("value", schema).alias("r"), "_line").select("r.*", "_line"), key, "_line").drop("_line")


def resolve_samples(samples: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each sample's base name: one below a folder named original first, then by path; null if there is none."""
    original = F.exists(F.split(F.lower("path"), r"[/\\]"), lambda part: part == "original")
    ranked = files.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(~original, "path"))).filter("_r = 1")
    return samples.join(ranked.select("name", "path"), "name", "left")
