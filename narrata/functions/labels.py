"""Labels and small classifications shown to listeners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.functions.rules import STRIP

# States of a conversion, as they are shown, and the colour class of each.
STATUS_LABELS = {"idle": "Not started", "starting": "Starting…", "running": "Generating", "paused": "Paused", "stopped": "Stopped", "stalled": "Stalled", "ready": "Ready", "error": "Error"}
STATUS_CLASSES = {"running": "running", "starting": "running", "paused": "stalled", "stalled": "stalled", "stopped": "stalled", "ready": "ready", "error": "error"}
# Voices by language code (first letter) and sex (second letter).
LANGUAGES = {"a": "American English", "b": "British English", "e": "Spanish", "f": "French", "h": "Hindi", "i": "Italian", "j": "Japanese", "p": "Brazilian Portuguese", "z": "Mandarin Chinese"}
VOICES = (
    "af_alloy af_aoede af_bella af_heart af_jessica af_kore af_nicole af_nova af_river af_sarah af_sky am_adam am_echo am_eric am_fenrir am_liam am_michael am_onyx am_puck am_santa "
    "bf_alice bf_emma bf_isabella bf_lily bm_daniel bm_fable bm_george bm_lewis ef_dora em_alex em_santa ff_siwis hf_alpha hf_beta hm_omega hm_psi if_sara im_nicola "
    "jf_alpha jf_gongitsune jf_nezumi jf_tebukuro jm_kumo pf_dora pm_alex pm_santa zf_xiaobei zf_xiaoni zf_xiaoxiao zf_xiaoyi zm_yunjian zm_yunxi zm_yunxia zm_yunyang"
).split()


def lookup(c: Column, values: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), default)


def status_label(c: Column) -> Column:
    return lookup(c, STATUS_LABELS, c)


def status_class(c: Column) -> Column:
    return lookup(c, STATUS_CLASSES, F.lit(""))


def voices(spark: SparkSession) -> DataFrame:
    """``id, name, language, gender, label`` of every voice (a fixed list)."""
    v = spark.createDataFrame([(x,) for x in VOICES], "id string")
    language = lookup(F.substring("id", 1, 1), LANGUAGES, F.lit("Unknown"))
    gender = F.when(F.substring("id", 2, 1) == "f", "female").otherwise("male")
    return v.select("id", F.col("id").alias("name"), language.alias("language"), gender.alias("gender"), F.concat(F.initcap(F.replace("id", F.lit("_"), F.lit(" "))), F.lit(" — "), language, F.lit(" · "), F.initcap(gender)).alias("label"))


def position(title: Column, chapter: Column, chunk: Column, total: Column, phase: Column) -> Column:
    """Where a run is: chapter, chunk and phase, as far as known."""
    name = F.coalesce(F.nullif(STRIP(title), F.lit("")), F.concat(F.lit("Chapter "), chapter.cast("string")))
    part = F.concat(F.lit("chunk "), chunk.cast("string"), F.coalesce(F.concat(F.lit(" / "), total.cast("string")), F.lit("")))
    return F.concat_ws(" · ", name, part, F.nullif(phase, F.lit("")))


def progress(hint: Column, abs_time_s: Column, time_s: Column) -> Column:
    """What is said of a book's listening place."""
    at = lambda c: F.when(c.isNotNull() & ~F.isnan(c), F.concat(F.lit("At "), T.clock(c)))
    return F.coalesce(F.nullif(hint, F.lit("")), at(abs_time_s), at(time_s))


def percent_read(done: Column, total: Column) -> Column:
    return F.when(done.isNotNull() & (total > 0), F.least(F.lit(100), F.floor(done / total * 100 + 0.5))).cast("int")


def cache_route(path: Column, media: Column) -> Column:
    """How a request is cached: ``network_first`` or ``cache_first``, by path and media file."""
    kind = F.lower(F.regexp_extract(F.coalesce(media, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when((path == "/media") & kind.isin("epub", "wav", "mp3", "m4a", "m4b", "m3u8", "ts"), "cache_first")
        .when(path.startswith("/api/") | (path == "/media"), "network_first")
        .when(path.startswith("/assets/") | path.rlike(r"\.(svg|png|ico)$"), "cache_first")
        .otherwise("network_first")
    )


def inside(path: Column, root: Column) -> Column:
    """Whether a normalised path lies in a folder, without steps upwards."""
    return ~F.concat(F.lit("/"), path, F.lit("/")).contains("/../") & ((path == root) | F.startswith(path, F.concat(root, F.lit("/"))))


def concat_list(paths: Column) -> Column:
    """Lines of a concatenation list, single quotes escaped."""
    return F.concat(F.array_join(F.transform(paths, lambda p: F.concat(F.lit("file '"), F.replace(p, F.lit("'"), F.lit("'\\''")), F.lit("'"))), "\n"), F.lit("\n"))


def fingerprint(path: Column, size: Column, modified: Column) -> Column:
    """What a file is recognised by; a missing file has no size."""
    return F.when(size.isNull(), F.concat(path, F.lit("|missing"))).otherwise(F.concat_ws("|", path, size.cast("string"), F.unix_micros(modified).cast("string")))


def metrics(total_kb: Column, free_kb: Column) -> Column:
    """``struct<total_gb, used_gb, percent>``; 0 percent of nothing."""
    used = total_kb - free_kb
    return F.struct(F.round(total_kb / 1048576, 2).alias("total_gb"), F.round(used / 1048576, 2).alias("used_gb"), F.coalesce(F.round(F.try_divide(used * 100, total_kb), 1), F.lit(0.0)).alias("percent"))
