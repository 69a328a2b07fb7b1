"""Index jobs, run listings and the catalog joined with its runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions.rules import STRIP
from narrata.operators import runs

# A job of which nothing is stored.
DEFAULT_JOB = {"status": "idle", "stage": "idle", "message": "", "current": 0, "total": 0, "percent": 0}


def with_defaults(books: DataFrame, jobs: DataFrame) -> DataFrame:
    """A job for every book: stored fields win, the rest is the default job.

    ``books(book_id)``, ``jobs(book_id, status, stage, message, current, total,
    percent, error)``; several rows of a book count as one, by its least values.
    """
    fields = [*DEFAULT_JOB, "error"]
    stored = jobs.groupBy("book_id").agg(F.min(F.struct(*fields)).alias("j"))
    j = books.select("book_id").distinct().join(stored, "book_id", "left")
    return j.select("book_id", *[F.coalesce(F.col(f"j.{f}"), F.lit(v)).alias(f) for f, v in DEFAULT_JOB.items()], F.col("j.error").alias("error"))


def ready(count: Column) -> Column:
    return F.concat(F.lit("Passage index ready ("), count.cast("string"), F.lit(" passages)"))


def status_view(jobs: DataFrame, index: DataFrame) -> DataFrame:
    """What is said of each book's job: an index that exists counts as done, whatever the job says.

    ``jobs`` as of :func:`with_defaults`, ``index(book_id, passage_count,
    embedding_model)`` of books that have one.
    """
    j = jobs.join(index.where("passage_count > 0").select("book_id", F.col("passage_count").alias("n"), F.col("embedding_model").alias("m")), "book_id", "left")
    n, has = F.col("n"), F.col("n").isNotNull()
    idle = (F.col("status") == "idle") & (F.col("message") == "")
    said = F.when(has, ready(n)).when(idle, F.lit("No passage index yet.")).otherwise(F.col("message"))
    return j.select(
        "book_id", F.when(has, "done").otherwise(F.col("status")).alias("status"), F.when(has, "complete").otherwise(F.col("stage")).alias("stage"), said.alias("message"),
        F.when(has, n).otherwise(F.col("current")).cast("long").alias("current"), F.when(has, n).otherwise(F.col("total")).cast("long").alias("total"), F.when(has, 100).otherwise(F.col("percent")).cast("int").alias("percent"),
        n.cast("long").alias("passage_count"), F.col("m").alias("embedding_model"), F.when(~has, F.col("error")).alias("error"),
    )


def completed(done: DataFrame) -> DataFrame:
    """Jobs that ended well: ``done(book_id, passage_count, embedding_model)``; a negative or null count is 0, a blank model unknown."""
    n = F.greatest(F.lit(0), F.coalesce("passage_count", F.lit(0)))
    model = F.coalesce(F.nullif(STRIP(F.coalesce("embedding_model", F.lit(""))), F.lit("")), F.lit("unknown"))
    return done.select("book_id", F.lit("done").alias("status"), F.lit("complete").alias("stage"), ready(n).alias("message"), n.alias("current"), n.alias("total"), F.lit(100).alias("percent"), model.alias("embedding_model"), F.lit(None).cast("string").alias("error"))


def failed(errors: DataFrame) -> DataFrame:
    """Jobs that ended in an error, whose blank text becomes a general one: ``errors(book_id, error)``."""
    text = F.coalesce(F.nullif(STRIP(F.coalesce("error", F.lit(""))), F.lit("")), F.lit("Indexing failed"))
    return errors.select("book_id", F.lit("error").alias("status"), F.lit("error").alias("stage"), text.alias("message"), text.alias("error"))


#: Where runs lie: an output folder, or a book's folder in the library's runs.
_RUN = r"^((?:out[^/]*|library/runs/[^/]+)/([^/]+))/(status\.json$|manifest\.json$|events\.jsonl$|chapters/)"


def run_dirs(files: DataFrame) -> DataFrame:
    """``path, name, updated_at, legacy`` of each run folder in a listing ``files(path, modified)``.

    A folder is a run if it holds a status, a manifest or chapters. The time is
    that of its latest status, event log or folder entry; ``legacy`` runs have no
    status of their own.
    """
    what = F.regexp_extract("path", _RUN, 3)
    f = files.select(F.regexp_extract("path", _RUN, 1).alias("run"), F.regexp_extract("path", _RUN, 2).alias("name"), what.alias("what"), "modified").where("run <> ''")
    g = f.groupBy(F.col("run").alias("path"), "name").agg(F.max("modified").alias("updated_at"), (~F.bool_or(F.col("what") == "status.json")).alias("legacy"), F.bool_or(F.col("what") != "events.jsonl").alias("is_run"))
    return g.where("is_run").drop("is_run")


def default_run(dirs: DataFrame) -> DataFrame:
    """The newest run, which is shown if none is named (none of an empty listing)."""
    return dirs.agg(F.max_by(F.struct(*dirs.columns), F.struct("updated_at", "path")).alias("r")).where("r IS NOT NULL").select("r.*")


def chosen_run(dirs: DataFrame, path: str | None) -> DataFrame:
    return dirs.where(F.col("path") == path) if path else default_run(dirs)


def legacy_status(chapters: DataFrame) -> DataFrame:
    """A run's status from its chapter folders alone.

    ``chapters(book_id, chapter, slug, n_txt, n_wav, n_cache, n_empty,
    elapsed_s, modified, has_output)``. Counts are summed, the phase follows
    from what exists, and the current chapter is the one touched last.
    """
    total = F.greatest("n_txt", "n_wav", "n_cache")
    done = F.greatest("n_txt", "n_cache")
    g = chapters.groupBy("book_id").agg(
        F.count("*").alias("total_chapters"), F.sum(total).alias("total_chunks"), F.sum(done).alias("rewrite_done"), F.sum("n_wav").alias("tts_done"), F.sum("n_empty").alias("empty_rewrites"), F.round(F.sum(F.coalesce("elapsed_s", F.lit(0.0))), 3).alias("rewrite_elapsed_s"),
        F.bool_or("has_output").alias("has_output"), F.max("modified").alias("activity"), F.max_by(F.struct("chapter", "slug", done.alias("chunk"), total.alias("of")), F.struct("modified", -F.col("chapter"))).alias("c"),
    )
    phase = F.when(F.col("has_output"), "done").when(F.col("tts_done") > 0, "tts").otherwise("rewriting")
    return g.select("book_id", "total_chapters", "total_chunks", "rewrite_done", "tts_done", "empty_rewrites", "rewrite_elapsed_s", phase.alias("phase"), "activity", F.col("c.chapter").alias("current_chapter"), F.col("c.slug").alias("current_slug"), F.col("c.chunk").alias("chunk_index"), F.col("c.of").alias("chunk_total"))


def anomalies(chunks: DataFrame) -> DataFrame:
    """Chunks whose rewritten text came out empty: ``book_id, type, chapter_index, chunk_index``."""
    empty = STRIP(F.coalesce("rewritten", F.lit(""))) == ""
    return chunks.where(empty).select("book_id", F.lit("empty_rewrite_chunk").alias("type"), "chapter_index", "chunk_index")


def chunk_reuse(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Each chunk with whether its audio can be used again: a file of its name that is not empty.

    ``chunks(book_id, chapter_index, chunk_index)``, ``files(book_id,
    chapter_index, name, size)``.
    """
    here = files.where("size > 0").select("book_id", "chapter_index", F.regexp_extract("name", r"^chunk-(\d+)\.wav$", 1).alias("n")).where("n <> ''").select("book_id", "chapter_index", F.col("n").cast("int").alias("chunk_index"), F.lit(True).alias("reused")).distinct()
    keys = ["book_id", "chapter_index", "chunk_index"]
    return chunks.join(here, keys, "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def rewrite_plan(policy: str, selective: Column, reason: Column) -> tuple[Column, Column]:
    """``(whether a chunk goes to the model, why)`` under a policy; only ``selective`` looks at the chunk."""
    if policy == "selective":
        return selective, reason
    return F.lit(policy == "full"), F.lit("full_rewrite_policy" if policy == "full" else "script_only_policy")


def rewritten(answer: Column, deterministic: Column, sanitized: Column, preserved: Column) -> Column:
    """``struct<text, fallback>``: the model's text, or the first cleaned form that says something."""
    blank = lambda c: F.nullif(STRIP(F.coalesce(c, F.lit(""))), F.lit(""))
    said = blank(answer).isNotNull()
    rest = F.coalesce(F.when(deterministic != "", deterministic), F.when(sanitized != "", sanitized), preserved)
    return F.struct(F.when(said, answer).otherwise(rest).alias("text"), (~said).alias("fallback"))


def media_url(path: Column) -> Column:
    """The address a file is served under; only plain path characters stay as they are."""
    return F.concat(F.lit("/media?path="), F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def catalog_with_runs(books: DataFrame, summaries: DataFrame, events: DataFrame, n: int = 40) -> DataFrame:
    """Every book with its run, if it has one: phase, the number and last kind of its ``n`` last events, and where its output is served.

    ``books(id, run_relpath)``, ``summaries(path, phase, output)``,
    ``events(path, pos, event)``.
    """
    t = runs.tail(events, "path", [F.desc("pos")], n).groupBy("path").agg(F.count("*").alias("n_events"), F.max_by("event", "pos").alias("last_event"))
    s = summaries.join(t, "path", "left").select("path", "phase", F.coalesce("n_events", F.lit(0)).alias("n_events"), "last_event", media_url(F.col("output")).alias("final_audio"), F.lit(True).alias("has_run"))
    b = books.withColumn("path", F.nullif("run_relpath", F.lit("")))
    return b.join(s, "path", "left").drop("path").withColumn("has_run", F.coalesce("has_run", F.lit(False)))


def first_and_more(rows: DataFrame, key: str, order: list[Column], n: int = 12) -> DataFrame:
    """The first ``n`` rows of each key, and how many more there are (``more``); counts are aggregated before the join."""
    w = Window.partitionBy(key).orderBy(*order)
    first = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    count = rows.groupBy(key).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return first.join(count, key)


def sample_rate(config: Column) -> Column:
    """The rate a voice's JSON configuration states, wherever it does; null for zero, text or broken JSON."""
    at = lambda path: F.nullif(F.try_to_number(F.get_json_object(config, path), F.lit("999999999")).cast("int"), F.lit(0))
    return F.coalesce(at("$.sample_rate"), at("$.sampleRate"), at("$.audio.sample_rate"))


def wav_seconds(header: Column) -> Column:
    """Length of a RIFF/WAVE file from its first 44 bytes: data bytes by bytes a second; null if it is no such header."""
    le = lambda at, n: F.conv(F.concat(*[F.hex(F.substring(header, at + i, 1)) for i in reversed(range(n))]), 16, 10).cast("long")
    ok = (F.length(header) >= 44) & (F.hex(F.substring(header, 1, 4)) == "52494646") & (F.hex(F.substring(header, 9, 8)) == "57415645666D7420") & (F.hex(F.substring(header, 37, 4)) == "64617461")
    return F.when(ok, F.try_divide(le(41, 4).cast("double"), le(29, 4).cast("double")))


def live_order(chunks: DataFrame) -> DataFrame:
    """The order in which a live playlist takes chunks: by chapter and chunk, only up to the first that is missing in each book.

    ``chunks(book_id, chapter_index, chunk_index, ready)``.
    """
    at = F.struct("chapter_index", "chunk_index")
    gap = chunks.groupBy("book_id").agg(F.min(F.when(~F.col("ready"), at)).alias("gap"))
    c = chunks.join(gap, "book_id").where(F.col("gap").isNull() | (at < F.col("gap")))
    return c.drop("gap").withColumn("position", F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_index", "chunk_index")))
