"""String functions: cleaning, slugs, labels, counts. ``Column -> Column``, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions.rules import SQUEEZE, STRIP, WORD, WS, Chain, W, chain, let

NBSP = chain(("\xa0", " "))
BLANKS = chain((r"[ \t]+", " "))
THREE_BREAKS = chain((r"\n{3,}", "\n\n"))
NO_SPACE_BEFORE = chain((rf"[{WS}]+([,.;:!?])", "$1"))

CLEANUP = NBSP + BLANKS + THREE_BREAKS + STRIP
NARRATION = CLEANUP + NO_SPACE_BEFORE + chain((rf"([\[(])[{WS}]+", "$1"), (rf"[{WS}]+([\])])", "$1")) + BLANKS + STRIP

# How long a stage direction is, and what it asks for.
_HOW = "(?:brief|short|tiny|slight)"
_WHAT = "(?:pause|breath|beat|silence|whisper|laugh|sigh)"
SANITIZE = (
    NBSP
    + chain(
        (rf"(?i)\*[{WS}]*{_HOW}?[{WS}]*{_WHAT}[{WS}]*\*", " "),
        (rf"(?i)\([{WS}]*{_HOW}?[{WS}]*{_WHAT}[^)]*\)", " "),
        (rf"(?i)\[[{WS}]*{_HOW}?[{WS}]*{_WHAT}[^\]]*\]", " "),
        # A whole word on either side, twice, as neighbours share the gap.
        *[(rf"(?i)(^|[^{W}]){_HOW}[{WS}]+{_WHAT}($|[^{W}])", "$1 $2")] * 2,
        (r"[*_]", ""),
    )
    + NO_SPACE_BEFORE
    + BLANKS
    + THREE_BREAKS
    + STRIP
)

# Phrases in which "read" is past, and how they are spoken, in order.
READ_RED = (
    ("having read", "having red"), ("had read", "had red"), ("has read", "has red"), ("have read", "have red"), ("was read", "was red"), ("were read", "were red"),
    ("is read", "is red"), ("be read by", "be red by"), ("read by", "red by"), ("as you read the", "as you red the"), ("when you read the", "when you red the"), ("after you read", "after you red"),
)
GLOSSARY = Chain(tuple((rf"(?i)(^|[^{W}]){a}($|[^{W}])", f"$1{b}$2") for a, b in READ_RED for _ in (1, 2)))

_LINES = (
    chain((r"\r\n|\r", "\n"), (rf"([{W}])-\n([{W}])", "$1$2"))
    + chain(*[(r"([^\n])\n([^\n])", "$1 $2")] * 2)
    + chain((r"[\t\x0b\x0c ]+", " "), (r"\n{3,}", "\n\n"), (r" *\n *", "\n"), (rf"\n[{WS}]*\n", "\n\n"))
)
_PAGE_NUMBER = rf"^[{WS}]*\p{{Nd}}+[{WS}]*$"


def strip(c: Column) -> Column:
    """Without Unicode white space around it."""
    return STRIP(c)


def normalize_text(c: Column) -> Column:
    """Paragraphs on lines of their own: wrapped lines joined, white space squeezed, page numbers dropped."""
    lines = F.filter(F.split(_LINES(c), "\n"), lambda x: ~x.rlike(_PAGE_NUMBER))
    return (THREE_BREAKS + STRIP)(F.array_join(F.transform(lines, STRIP), "\n"))


def normalize_text_sql(x: str) -> str:
    return (THREE_BREAKS + STRIP).sql(f"array_to_string(list_transform(list_filter(string_split({_LINES.sql(x)}, chr(10)), lambda l: NOT regexp_matches(l, '{_PAGE_NUMBER}')), lambda l: {STRIP.sql('l')}), chr(10))")


def slugify(c: Column, fallback: str = "chapter") -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, at most 80 characters."""
    s = chain((r"[^a-z0-9]+", "-"), (r"-{2,}", "-"), (r"^-+|-+$", ""))(F.lower(STRIP(c)))
    return chain((r"^-+|-+$", ""))(F.coalesce(F.nullif(F.substring(s, 1, 80), F.lit("")), F.lit(fallback)))


def chapter_slug(index: Column, title: Column) -> Column:
    return F.concat(F.lpad(index.cast("string"), 3, "0"), F.lit("-"), slugify(title))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def rewrite_max_tokens(c: Column, cap: int = 1024) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(256), F.floor(F.length(c) / 3) + 128)).cast("int")



def ffmetadata_value(c: Column) -> Column:
    """Escaped for an ffmetadata file."""
    c = chain((r"\r\n|\r", "\n"))(c)
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("=", "\\="), (";", "\\;"), ("#", "\\#")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c



def snippet(c: Column, most: int = 240) -> Column:
    """White space squeezed; cut to ``most`` characters with an ellipsis."""
    return let(SQUEEZE(c), lambda s: F.when(F.length(s) <= most, s).otherwise(F.concat(chain((rf"[{WS}]+$", ""))(F.substring(s, 1, most - 1)), F.lit("…"))))


def tagged_output(c: Column) -> Column:
    """What stands between the first ``<out>`` tags (even nothing), else everything; stripped."""
    return STRIP(F.when(c.rlike(r"(?is)<out>.*?</out>"), F.regexp_extract(c, r"(?is)<out>(.*?)</out>", 1)).otherwise(c))


def is_packaging_title(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)_epub_c\d+(\.\d+)?_r\d+$")


def without_session_header(c: Column) -> Column:
    return F.regexp_replace(c, r"^session_id:[^\n]*\n?", "")


def filename_guess(name: Column) -> Column:
    """``struct<title, author>`` from ``Title (Author).ext`` or ``Title - Author.ext``."""
    base = STRIP(F.regexp_replace(name, r"\.[^./\\]*$", ""))
    paren = rf"^([\s\S]*?)[{WS}]*\(([^)]+)\)[{WS}]*$"
    last = F.substring_index(base, " - ", -1)
    return (
        F.when(base.rlike(paren), F.struct(STRIP(F.regexp_extract(base, paren, 1)).alias("title"), STRIP(F.regexp_extract(base, paren, 2)).alias("author")))
        .when(base.contains(" - ") & (F.length(last) < 60), F.struct(STRIP(F.regexp_replace(base, r"^([\s\S]*) - [\s\S]*$", "$1")).alias("title"), STRIP(last).alias("author")))
        .otherwise(F.struct(base.alias("title"), F.lit("").alias("author")))
    )


# What an answer can be asked to be.
ACTIONS = ("answer", "explain", "socratic", "challenge", "example", "practice")


def answer_action(c: Column) -> Column:
    n = F.lower(STRIP(c))
    return F.when(n.isin(*ACTIONS), n).otherwise(F.lit("answer"))


def percent(current: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0)).otherwise(F.least(F.lit(100), F.floor(current * 100 / total))).cast("int")


def clock(seconds: Column) -> Column:
    """``h:mm:ss`` or ``m:ss``; a dash where there is no number."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    m, r = F.floor((s % 3600) / 60).cast("long"), (s % 60).cast("long")
    h = F.floor(s / 3600).cast("long")
    return F.when(seconds.isNull() | F.isnan(seconds), F.lit("—")).when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def ago(ts: Column, now: Column) -> Column:
    d = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(ts))
    part = lambda n, u: F.concat(F.floor(d / n).cast("long").cast("string"), F.lit(u))
    return F.when(ts.isNull(), F.lit("—")).when(d < 60, part(1, "s ago")).when(d < 3600, part(60, "m ago")).when(d < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))


CHAPTER_LABEL = chain((r"[^A-Za-z0-9_\t-\r\x20\xa0]", " "), (rf"[{WS}]+", " ")) + STRIP


def chapter_label(c: Column) -> Column:
    return CHAPTER_LABEL(F.lower(F.coalesce(c, F.lit(""))))


def parsed_time(c: Column) -> Column:
    """A timestamp from any of the spellings records use; null where none fits."""
    s = F.trim(c)
    return F.coalesce(
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
    )


# File suffixes and the kinds of content they stand for.
CONTENT_TYPES = {
    "wav": "audio/wav", "m4b": "audio/mp4", "mp3": "audio/mpeg", "m4a": "audio/mp4", "aac": "audio/aac", "m3u8": "application/vnd.apple.mpegurl", "epub": "application/epub+zip",
    "webmanifest": "application/manifest+json; charset=utf-8", "svg": "image/svg+xml; charset=utf-8", "png": "image/png", "js": "text/javascript; charset=utf-8",
}


def content_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit("application/octet-stream"))


def quoted_path(c: Column) -> Column:
    """Percent-encoded, slashes kept and blanks as ``%20``."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def playlist_with_urls(text: Column, folder: Column) -> Column:
    """A playlist whose relative entries point at the media route; blank lines, tags and absolute entries stay."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when((F.trim(x) == "") | x.startswith("#") | x.rlike("^([a-z]+://|/)"), x).otherwise(F.concat(F.lit("/media?path="), quoted_path(F.concat(folder, F.lit("/"), F.trim(x)))))), "\n")


def range_header(header: Column, size: Column) -> Column:
    """``struct<first, last>`` of a byte range, null where it does not fit the size."""
    a, b = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i).try_cast("long") for i in (1, 2))
    first = F.when(a.isNull(), F.greatest(F.lit(0), size - b)).otherwise(a)
    last = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    return F.when(header.rlike(r"^bytes=(\d+-\d*|-\d+)$") & (first < size) & (first <= last), F.struct(first.alias("first"), last.alias("last")))


# Words a title does not begin with, and titles that words call for.
TITLE_STOP = (
    "a an the how what when where why who can could would should do does did is are was were be been being have has had i me my we our you your about "
    "this that these those of in on at to for with from and or but if it its tell give help please"
).split()
TITLE_PHRASES = (
    (("difficult", "coworker"), "Influencing Difficult Coworkers"), (("lazy", "coworker"), "Influencing Difficult Coworkers"), (("coworker", "influence"), "Influencing Difficult Coworkers"),
    (("authority", "cooperation"), "Building Cooperation Without Authority"), (("authority", "without"), "Building Cooperation Without Authority"), (("assumption",), "Testing Assumptions About Workload"),
    (("boundary", "follow"), "Boundaries and Follow-Through"), (("boundary",), "Boundaries and Follow-Through"), (("cooperation",), "Building Cooperation"), (("influence",), "Influence and Persuasion"), (("practice",), "Practice Exercise"),
)


def title_case(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")


def insight_title(question: Column, answer: Column, action: Column) -> Column:
    """A short title: from known phrases, the question's main words, the answer's heading or the action."""
    q = F.lower(F.coalesce(question, F.lit("")))
    rules = [F.when(_all([q.contains(k) for k in keys]), F.lit(title)) for keys, title in TITLE_PHRASES]
    main = F.filter(F.split(chain((r"[^A-Za-z0-9_\t-\r\x20\xa0]", " "), (rf"[{WS}]+", " "))(q), " "), lambda w: (w != "") & ~w.isin(*TITLE_STOP))
    built = title_case(F.slice(main, 1, 5))
    cut = lambda s: F.when(F.length(s) <= 56, s).otherwise(F.concat(STRIP(F.substring(s, 1, 53)), F.lit("…")))
    line = F.try_element_at(F.filter(F.transform(F.split(STRIP(F.coalesce(answer, F.lit(""))), "\n"), STRIP), lambda x: x != ""), F.lit(1))
    heading = STRIP(chain((rf"^#+[{WS}]*", ""), (r"^\*\*|\*\*$", ""))(line))
    act = title_case(F.filter(F.split(F.coalesce(action, F.lit("")), r"[_\t-\r\x20-]+"), lambda w: w != ""))
    return F.coalesce(*rules, F.when(F.size(main) >= 2, cut(built)), F.when((heading != "") & (F.length(heading) <= 56), heading), F.when((F.coalesce(action, F.lit("")) != "answer") & (act != ""), act), F.lit("Saved Book Insight"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def without_heading(text: Column, title: Column) -> Column:
    """The text without a first line, or a beginning, that repeats the title (in any case, final ``.`` or ``:`` aside)."""
    name = F.lower(normalize_text(F.coalesce(title, F.lit(""))))
    end = chain((r"[.:]+$", ""))

    def by_lines(x: Column) -> Column:
        lines, name = x["lines"], x["name"]
        first = F.lower(normalize_text(F.try_element_at(lines, F.lit(1))))
        rest = STRIP(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), "\n\n"))
        whole = normalize_text(text)
        tail = chain((r"^[ .:\n\t]+", ""))(F.substring(whole, F.length(name) + 1, F.lit(2_000_000_000)))
        return (
            F.when((F.size(lines) == 0) | (name == ""), text)
            .when((first == name) | (end(first) == end(name)), rest)
            .when(F.startswith(F.lower(whole), name) & (tail != ""), tail)
            .otherwise(text)
        )

    lines = F.filter(F.transform(F.split(text, "\n"), STRIP), lambda x: x != "")
    return let(F.struct(lines.alias("lines"), name.alias("name")), by_lines)
