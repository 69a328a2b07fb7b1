"""Explicit schemas of the engine's records; readers never infer."""

from pyspark.sql import types as T

_s, _d, _i, _l = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CITATION = _struct(passage_id=_s, chapter=_s, snippet=_s, source=_s, href=_s, chapter_index=_i, chunk_index=_i)
PASSAGE = _struct(id=_s, book_id=_s, chapter=_s, text=_s, embedding_model=_s, embedding=T.ArrayType(_d), source=_s, href=_s, chapter_index=_i, chunk_index=_i)
MEMORY = _struct(memory_id=_s, book_id=_s, text=_s, source=_s, created_at=_s, title=_s, question=_s, action=_s, citations=T.ArrayType(CITATION))
INDEX_JOB = _struct(book_id=_s, status=_s, stage=_s, message=_s, current=_i, total=_i, percent=_i, started_at=_s, updated_at=_s, error=_s, passage_count=_i, embedding_model=_s)
BOOKMARK = _struct(id=_s, cfi=_s, label=_s, created_at=_s)
LISTENING_BOOKMARK = _struct(id=_s, chapter_index=_i, time_s=_d, chapter_time_s=_d, abs_time_s=_d, label=_s, created_at=_s, timeline_version=_i)
NOTE = _struct(id=_s, text=_s, created_at=_s, updated_at=_s)
BOOK = _struct(
    id=_s, title=_s, author=_s, language=_s, added_at=_s, opened_at=_s, favorite=T.BooleanType(), run_relpath=_s, conversion_status=_s, listen_abs_time_s=_d,
    reading_bookmarks=T.ArrayType(BOOKMARK), listening_bookmarks=T.ArrayType(LISTENING_BOOKMARK), notes=T.ArrayType(NOTE), metadata=T.MapType(_s, _s),
)
CATALOG = _struct(version=_i, books=T.ArrayType(BOOK))
SETTINGS = _struct(kokoro_voice=_s, rewrite_policy=_s, output_retention=_s, kokoro_workers=_i, hls_live=T.BooleanType(), version=_i)
EVENT = _struct(ts=_s, event=_s, payload=T.MapType(_s, _s))
PLAYLIST_ENTRY = _struct(playlist=_s, pos=_i, name=_s, duration_s=_d)
EPUB_ITEM = _struct(book_path=_s, book_title=_s, item_id=_s, href=_s, item_pos=_i, spine_pos=_i, html=_s, toc=T.ArrayType(_struct(pos=_i, href=_s, label=_s, section_title=_s)), metadata=T.MapType(_s, _s))
EVENT_ROW = _struct(event_id=_l, ts=T.TimestampType(), user_id=_l, event_type=_s, value=_d, props=_s)
