"""Scalar expressions for ids, times and text fields."""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: White space as trim functions of other languages have it; F.trim takes blanks only.
WHITE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^[{WHITE}]+|[{WHITE}]+$", "")


def clip_id(video: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("_", video, F.translate(start, ":.", "--"), F.translate(end, ":.", "--"))


def group_key(path: Column) -> Column:
    """The file stem before its first underscore; a stem without one is its own group (the whole path)."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.when(F.instr(stem, "_") > 0, F.substring_index(stem, "_", 1)).otherwise(path)


def media_path(video_id: Column, base: str = "media") -> Column:
    return F.concat(F.lit(f"{base}/"), F.split_part(video_id, F.lit("_"), F.lit(1)), F.lit("/video/"), video_id, F.lit(".mp4"))


def parse_fps(text: Column) -> Column:
    """``Video: ..., N fps`` or ``N/D fps`` first, else the first ``x.y fps``; null if absent or D is 0."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    pattern = rf"(?i)video:[^\n]*?[ ,]{number}(?:/([0-9]+))? *fps"
    n, d = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    loose = F.regexp_extract(text, rf"(?i){number} *fps", 1)
    ratio = F.try_divide(n.try_cast("double"), F.when(d == "", F.lit(1.0)).otherwise(d.try_cast("double")))
    return F.when(n != "", ratio).otherwise(loose.try_cast("double"))


def timecode(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``; milliseconds are cut off, not rounded."""
    ms = F.floor(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([t and unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def composed(text: Column) -> Column:
    """Unicode's composed form (NFC), so that letters and marks written apart equal those written as one. Only texts with
    characters that can change leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\u02ff]"), text)), text)


#: Words: letters of any alphabet with their marks, and digits.
WORDS = r"[\p{L}\p{M}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(composed(text)), F.lit(WORDS), F.lit(0))
