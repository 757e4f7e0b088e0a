"""The library's functions for users who write SQL only: one call registers them in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name and arguments -> (what it returns, its body). All are expressions that Spark compiles; none calls Python.
FUNCTIONS = {
    "segment_midpoint(s INT, e INT)": ("INT", "least(cast(floor((s + e) / 2) as int), e - 1)"),
    "frame_seconds(frame INT, fps DOUBLE)": ("DOUBLE", "round(frame / fps, 2)"),
    "frame_of(seconds DOUBLE, fps DOUBLE)": ("INT", "cast(bround(seconds * fps) as int)"),
    "timecode(seconds DOUBLE)": (
        "STRING",
        "format_string('%02d:%02d:%02d,%03d', floor(floor(seconds * 1000) / 3600000), floor(floor(seconds * 1000) / 60000) % 60, floor(floor(seconds * 1000) / 1000) % 60, floor(seconds * 1000) % 1000)",
    ),
    "dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "try_divide(dot(a, b), sqrt(dot(a, a)) * sqrt(dot(b, b)))"),
    "sq_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "split_group_key(path STRING)": (
        "STRING",
        r"if(instr(regexp_extract(path, '([^/]*?)(?:\\.[^./]*)?$', 1), '_') > 0, substring_index(regexp_extract(path, '([^/]*?)(?:\\.[^./]*)?$', 1), '_', 1), path)",
    ),
    "window_starts(num_frames INT, size INT, stride INT)": (
        "TABLE(window_idx INT, window_start INT)",
        "SELECT posexplode(array_distinct(concat(sequence(0, greatest(num_frames - size, 0), stride), array(greatest(num_frames - size, 0)))))",
    ),
    "interval_pieces(s DOUBLE, e DOUBLE, most DOUBLE)": (
        "TABLE(piece INT, piece_start DOUBLE, piece_end DOUBLE)",
        "SELECT i, s + i * (e - s) / n, if(i = n - 1, e, s + (i + 1) * (e - s) / n) FROM (SELECT n, explode(sequence(0, n - 1)) AS i FROM (SELECT greatest(cast(ceil((e - s) / most) as int), 1) AS n))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Makes ``FUNCTIONS`` temporary functions of the session; their names."""
    for head, (returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
