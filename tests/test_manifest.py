import json

import pytest
from pyspark.sql import functions as F

from segmentry.operators import manifest
from segmentry.sources import files


def test_request_rules(spark):
    rows = [(1, 5, "a", ["x"]), (2, 0, "a", ["x"]), (3, None, "a", ["x"]), (4, 1, " \t", ["x"]), (5, 1, None, ["x"]), (6, 1, "a", []), (7, 1, "a", None), (8, 1, "a", ["x", " "])]
    good, rejected = manifest.validate_requests(spark.createDataFrame(rows, "id int, top_k int, query string, events array<string>"), events="events")
    assert [r["id"] for r in good.collect()] == [1]
    told = {r["id"]: (r["code"], r["message"]) for r in rejected.collect()}
    assert set(told) == {2, 3, 4, 5, 6, 7, 8} and {c for c, _ in told.values()} == {"INVALID_REQUEST"}
    assert told[2][1] == "top_k must be positive" and told[5][1] == "query must not be blank" and told[6][1] == "no event" and told[8][1] == "blank event"


@pytest.mark.parametrize("text, found", [("LAKE", [1, 3]), ("12", [2]), ("  ", [1, 2, 3]), ("none of them", [])])
def test_contains_any(spark, text, found):
    rows = spark.createDataFrame([(1, "a lake", 5, None), (2, None, 120, ["b", None]), (3, "x", None, ["a", "By the Lake"])], "id int, name string, frame int, events array<string>")
    assert sorted(r["id"] for r in rows.where(manifest.contains_any(rows, text, "name", "frame", "events")).collect()) == found


def test_sample_errors(spark):
    rows = [("a/b.jpg", "image", 1, "c"), ("/a", "image", 1, "c"), (None, "image", 1, "c"), ("a", "audio", 1, "c"), ("a", None, 1, "c"), ("a", "video", 0, "c"), ("a", "video", None, "c"), ("a", "video", 2, "\t")]
    told = spark.createDataFrame(rows, "path string, media_type string, num_frames int, caption string").select(manifest.sample_error().alias("e"))
    assert [r["e"] for r in told.collect()] == [None, "absolute path", "no path", "unknown media type", "unknown media type", "too few frames", "too few frames", "no caption"]


def test_case_rules(spark):
    rows = [("q", "easy", "sample", 0), ("", "easy", "synthetic", 1), ("q", "odd", "sample", -1), (None, None, "x", None)]
    cases = spark.createDataFrame(rows, "query_text string, difficulty string, source string, frame int")
    assert manifest.rule_counts(cases, [], **manifest.case_rules()).first().asDict() == {"bad_difficulty": 2, "bad_source": 1, "bad_frame": 2, "empty": 2}


def test_sources_in_order(spark):
    asked = spark.createDataFrame([("b", 0), ("all", 1), ("b", 2), ("d", 3)], "source string, place int")
    found = manifest.ordered_distinct(asked, "source", "place", {"all": ["a", "b", "c"], "both": ["a", "b"]}).orderBy("place", "nth")
    assert [r["source"] for r in found.collect()] == ["b", "a", "c", "d"]
    one = asked.select("source")
    assert [r["src"] for r in manifest.in_order(one.where("source = 'd'"), one.where("source = 'b'")).orderBy("src").collect()] == [0, 1, 1]


def test_missing_files_and_their_urls(spark):
    samples = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t"), (None, "t")], "id int, source string")
    there = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    counted = manifest.presence(samples, there, "id", "source").orderBy("source").collect()
    assert [tuple(r) for r in counted] == [("s", 1, 1), ("t", 2, 0)]
    urls = spark.createDataFrame([(2, "u2"), (1, "u1")], "id int, url string")
    found = manifest.missing_urls(samples, there, urls, "id").orderBy(F.col("id").asc_nulls_last()).collect()
    assert [(r["id"], r["url"]) for r in found] == [(2, "u2"), (3, None), (None, None)]


def test_upsert_of_null_and_repeated_keys(spark):
    old = spark.createDataFrame([(None, "o", 1), ("a", "o", 1), ("b", "o", 1)], "path string, v string, n int")
    new = spark.createDataFrame([(None, "n", 1), ("a", "n1", 2), ("a", "n2", 1), ("c", "n", 1), (None, "n", 0)], "path string, v string, n int")
    got = lambda *order: sorted(tuple(r) for r in manifest.upsert(old, new, "path", *order).fillna({"path": "-"}).collect())
    assert got("n") == [("-", "n", 1), ("a", "n1", 2), ("b", "o", 1), ("c", "n", 1)]
    assert got() == [("-", "n", 1), ("a", "n2", 1), ("b", "o", 1), ("c", "n", 1)]


def test_caption_tsv_has_fields_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([('say "hi" x', "u1"), ("a\tb\nc", " u2 "), ("\u00a0 ", "u3"), (None, "u4"), ("back\\slash", "u5")], "caption string, url string")
    assert files.write_caption_tsv(rows.coalesce(1), str(tmp_path / "t")) == 3
    lines = [line for f in (tmp_path / "t").glob("*.csv") for line in f.read_text().splitlines()]
    assert lines == ['say "hi" x\tu1', "a b c\tu2", "back\\slash\tu5"]
    assert [tuple(r) for r in files.read_caption_tsv(spark, str(tmp_path / "t")).collect()] == [('say "hi" x', "u1"), ("a b c", "u2"), ("back\\slash", "u5")]


def _lines(path, *rows):
    path.mkdir()
    (path / "part-0.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_the_job_from_lines_and_files(spark, tmp_path):
    media = tmp_path / "media"
    (media / "pics").mkdir(parents=True)
    (media / "films").mkdir()
    for name, content in (("pics/a.jpg", b"\xff\xd8..\xff\xd9"), ("pics/b.jpg", b"\xff\xd8.."), ("films/x.mp4", b"...."), ("films/y.mp4", b"")):
        (media / name).write_bytes(content)
    pics = _lines(tmp_path / "pics", {"id": "a", "caption": " one "}, "", {"id": "b", "caption": "b"}, {"id": "a", "caption": "two"}, {"id": "c", "caption": "c"}, {"id": "d", "caption": " "}, {"id": None, "caption": "e"})
    films = _lines(tmp_path / "films", {"id": "x", "caption": None, "num_frames": 5, "duration": 0.5}, '{"id": "x', {"id": "y", "caption": "y", "num_frames": 1}, {"id": "z"}, {"id": "x", "num_frames": 9})
    sources = [manifest.Source("pics", pics, "image", "jpg", "jpeg", captioned=True), manifest.Source("films", films, "video", "mp4", strict=False)]
    told, rejects = manifest.build(spark, sources, str(media))
    assert sorted((r["data_path"], r["outcome"], r["error"]) for r in told.collect() if r["outcome"] != "duplicate") == [
        ("films/x.mp4", "ok", None), ("films/y.mp4", "corrupt", None), ("films/z.mp4", "missing", "missing"),
        ("pics/a.jpg", "ok", None), ("pics/b.jpg", "corrupt", "signature"), ("pics/c.jpg", "missing", "missing")]
    assert sorted(r["data_path"] for r in told.where("outcome = 'duplicate'").collect()) == ["films/x.mp4", "pics/a.jpg"]
    assert [tuple(r) for r in rejects.collect()] == [("films", '{"id": "x')]
    counted = {r["source"]: tuple(r)[1:] for r in manifest.summary(told, "source").collect()}
    assert counted == {"pics": (4, 1, 1, 1, 1), "films": (4, 1, 1, 1, 1)}
    none_checked, _ = manifest.build(spark, sources, str(media), mode="none", wanted=["pics"], parts=3)
    assert sorted((r["data_path"], r["outcome"]) for r in none_checked.collect()) == [("pics/a.jpg", "duplicate"), ("pics/a.jpg", "ok"), ("pics/b.jpg", "ok"), ("pics/c.jpg", "missing")]
    target = str(tmp_path / "manifest")
    first = manifest.merge_into(told, manifest.previous(spark, str(tmp_path / "nowhere")), target)
    assert sorted(tuple(r) for r in first.collect()) == [("films/x.mp4", None, "video", 5, 0.5, "films"), ("pics/a.jpg", "one", "image", 1, None, "pics")]
    later = manifest.merge_into(none_checked, manifest.previous(spark, target), str(tmp_path / "next"))
    assert sorted(r["data_path"] for r in later.collect()) == ["films/x.mp4", "pics/a.jpg", "pics/b.jpg"]
    (tmp_path / "manifest" / "broken.json").write_text('{"data_path": "q')
    assert manifest.previous(spark, target).count() == 0


def test_the_job_refuses(spark, tmp_path):
    broken = _lines(tmp_path / "s", {"id": "a", "caption": "a"}, '{"id": "b')
    source = manifest.Source("s", broken, "image", "jpg", "jpeg")
    with pytest.raises(Exception, match="broken line"):
        manifest.build(spark, [source], str(tmp_path))
    with pytest.raises(ValueError, match="unknown sources"):
        manifest.build(spark, [source], str(tmp_path), wanted=["t"])
    with pytest.raises(ValueError, match="named twice"):
        manifest.build(spark, [source, source], str(tmp_path))
    none, rejects = manifest.build(spark, [source], str(tmp_path), wanted=[])
    assert none.count() == rejects.count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_first_of_a_path_over_slices(spark, parts):
    rows = spark.createDataFrame([(f"p{i % 2}" if i % 5 else None, i // 3, "c") for i in range(40)], "path string, at int, caption string")
    told = manifest.told(rows, "path", ["at"], F.lit(False), F.lit(False), parts).where("outcome = 'ok'").fillna({"path": "-"})
    assert sorted((r["path"], r["at"]) for r in told.collect()) == [("-", 0), ("p0", 0), ("p1", 0)]
