"""Data sources: bytes read of each file, pages until one is empty or fails."""

import pytest

from segmentry.sources import readers


@pytest.fixture
def pictures(spark, tmp_path):
    body = b"x" * 3_000_000
    kinds = {"good.jpg": b"\xff\xd8" + body + b"\xff\xd9", "cut.jpg": b"\xff\xd8" + body, "tiny.jpg": b"\xff", "empty.jpg": b"", "text.jpg": b"hello"}
    for name, data in kinds.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path, [str(tmp_path / n) for n in kinds] + [str(tmp_path / "absent.jpg"), str(tmp_path)]


@pytest.mark.parametrize("mode,most", [("none", 0), ("fast", 4), ("strict", 3_000_004)])
def test_signatures(spark, pictures, mode, most):
    folder, paths = pictures
    got = {r["path"].rsplit("/", 1)[-1]: r for r in readers.read_signatures(spark, paths, "jpeg", mode).collect()}
    assert got["good.jpg"]["valid"] and got["good.jpg"]["size"] == 3_000_004 and got["good.jpg"]["bytes_read"] == most
    assert [got[n]["valid"] for n in ("cut.jpg", "tiny.jpg", "empty.jpg", "text.jpg")] == [mode == "none"] * 4
    assert not got["absent.jpg"]["valid"] and got["absent.jpg"]["error"] == "missing" and not got[folder.name]["valid"]
    assert max(r["bytes_read"] for r in got.values()) == most
    table = spark.createDataFrame([(p, i) for i, p in enumerate([*paths, "file://" + paths[0], None])], "path string, n int").repartition(3)
    also = {r["n"]: r for r in readers.check_files(table, "jpeg", mode).collect()}
    assert [also[i]["valid"] for i in range(len(paths))] == [got[p.rsplit("/", 1)[-1]]["valid"] for p in paths]
    assert also[len(paths)]["bytes_read"] == most and also[len(paths) + 1]["error"] == "missing"


def test_parquet_signature(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    paths = [str(p) for p in (tmp_path / "t").glob("*.parquet")]
    assert [tuple(r)[2:4] for r in readers.read_signatures(spark, paths, "parquet").collect()] == [(8, True)]
    with pytest.raises(Exception, match="unknown kind"):
        readers.read_signatures(spark, paths, "tiff").collect()


def pages(log, fail_at=None):
    def fetch(page):
        with open(log, "a") as f:
            f.write(f"{page}\n")
        if page == fail_at:
            raise ConnectionError("no answer")
        return [(page * 100 + i, f"row {i}") for i in range(100)] if page < 5 else []

    return fetch


def fetched(log):
    return [int(x) for x in open(log)]


def test_pages_end_limit_and_failure(spark, tmp_path):
    fields = "id int, text string"
    log = str(tmp_path / "a")
    rows = readers.read_pages(spark, pages(log), fields)
    assert sorted(r["id"] for r in rows.collect()) == list(range(500)) and fetched(log) == list(range(6))
    log = str(tmp_path / "b")
    assert readers.read_pages(spark, pages(log), fields, limit=150).count() == 150 and fetched(log) == [0, 1]
    log = str(tmp_path / "c")
    got = readers.read_pages(spark, pages(log, 2), fields).collect()
    assert len(got) == 201 and fetched(log) == [0, 1, 2]
    assert tuple(got[-1]) == (None, None, 2, "ConnectionError: no answer") and all(r["error"] is None for r in got[:-1])
    log = str(tmp_path / "d")
    assert {r["page"] for r in readers.read_pages(spark, pages(log), fields, first=3, pages=1).collect()} == {3} and fetched(log) == [3]
