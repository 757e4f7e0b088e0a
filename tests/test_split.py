"""The split job: files read back, no leak, the same on every run."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from segmentry.operators import split


@pytest.mark.parametrize("n", [0, 1, 2, 499, 500])
def test_nth_smallest(spark, n):
    rng = random.Random(1)
    # half of all hashes share a long prefix, so the refinement goes on
    hashes = [f"{rng.getrandbits(128):032x}" if i % 2 else "abcdef" * 4 + f"{i:08x}" for i in range(500)]
    df = spark.createDataFrame([(h,) for h in hashes], "h string")
    want = sorted(hashes)[n - 1] if n else None
    assert split.nth_smallest(df, n, digits=1, few=3) == split.nth_smallest(df, n) == want


def rows(spark, n=400, parts=7):
    data = [(f"v/{'clip' if i % 3 else 'hot'}{i % 40 if i % 3 else 0}_{i}.mp4", "video", i) for i in range(n)] + [(f"i/{i}.jpg", "image", i) for i in range(n // 2)]
    data += [("i/1.jpg", "image", 9), ("v/alone.mp4", None, 1), (None, "video", 2), (None, "image", 3)]
    return spark.createDataFrame(data, "path string, media_type string, n int").repartition(parts)


def test_no_group_on_both_sides(spark):
    got = split.with_split(rows(spark), 0.3, digits=1, few=2).collect()
    key = lambda r: r["path"].split("/")[1].split("_")[0] if "_" in r["path"] else r["path"]
    sides, kinds = {}, {}
    for r in got:
        if r["path"]:
            kind = "image" if r["media_type"] == "image" else "video"
            sides.setdefault((kind, key(r)), set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values())
    for (kind, _), s in sides.items():
        kinds.setdefault(kind, []).extend(s)
    for units in kinds.values():
        assert units.count("val") == int(len(units) * 0.3)
    assert {r["split"] for r in got if r["path"] is None} == {"train"} and len(got) == 604
    again = split.with_split(rows(spark, parts=2), 0.3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_files_are_one_shuffled_order(spark, tmp_path):
    sets = []
    for parts in (2, 7):
        given = split.with_split(rows(spark, parts=parts).where("path is not null"), 0.2)
        folder = str(tmp_path / f"out{parts}")
        counts = split.write_split(given, folder)
        read = {s: [json.loads(line) for f in sorted(glob.glob(f"{folder}/split={s}/*.json")) for line in open(f)] for s in ("train", "val")}
        assert {s: len(r) for s, r in read.items()} == counts and sum(counts.values()) == 602
        place = {(r["path"], r["n"]): (r["split"], r["nth"]) for r in split.shuffled(given).collect()}
        for s, lines in read.items():
            paths = [x["path"] for x in lines]
            assert paths == [p for p, _ in sorted(((p, k) for (p, _), (o, k) in place.items() if o == s), key=lambda x: x[1])] and paths != sorted(paths)
        back = split.read_split(spark, folder, "val", "path string, n int")
        assert back.count() == counts["val"] and split.leaks(split.read_split(spark, folder, "train", "path string"), back, F.col("path")).isEmpty()
        sets.append({s: [x["path"] for x in lines] for s, lines in read.items()})
    assert sets[0] == sets[1]


def test_empty(spark, tmp_path):
    none = split.with_split(rows(spark).where("false"))
    assert none.count() == 0 and split.shuffled(none).count() == 0 and split.write_split(none, str(tmp_path / "none")) == {}
