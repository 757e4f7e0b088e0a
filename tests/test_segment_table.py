"""The stored segment table: ids are given once, changes replay, both texts."""

import pytest

from segmentry.operators import segment_table


def test_ids_texts_and_deletes(spark, tmp_path):
    t = segment_table.create(spark, str(tmp_path / "s"), "video_id string, start_frame int")
    assert t.high_water() == 0 and t.rows().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "video_id string, start_frame int")
    ids = lambda: sorted((r["segment_id"], r["video_id"]) for r in t.rows().collect())
    key = lambda *i: spark.createDataFrame([(x,) for x in i], "segment_id long")
    assert t.append(rows(("b", 0), ("a", 0)), 0, "video_id") == (1, 2)
    assert t.append(rows(("c", 0), ("d", 0), ("e", 0)), 1, "video_id") == (3, 3)
    assert ids() == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    t.delete(key(5, 1), 0)
    assert t.append(rows(("f", 0)), 2, "video_id") == (6, 1), "a deleted id is not given again"
    # the last batch runs again, larger; an earlier one smaller, then larger than it was
    assert t.append(rows(("f", 0), ("g", 0)), 2, "video_id") == (6, 2)
    assert t.append(rows(("z", 0)), 0, "video_id") == (1, 1)
    assert t.append(rows(("w", 0), ("x", 0), ("y", 0)), 0, "video_id") == (8, 3)
    assert ids() == [(3, "c"), (4, "d"), (6, "f"), (7, "g"), (8, "w"), (9, "x"), (10, "y")] and t.high_water() == 10
    t.delete(t.rows().select("segment_id"), 1)
    assert ids() == [] and t.append(rows(("n", 0)), 3, "video_id") == (11, 1)

    text = lambda *r: spark.createDataFrame(list(r), "segment_id long, text string")
    t.set_text(text((11, "spoken"), (11, "said"), (99, "nobody")), "asr_text", 1)
    t.set_text(text((11, "sign")), "ocr_text", 2)
    t.set_text(text((11, "later"), (11, None)), "asr_text", 3)
    t.set_text(text((11, None)), "ocr_text", 4)
    again = segment_table.SegmentTable(spark, t.path)
    assert [tuple(r) for r in again.rows().select("segment_id", "asr_text", "ocr_text").collect()] == [(11, "later", "sign")]
    t.set_text(text((11, "at last")), "asr_text", 3)  # runs again, and replaces itself
    assert t.rows().first()["asr_text"] == "at last" and t.missing_text("ocr_text").count() == 0
    assert [r[0] for r in t.unknown(text((11, ""), (99, ""), (99, ""))).collect()] == [99]
    assert [r["high_water"] for r in t.versions().where("n > 0").orderBy("first_id").collect()][-1] == 11
    with pytest.raises(ValueError):
        t.set_text(text(), "caption", 5)


def test_batches_of_nothing(spark, tmp_path):
    t = segment_table.create(spark, str(tmp_path / "s"), "video_id string, embedding array<double>, asr_text string")
    none = spark.createDataFrame([], "video_id string, embedding array<double>, asr_text string")
    assert t.append(none, 0, "video_id") == (1, 0) and t.high_water() == 0
    assert t.append(spark.createDataFrame([("a", [1.0], "own"), ("b", None, None)], none.schema), 1, "video_id") == (1, 2)
    assert [tuple(r) for r in t.rows().select("segment_id", "asr_text", "ocr_text").orderBy("segment_id").collect()] == [(1, "own", None), (2, None, None)]
