"""The stored inverted index against plain Python sums."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from segmentry.functions.text import tokens
from segmentry.operators import postings

WORD = re.compile(r"[^\W_]+")
VOCABULARY = "the the the the of of an in Đường đường café CAFÉ Hà Nội phố rare1 rare2 đèn 42 naïve сегмент кадр видео".split()


def plain_words(text):
    return WORD.findall(unicodedata.normalize("NFC", text or "").lower())


def plain_search(docs, queries, k):
    words = {i: Counter(plain_words(t)) for i, t in docs}
    mean = sum(sum(w.values()) for w in words.values()) / len(docs)
    df = Counter(t for w in words.values() for t in w)
    out = []
    for q, text in queries:
        score = defaultdict(float)
        for t in set(plain_words(text)):
            idf = math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1)
            for i, w in words.items():
                if w[t]:
                    score[i] += idf * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * sum(w.values()) / mean))
        best = sorted(((-round(s, 6), i) for i, s in score.items()))[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    forms = lambda w: unicodedata.normalize(rng.choice(("NFC", "NFD")), w)
    docs = [(i, " ".join(forms(rng.choice(VOCABULARY)) for _ in range(rng.choice((0, 3, 8, 40))))) for i in range(n)]
    docs += [(n, None), (n + 1, "the " * 500), (n + 2, "!!!")]
    queries = [(q, " ".join(forms(rng.choice(VOCABULARY)) for _ in range(rng.choice((1, 2, 5))))) for q in range(15)] + [(99, ""), (98, None), (97, "absent")]
    return docs, queries


def near(got, want):
    got = sorted(map(tuple, got))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)


def test_words_of_any_alphabet(spark):
    text = "Hỏi về café ở Hà Nội, кадр 12"
    df = spark.createDataFrame([(unicodedata.normalize(f, text),) for f in ("NFC", "NFD")] + [("plain Words",), (None,)], "t string")
    rows = [r[0] for r in df.select(tokens(df["t"])).collect()]
    assert rows == [["hỏi", "về", "café", "ở", "hà", "nội", "кадр", "12"]] * 2 + [["plain", "words"], None]


@pytest.mark.parametrize("block_docs,at_once,k", [(1, 4096, 3), (7, 4, 1), (1024, 4096, 10), (5, 1, 200)])
def test_search_like_plain_sums(spark, tmp_path, block_docs, at_once, k):
    docs, queries = corpus()
    df = spark.createDataFrame(docs, "id long, text string").repartition(5)
    index = postings.build(df, str(tmp_path / "index"), block_docs)
    got = postings.search(index, spark.createDataFrame(queries, "query_id int, text string"), k, queries_at_once=at_once)
    near(got.collect(), plain_search(docs, queries, k))
    rows = index.rows(spark)
    assert all(len(r["ids"]) == len(r["tf"]) == len(r["words"]) == r["n"] <= block_docs for r in rows.collect())


def test_appended_batches_and_other_ids(spark, tmp_path):
    docs, queries = corpus()
    df = spark.createDataFrame([(f"d{i:03d}", t) for i, t in docs], "id string, text string")
    first, rest = df.where("id < 'd080'"), df.where("id >= 'd080'")
    path = str(tmp_path / "index")
    postings.build(first, path, 8)
    postings.add(postings.Postings(path), rest.limit(3), 1, 8)
    postings.add(postings.Postings(path), rest, 1, 8)  # runs again, and replaces itself
    got = postings.search(postings.Postings(path), spark.createDataFrame(queries, "query_id int, text string"), 4).collect()
    near(got, plain_search([(f"d{i:03d}", t) for i, t in docs], queries, 4))


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path, monkeypatch):
    """Short texts with the word asked for in some blocks, long ones in most: only the former's lists are read."""
    docs = [(i, "word" if i < 40 else "word " + "filler " * 300) for i in range(400)]
    index = postings.build(spark.createDataFrame(docs, "id long, text string").coalesce(1), str(tmp_path / "index"), 10)
    seen, real = {}, postings.stored
    monkeypatch.setattr(postings, "stored", lambda df, name: seen.setdefault(name, real(df, name)))
    got = postings.search(index, spark.createDataFrame([(1, "word")], "query_id int, text string"), 3).collect()
    near(got, plain_search(docs, [(1, "word")], 3))
    assert seen["heads"].count() == 40 and seen["wanted"].count() == 4


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    index = postings.build(none, str(tmp_path / "index"))
    assert postings.search(index, spark.createDataFrame([(1, "word")], "query_id int, text string")).count() == 0
