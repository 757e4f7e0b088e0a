"""Near copies of the pipeline against brute-force Jaccard."""

import random
from collections import Counter
from itertools import combinations

import pytest

from segmentry.llm import similar_dedup
from segmentry.llm.near_dedup import majority


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups(rows):
    """doc_id -> the smallest of its component, by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if a == b or len(a & b) >= 0.8 * len(a | b):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in root}


@pytest.mark.parametrize("copies", [1, 120])
def test_near_copies_of_the_stage(spark, make, copies):
    """Replaced words give similarities on both sides of 0.8; 120 copies of one text meet in large buckets."""
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = ["", "one two", "One  TWO", "lone"]
    for _ in range(120 // copies):
        text = [word() for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(text))
        for _ in range(copies):
            changed = list(text)
            for at in rng.sample(range(len(text)), rng.randint(0, max(1, len(text) // 20))):
                changed[at] = word()
            texts.append(" ".join(changed))
    rows = list(enumerate(texts))
    docs = make([(i, t, "en", "a") for i, t in rows])
    want = groups(rows)
    assert copies > 1 or 20 < len(set(want.values())) - 3 - 120 < 110  # some pairs are near copies, some are not
    kept = corpus_pipeline.near_dedup(spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_stage_on_odd_rows(spark, docs):
    rows = docs.collect()
    kept = similar_dedup.drop_similar(docs)
    want = Counter(frozenset(shingles(r["text"])) for r in rows)
    assert kept.columns == docs.columns and kept.count() == len(want)


def test_fingerprints_alone_find_near_copies(spark, make, monkeypatch):
    """Without bands the stage has SimHash: what is within two bits and of index 0.8 goes, and nothing else."""
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(30):
        text = [word() for _ in range(400)]
        texts += [" ".join(text), " ".join([*text, word()]), " ".join([*text[:200], *(word() for _ in range(200))])]
    rows = list(enumerate(texts))
    prints = {i: majority([similar_dedup.shingle_set(t.encode())]) for i, t in rows}
    near = {j for i, j in combinations(prints, 2) if bin(prints[i] ^ prints[j]).count("1") <= 2 and len(shingles(texts[i]) & shingles(texts[j])) >= 0.8 * len(shingles(texts[i]) | shingles(texts[j]))}
    assert 20 < len(near) <= 30
    monkeypatch.setattr(similar_dedup, "BANDS", 0)
    kept = corpus_pipeline.near_dedup(spark, make([(i, t, "en", "a") for i, t in rows]), None)
    assert {r["doc_id"] for r in kept.collect()} == set(prints) - near


def test_linked_fingerprints_share_a_bucket(spark):
    """Different sets of one fingerprint, and of fingerprints within two bits, in one bucket; the empty set in none."""
    one = spark.createDataFrame([(1, 9, 0), (2, 9, 0), (3, 9, 0b11), (4, 9, 0b111), (5, 9, -1), (0, 0, 0)], "print long, n int, fingerprint long")
    buckets = {}
    for r in similar_dedup._near_prints(one, 2).collect():
        buckets.setdefault(r["bucket"], set()).add(r["p"])
    met = {pair for b in buckets.values() for pair in combinations(sorted(b), 2)}
    assert {(1, 2), (1, 3), (2, 3), (3, 4)} <= met and not any(5 in pair or 0 in pair for pair in met)
