"""The transducer and its word table against regular expressions, and the audit against applying the filters one by one."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from segmentry.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def run(texts, **size):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return fa.counts(np.frombuffer(b"".join(raw), np.uint8), offsets, **size).tolist()


def random_texts(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice("aabAZ#|$ \t\n\x0b\x1c\x00é日😀\u00a0") for _ in range(rng.choice((0, 0, 1, 3, 40, 900)))) for _ in range(n)]


def test_counts_like_regular_expressions():
    texts = ["", " ", "a", " a ", "x" * 5000, ("y" * 300 + " ") * 3 + "y" * 301, "", *random_texts(400), "12345678 1234567 123456789 12345678", ""]
    want = [plain_counts(t) for t in texts]
    assert run(texts) == want and run(texts, group_bytes=1) == want and run(texts, group_bytes=777) == want
    assert run([]) == [] and run(["", ""]) == [[0] * 5] * 2


def test_word_table_compares_bytes():
    """Words of one length whose hashes are made equal: the table still parts them."""
    words = [f"{i:05d}".encode() for i in range(200)] * 2
    data = np.frombuffer(b" ".join(words) + b" " * 8, np.uint8)
    at = np.arange(len(words)) * 6
    size, text = np.full(len(words), 5), np.zeros(len(words), np.int64)
    first = fa.distinct_words(data, text, at, size)
    assert first.sum() == 200 and len({words[i] for i in np.flatnonzero(first)}) == 200
    pieces, fa._words_of = fa._words_of, lambda at, size, data, real=fa._words_of: real(at, size, data)
    try:
        calls = []

        def blind(at, size, data):
            """The first look, which makes the hashes, sees nothing of the words."""
            calls.append(1)
            return [(own, x * np.uint64(0)) for own, x in pieces(at, size, data)] if len(calls) == 1 else pieces(at, size, data)

        fa._words_of = blind
        first = fa.distinct_words(data, text, at, size)
        assert len(calls) > 100 and first.sum() == 200 and len({words[i] for i in np.flatnonzero(first)}) == 200
    finally:
        fa._words_of = pieces


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    rows = []
    least = defaultdict(list)
    for i, t, _ in docs:
        least[t or ""] += [] if i is None else [i]
    for i, t, lang in docs:
        words, distinct, capitals, points, symbols = plain_counts(t or "")
        fails = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 3 * points, "D": symbols > 0, "E": i is not None and min(least[t or ""]) < i}
        own = [(q, x) for j, q, x in labels if j is not None and j == i]
        rows.append((lang or "", fails, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                now = [r for r in left if r[1][f]]
                unique = sum(r[0] == part and r[1][f] and sum(r[1].values()) == 1 for r in rows)
                left = [r for r in left if not r[1][f]]
                out[part, "".join(order), step] = [len(left), len(now), sum(r[1][f] for r in gone), unique, sum(r[2] for r in now), sum(r[3] for r in now)]
                gone += now
                shapley[part, f] += len(now)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def compare(spark, docs, labels):
    labels = spark.createDataFrame([(*r, 1, 1) for r in labels], "doc_id long, quality int, toxic int, n long, part long")
    got = fa.audit(fa.histogram(docs, labels)).collect()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    want = plain_audit(rows, [tuple(r)[:3] for r in labels.collect()])
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got} == want and len(got) == len(want) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_odd_rows(spark, docs):
    compare(spark, docs, [(3, 1, None), (3, 0, 1), (4, None, 1), (None, 1, 1), (99, 1, 1), (7, 1, 0)])


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_of_random_rows(spark, make, seed):
    """Repeated texts over parts, repeated and null ids, a third of all rows alike."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["alpha", "Beta", "x|y", "g", "h", "ij"] if k % 2 else [str(i) for i in range(500)]) for _ in range(rng.choice((5, 150, 250)))) for k in range(40)]
    rows = [(rng.choice([None, *range(150)]), pool[0] if i % 3 == 0 else rng.choice(pool), rng.choice(["en", "de", None, ""]), "s") for i in range(200)]
    compare(spark, make(rows).repartition(5), [(rng.randrange(150), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(90)])
