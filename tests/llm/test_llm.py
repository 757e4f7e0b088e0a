"""The operators on odd rows and empty tables, and against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from segmentry.llm import bpe, chat, exact_dedup, langid, licenses, mixing, near_dedup, pii, quality_model, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact(docs):
    rows = docs.collect()
    got = exact_dedup.exact_groups(docs, 64).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    want = Counter((r["doc_id"], len(g), max((x for x in g if x is not None), default=None)) for r in rows for g in [groups[(r["text"] or "").translate(LOWER)]])
    assert Counter((r["doc_id"], r["group_size"], r["keep_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_exact_copies(docs, 64)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r["times"] for r in got)


def test_mix_of_equal_rows(spark):
    """Seven equal rows and no id: the target is met to a row, by as many of them as it takes."""
    docs = spark.createDataFrame([(None, "w " * 20, "a")] * 7 + [(1, "x " * 1000, "b")], "doc_id long, text string, source string")
    rows = mixing.mix(docs, weights=(1.17, 20.0), share=0.2).collect()
    target = next(r["target"] for r in rows if r["source"] == "a")
    taken = sum(r["taken"] for r in rows if r["source"] == "a")
    assert 0 < target < 140 and abs(taken - target) <= 10
    assert sorted(map(str, mixing.mix(docs, weights=(1.17, 20.0), share=0.2).collect())) == sorted(map(str, rows))


def test_mix_takes_no_text_without_words(spark):
    texts = [None, "", " \t ", "ten words are in here so that two passes fit", "b " * 1000]
    docs = spark.createDataFrame([(i, t, "b" if i == 4 else "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = mixing.mixed_rows(docs, weights=(1.0, 20.0))
    assert {r["doc_id"] for r in rows.collect()} == {3, 4}
    assert rows.where("doc_id = 3").count() == 2 and {r["times"] for r in mixing.mix(docs).where("size = 0").collect()} == {0}


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 400)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 200 and sum(got.values()) == pytest.approx(3750)
    assert all(got[r["source"]] <= 2 * r["source_size"] for r in sizes.collect())


def test_chat(spark):
    rows = [(4, 0, "assistant", "[| [s> <INST] [\\| <\\s>"), (1, 0, "user", r"a<|end|>\b<\|"), (1, 1, "assistant", "[INST]x[/INST] </s>\\"), (1, 2, "user", None), (2, 0, None, "q"), (None, None, "assistant", "r"), (3, 1, "assistant", "z"), (3, 0, "system", "s"), (3, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.examples(df).cache()
    turns = {(r["conv_id"], r["example"]): [tuple(t) for t in r["t"]] for r in made.select("conv_id", "example", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert turns[1, 3] == [("user", r"a<|end|>\b<\|"), ("assistant", "[INST]x[/INST] </s>\\"), ("user", "")]
    assert turns[4, 1] == [("assistant", "[| [s> <INST] [\\| <\\s>")]
    assert turns[3, 2] == [("system", "s"), ("assistant", "z")] and len(turns[3, 3]) == 3
    for r in made.where("loss_start is not null").collect():
        piece = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]]
        assert r["formatted"].endswith(piece + chat.END)
    assert chat.examples(df.limit(0)).count() == 0


def simhash(text):
    w = (text or "").translate(LOWER).encode().split()
    s = [b" ".join(x) for x in zip(w, w[1:], w[2:])] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)) if h else 0


def test_near(docs):
    got = near_dedup.near_groups(docs).collect()
    texts = [(r["doc_id"], simhash(r["text"])) for r in docs.collect()]
    assert Counter((r["doc_id"], r["print"] % 2**64) for r in got) == Counter(texts)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["label"] for r in got})


def test_tree_bounds_shards(spark):
    """A dense ball around one print and random prints: every shard is split to the aim, whatever the density."""
    rng = np.random.default_rng(6)
    ball = [np.uint64(77) ^ np.uint64(sum(1 << int(j) for j in rng.choice(64, 3, replace=False))) for _ in range(3000)]
    x = np.unique(np.array([*ball, *rng.integers(0, 2**63, 1000, dtype=np.uint64)], np.uint64))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "print long")
    placed, splits = near_dedup.tree(df, aim=64)
    shards = {r["node"]: r["count"] for r in placed.groupBy("node").count().collect()}
    assert sum(shards.values()) == len(x) and max(shards.values()) <= 64 and len(splits) > 2
    got = {tuple(sorted(r)) for r in near_dedup.links(df, aim=64).collect()}
    d = np.bitwise_count(x[:, None] ^ x[None])
    signed = x.view(np.int64).tolist()
    assert got == {tuple(sorted((signed[i], signed[j]))) for i, j in zip(*np.nonzero(np.triu(d <= 2, 1)))}


@pytest.mark.parametrize("aim", [1, 30, 10**6])
def test_links(spark, aim):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(j) for j in rng.choice(64, k, replace=False))) for b in base[:60] for k in (1, 2, 3)]
    x = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array([0, 1, 3, 7, 2**63], np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "print long")
    got = {tuple(sorted(r)) for r in near_dedup.links(df, aim=aim).collect()}
    d = np.bitwise_count(x[:, None] ^ x[None])
    assert got == {tuple(sorted((int(x[i : i + 1].view(np.int64)[0]), int(x[j : j + 1].view(np.int64)[0])))) for i, j in zip(*np.nonzero(np.triu(d <= 2, 1)))}


def test_components(spark):
    chain = list(range(200))
    random.Random(1).shuffle(chain)
    pairs = spark.createDataFrame([*zip(chain, chain[1:]), (1000, 1001), (1001, 1002)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_dedup.components(pairs).collect()}
    assert {got[n] for n in chain} == {0} and {got[n] for n in (1000, 1001, 1002)} == {1000}


def test_bpe_like_library(make):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Bpe(bpe.default_vocabulary())
    rng = random.Random(3)
    texts = ["", "Hi <|endoftext|>world's  aaaa", "ΑΣ ΟΔΟΣ", "I'LL we've x̧ ẞ İ ﬁ", "a" * 5000, "ab c " * 200000]
    texts += ["".join(rng.choice(" abcdefgéßñ'012.,!\n\tAÉ日") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        mine = b"".join(c for p in own.pieces(t) for c in own.encode([p]))
        assert np.frombuffer(mine, "<u4").tolist() == ids
        assert own.decode(mine) == lib.decode(ids, skip_special_tokens=False)
    df = make([(i, t, None, None) for i, t in enumerate(texts[:60])])
    ids = df.select("doc_id", "text", bpe.encode("text").alias("ids"))
    for r in ids.select("text", "ids", bpe.decode("ids").alias("back")).collect():
        assert r["ids"] == lib.encode(r["text"], add_special_tokens=False).ids and r["back"] == lib.decode(r["ids"], skip_special_tokens=False)


def test_bpe_odd(docs):
    got = bpe.round_trips(docs).collect()
    assert len(got) == docs.count() and all((r["n_tokens"] == 0) == (r["ids_sha256"] == hashlib.sha256(b"").hexdigest()) for r in got)


def test_language(docs):
    got = langid.languages(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (1, 2, 6))


def test_language_forward_sums_all_cuts():
    p = langid.pieces(langid.default_vocabulary())
    probabilities = np.random.default_rng(0).uniform(0.1, 1, (p.n, 2))
    inverse = {}
    for w, s, e, i in zip(*p.edges(["hello"])):
        inverse[int(s), int(e)] = int(i)

    def brute(at):
        return 1 if at == 6 else sum(probabilities[i, 1] * brute(e) for (s, e), i in inverse.items() if s == at)

    assert p.score(["hello"], probabilities)[0, 1] == pytest.approx(np.log(brute(0)))


def test_language_of_long_words():
    """The rescaled pass over a long word is the plain forward pass; stretches never cut a word."""
    p = langid.pieces(langid.default_vocabulary())
    probabilities = np.random.default_rng(0).uniform(0.1, 1, (p.n, 3)) / 1000
    words = ["a", "donaudampfschifffahrtsgesellschaft", "x" * 30]
    for part in (1, 7, 4096):
        for w, plain in zip(words, p.score(words, probabilities, 40)):
            assert p.score_long(w, probabilities, part) == pytest.approx(plain)
    long = p.score(["ab" * 20000], probabilities)[0]
    assert np.isfinite(long).all() and (long < -10000).all()
    text = "eins zwei1drei " * 20 + "x" * 500
    for size in (1, 7, 10**6):
        assert "".join(langid._stretches(text, size)) == text
        assert [w for t in langid._stretches(text, size) for w in langid._LETTERS.findall(t)] == langid._LETTERS.findall(text)


def test_language_training_like_plain_em(spark):
    """One round of expectation-maximisation against sums over all cuts of each word."""
    rows = [(1, "ab ba ab", "x"), (3, "ab", "y"), (5, "ⲁ" * 40, "y")]
    [(langs, got)] = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=1)
    p = langid.pieces(langid.default_vocabulary())
    uses = np.full((p.n, 2), langid.SMOOTH)
    for lang, counts in enumerate([{"ab": 2, "ba": 1}, {"ab": 1, "ⲁ" * 32: 1, "ⲁ" * 8: 1}]):
        for word, n in counts.items():
            _, start, end, piece = (x.tolist() for x in p.edges([word]))

            def cuts(at):
                return [[]] if at == len(word) + 1 else [[i, *rest] for s, e, i in zip(start, end, piece) if s == at for rest in cuts(e)]

            weight = [p.n ** -len(c) for c in cuts(0)]
            for c, w in zip(cuts(0), weight):
                for i in c:
                    uses[i, lang] += n * w / sum(weight)
    assert langs == ["x", "y"] and got == pytest.approx(uses / uses.sum(axis=0), rel=1e-6)


def test_language_of_many_blocks(spark):
    """250 languages, each with a word of its own, in blocks: all are learned, and blocks change no result."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(4 * i + k, f"{name(i)} {name(i)} {name(i)}qu", f"l{i:03d}") for i in range(250) for k in range(2)] + [(None, None, "l000"), (2001, "123", "l001")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    results = []
    for at_once in (40, 1000):
        blocks = langid.train(docs, rounds=1, langs_at_once=at_once)
        assert [lang for langs, _ in blocks for lang in langs] == [f"l{i:03d}" for i in range(250)]
        results.append(sorted((-1 if r["doc_id"] is None else r["doc_id"], r["lang"], r["l"]["lang_pred"], round(r["l"]["score"], 9)) for r in langid.predicted(docs, "text", blocks).collect()))
    assert results[0] == results[1] and sum(lang == pred for _, lang, pred, _ in results[0]) > 450
    assert [r[2:] for r in results[0] if r[0] in (-1, 2001)] == [("und", 0.0)] * 2


def test_language_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.98


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 % 10 + int(c) // 5 for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(rules) for m in re.finditer(p, t) if ok(m.group()))
    return ",".join(f"{n}:{a}:{e}" for a, _, e, n in found)


def test_pii(make, docs):
    assert pii.spans(docs).count() == docs.count()
    rng = random.Random(5)
    parts = ["a@b.co", "x.y@d.e.f%g@h.i", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "(415) 555-2671", " ", "é", "\n", "bob (at) ex (dot) org", "+", "9", "call 212-555-0199 now"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["1.1.1.1 " * 3000, "9" * 20000, None]
    df = make([(i, t, None, None) for i, t in enumerate(texts)])
    base = pii._told(F.filter("spans", lambda s: s["base"]))
    for r in pii.spans(df).select("doc_id", base.alias("base"), pii._told(F.col("spans")).alias("every")).collect():
        assert r["base"] == base_spans(texts[r["doc_id"]] or "")
        assert not set(filter(None, r["base"].split(","))) - set(r["every"].split(","))


def test_pii_secrets(make):
    """Keys after their names are told, with their places; long names with numbers, without one, are not."""
    rng = random.Random(6)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    names = [f"report-of-the-{rng.randint(1000, 9999)}-meetings-{rng.randint(1000, 9999)}" for _ in range(60)]
    shape = ['é token = "{}" on', "password: {}.", "{}"]
    texts = [shape[i % 2].format(k) for i, k in enumerate(keys)] + [f"see {n} for more" for n in names] + [None, "", f'Key="{keys[0]}" and secret = {keys[1]}']
    got = {r["doc_id"]: r["every"] for r in pii.spans(make([(i, t, None, None) for i, t in enumerate(texts)])).select("doc_id", pii._told(F.col("spans")).alias("every")).collect()}
    place = lambda t, k: f"secret:{t.index(k)}:{t.index(k) + 40}"
    assert all(place(texts[i], k) in got[i].split(",") for i, k in enumerate(keys))
    assert not any("secret" in got[60 + i] for i in range(62))
    assert [place(texts[-1], k) for k in keys[:2]] == [x for x in got[122].split(",") if x.startswith("secret")]


def test_reliabilities_prefer_agreeing_labelers():
    p = pii.reliabilities({(0, 1, 1, 1): 50, (0, 0, 0, 0): 50, (0, 1, 1, -1): 10, (0, 0, 0, 1): 5})
    assert p[0, 1, 1, 1] > 0.9 and p[0, 0, 0, 0] < 0.1 and p[0, 0, 0, 1] < 0.5


def test_quality_rules(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    for r in quality_rules.judged(docs, none).collect():
        assert not r["kept"] or r["n_words"] >= 50
    texts = ["a b c a b c d a b c", "x\ny\nx\n\n\nx z", "# $ % a|b", "q " * 60, "", " ".join(map(str, range(70)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judged(df, none).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        tri = list(zip(w, w[1:], w[2:]))
        n = Counter(tri)
        covered = {k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


@pytest.mark.parametrize("most", [0, 10**6])
def test_quality_ratio_by_brute_force(spark, monkeypatch, most):
    """Both multinomials, the ratio, the whisker and the verdict in plain Python; hashes are Spark's own."""
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", most)
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh" if i % 3 else "stuvwxyz") * 2 for _ in range(80 + i)) for i in range(60)] + ["", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    good = {i for i in range(60) if i % 3} - {1, 2}
    trusted = spark.createDataFrame([(i,) for i in [*good, *good, None]], "doc_id long")
    grams = {t: WORD.findall(t) for t in texts}
    every = sorted({x for w in grams.values() for x in w})
    hashed = dict(zip(every, [r[0] for r in spark.createDataFrame([(x,) for x in every], "x string").select(F.xxhash64("x")).collect()]))
    couples = sorted({(a, b) for w in grams.values() for a, b in zip(w, w[1:])})
    pair = dict(zip(couples, [r[0] for r in spark.createDataFrame([(hashed[a], hashed[b]) for a, b in couples], "a long, b long").select(F.xxhash64("a", "b")).collect()]))
    buckets = lambda t: [x % quality_rules.BUCKETS for x in [*(hashed[w] for w in grams[t]), *(pair[c] for c in zip(grams[t], grams[t][1:]))]]
    raw, own = Counter(b for t in texts for b in buckets(t)), Counter(b for i in good for b in buckets(texts[i]))
    total = [sum(c.values()) + quality_rules.BUCKETS for c in (raw, own)]
    ratio = lambda b: np.log((own[b] + 1) / total[1]) - np.log((raw[b] + 1) / total[0])
    want = [sum(map(ratio, buckets(t))) / (2 * len(grams[t]) - 1) if grams[t] else 0 for t in texts]
    got = {r["doc_id"]: r for r in quality_rules.judged(df, trusted).collect()}
    assert [got[i]["llr"] for i in range(len(texts))] == pytest.approx(want, abs=1e-9)
    steps = Counter(int(np.floor(want[i] / quality_rules.SCORE_STEP)) for i in good)
    least = quality_rules.whisker(list(steps.items()))
    assert all(got[i]["kept"] == (not got[i]["base_failed"] and want[i] >= least) for i in range(len(texts)))
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in good)


def test_whisker():
    assert quality_rules.whisker([]) == 0
    assert quality_rules.whisker([(-900, 1), (-4, 1), (0, 10), (1, 10), (2, 10)]) == -4 * quality_rules.SCORE_STEP


def test_repeated_windows_of_one_hash(spark):
    """Windows that share a hash but not their words are no repeats."""
    df = spark.createDataFrame([([7, 7, 7, 9, 9], "a b c d a b c".split()), ([7, 7, 8, 9, 7], "a b c x a b c".split())], "h array<long>, w array<string>")
    assert [r[0] for r in df.select(quality_rules.covered(F.col("h"), F.col("w"))).collect()] == [0, 6]


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_statistics_do_not_depend_on_pieces(piece):
    rng = random.Random(4)
    texts = ["", "a a\na a\n\nb", " \n", "".join(rng.choice("ab \n\t#1") for _ in range(3000)), "x" * 100]
    for t in texts:
        w, lines = t.encode().split(), [x for x in t.encode().split(b"\n") if x]
        got = quality_model.statistics(t.encode(), piece)
        if t:
            assert got[11] == pytest.approx(len(set(w)) / max(len(w), 1) + (len(lines) - len(set(lines))) / max(len(lines), 1))
            assert got[12] == pytest.approx(sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1))
            assert got.tolist() == quality_model.statistics(t.encode()).tolist()


def test_ridge_like_numpy(spark):
    """Partition-summed normal equations and calibration against one numpy solve over all rows."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, quality_model.N_STATS))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(k), i % 4) for i, (v, k) in enumerate(zip(x, y))], "stats array<double>, y int, part int").repartition(5)
    model = quality_model.fit(df)
    assert model.mean == pytest.approx(x.mean(axis=0)) and model.spread == pytest.approx(x.std(axis=0))
    fits, held = np.arange(300) % 4 != 0, np.arange(300) % 4 == 0
    z = model.features(x[fits])
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + quality_model.RIDGE * np.eye(z.shape[1]), z.T @ y[fits]), rel=1e-5, abs=1e-7)
    raw = np.clip(((model.raw(x[held]) + 0.5) / 2 * quality_model.BINS).astype(int), 0, quality_model.BINS - 1)
    bins = np.unique(raw)
    values = quality_model.pooled(np.array([y[held][raw == b].sum() for b in bins]), np.array([(raw == b).sum() for b in bins]))
    assert model.knots[1] == pytest.approx(values) and (np.diff(values) >= 0).all()


def test_quality_model(spark, docs):
    got = quality_model.scored(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == docs.count() and all(r["score"] == 0.5 for r in got)
    assert quality_model.pooled(np.array([1, 0, 3.0]), np.array([2, 2, 3.0])).tolist() == [0.25, 0.25, 1]
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = quality_model.scored(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels, "doc_id")
    assert held.where("predicted = quality").count() / held.count() > 0.9


MIT_FILE = """MIT License

Copyright (c) 2020 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL_NOTICE = """# This file is part of a tool.
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
import os
"""
BSD_FILE = """Copyright (c) 2011, Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_FILE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License.

      "Legal Entity" shall mean the union of the acting entity and all
      other entities that control, are controlled by, or are under common
      control with that entity.
"""
NOTICES = {
    MIT_FILE: "MIT", BSD_FILE.format(""): "BSD-2-Clause", BSD_FILE.format(THIRD): "BSD-3-Clause", APACHE_FILE: "Apache-2.0",
    GPL_NOTICE.format("", 3): "GPL-3.0", GPL_NOTICE.format("Affero ", 3): "AGPL-3.0", GPL_NOTICE.format("Lesser ", 3): "LGPL-3.0",
    "# Project released under the MIT License.": "MIT", "Code released under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Apache License, Version 2.0 (see NOTICE).": "Apache-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "words before\nLicensed under CC BY-SA 4.0.\nwords after": "CC-BY-SA-4.0", "Released under\n * the MIT\n * License. " + "filler " * 3000: "MIT",
    "the licensed electrician has a driving license and a permission": None, "This program is free and the software is released under pressure": None,
}


@pytest.mark.parametrize("others", [0, 2000])
def test_licence_wordings(spark, others):
    """Known wordings are recognised with words around them, in a small corpus and in one of many other words."""
    rng = random.Random(2)
    filler = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30)) for _ in range(others)]
    around = [(t if i % 2 else f"{filler[i] if others else 'some words'}\n{t}\nand what follows it", name) for i, (t, name) in enumerate(NOTICES.items())]
    rows = [(i, f"f{i}", t, name) for i, (t, name) in enumerate([*around, *((t, None) for t in filler)])]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, start string")
    got = {r["doc_id"]: r["own_license"] for r in licenses.scan(df).collect()}
    assert got == {i: name for i, _, _, name in rows}


def test_license_cosine_by_brute_force(spark):
    """Scores of all spans laid at a telling term, in plain Python, over mixed-up parts of the wordings; tiny stretches."""
    import math

    rng = random.Random(8)
    short = [t for _, t in licenses.TEMPLATES if len(t) < 120] + ["free software for any purpose", "a license to the work"]
    texts = ["", None, "license " * 700] + [" ".join(rng.choice([rng.choice(short), "one two", " ".join(rng.choice(short).split()[:4])]) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    df = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    words = [re.findall(licenses._TERM, (t or "").lower()) for t in texts]
    df_of = Counter(x for w in words for x in set(w))
    idf = defaultdict(lambda: licenses.inverse(len(texts), 0), {t: licenses.inverse(len(texts), n) for t, n in df_of.items()})
    best = {}
    for name, text in licenses.TEMPLATES:
        own = licenses.Template(name, text, idf, licenses.LEAST)
        for i, w in enumerate(words):
            starts = {max(at - place, 0) // own.stride * own.stride for at, t in enumerate(w) if t in own.telling for place in own.places(t)}
            for s in starts:
                counts = Counter(w[s : s + len(own.terms)])
                size = math.sqrt(sum(((1 + math.log(n)) * idf[t]) ** 2 for t, n in counts.items()))
                score = round(sum((1 + math.log(n)) * idf[t] * own.weights.get(t, 0) for t, n in counts.items()) / size / own.size, 6)
                if score >= licenses.LEAST:
                    best[i] = min(best.get(i, (0, "")), (-score, name))
    got = {r["doc_id"]: (-r["score"], r["own_license"]) for r in licenses.scan(df).collect() if r["own_license"]}
    assert got.keys() == best.keys() and len(best) > 50
    assert all(got[i][1] == best[i][1] and got[i][0] == pytest.approx(best[i][0], abs=2e-6) for i in best)


def test_licenses_against_every_start(spark):
    """Long wordings with words replaced at random: of the texts that reach the least score at any start at all, nine in ten or more
    are found, and none of the others."""
    rng = random.Random(11)
    long = [(name, text) for name, text in licenses.TEMPLATES if len(re.findall(licenses._TERM, text.lower())) >= 30]
    texts = []
    for i in range(160):
        words = re.findall(licenses._TERM, rng.choice(long)[1].lower())
        share = rng.choice((0.2, 0.3, 0.35))
        words = [f"w{rng.randint(0, 500)}" if rng.random() < share else w for w in words]
        around = lambda: [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 60))]
        texts.append(" ".join([*around(), *words, *around()]))
    split = [re.findall(licenses._TERM, t) for t in texts]
    df_of = Counter(t for w in split for t in set(w))
    idf = defaultdict(lambda: licenses.inverse(len(texts), 0), {t: licenses.inverse(len(texts), n) for t, n in df_of.items()})
    given = [licenses.Template(name, text, idf, licenses.LEAST) for name, text in long]
    want = set()
    for i, words in enumerate(split):
        for t in given:
            for start in range(max(1, len(words) - len(t.terms) // 2)):
                own = {x: (1 + np.log(n)) * idf[x] for x, n in Counter(words[start : start + len(t.terms)]).items()}
                if sum(w * t.weights.get(x, 0) for x, w in own.items()) >= licenses.LEAST * t.size * sum(w * w for w in own.values()) ** 0.5:
                    want.add(i)
                    break
    df = spark.createDataFrame([(i, f"p/{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"] for r in licenses.scan(df, texts=long).collect() if r["own_license"]}
    assert 50 < len(want) < 160 and got <= want and len(got) >= 0.95 * len(want), (len(got), len(want))


def test_licenses_odd_rows(spark):
    rows = [(1, "a/LICENSE", MIT_FILE), (2, "a/b/c/x.py", "import os"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\nx"), (4, "z/x.py", None), (5, None, "text"), (6, "a/b/c/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."), (None, "a/b/c/d/q.py", ""), (2, "a/b/c/x.py", "import os")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, path string, text string, row int, directory string")
    found = licenses.scan(df)
    got = {r["path"]: (r["license"], r["origin"], r["given_by"]) for r in found.collect()}
    assert found.count() == len(rows)
    assert got["a/b/y.py"] == ("Apache-2.0", "own", None) and got["a/LICENSE"][0] == "MIT"
    assert got["a/b/c/x.py"] == ("GPL-3.0", "inherited", "a/b/c") and got["a/b/c/d/q.py"] == ("GPL-3.0", "inherited", "a/b/c")
    assert got["z/x.py"] == (None, "none", None) and got[None][1] == "none"
    assert licenses.scan(df.limit(0)).count() == 0


def test_pipeline_by_steps(spark):
    """run() against plain Python for the stages it can say, on what each predecessor kept."""
    import corpus_pipeline
    from test_similar import groups
    from tokenizers import Tokenizer

    from segmentry.llm.common import stored

    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    first = stored(stages["language_id"](spark, spark.read.parquet(f"{d}/documents.parquet"), d), "t1")
    assert {r["doc_id"] for r in first.collect()} == {i for i, r in docs.items() if any(map(str.isalpha, r["text"] or ""))}
    second = stored(stages["exact_dedup"](spark, first, d), "t2")
    best = {}
    for r in first.collect():
        best[r["text"].translate(LOWER)] = max(best.get(r["text"].translate(LOWER), -1), r["doc_id"])
    assert {r["doc_id"] for r in second.collect()} == set(best.values())
    third = stored(stages["near_dedup"](spark, second, d), "t3")
    reached = groups([(r["doc_id"], r["text"]) for r in second.collect()])
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(set(reached.values())) and len(set(reached.values())) < len(reached)
    fourth = stored(stages["mix_sources"](spark, third, d), "t4")
    times = Counter({r["doc_id"]: r["times"] for r in mixing.mix(third).collect()})
    assert Counter(r["doc_id"] for r in fourth.collect()) == +times
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter()
    for r in fourth.collect():
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, d).collect())) == want


def test_pipeline_stages_on_odd_rows(spark, docs):
    """Every stage on odd and on no rows: the columns stay, and only what a stage is for goes."""
    import corpus_pipeline

    from segmentry.llm.common import stored

    lettered = [r for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, None), "odd")
        assert after.columns == docs.columns
        if name == "language_id":
            assert after.count() <= len(lettered)
        if name == "exact_dedup":
            assert after.count() == len({(r["text"] or "").translate(LOWER) for r in docs.collect()})
        if name == "mix_sources":
            assert after.count() == sum(r["times"] for r in mixing.mix(docs).collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() == docs.count()
