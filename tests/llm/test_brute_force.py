"""Whole queries and their parts against plain Python: chat digests, components, statistics and features, all code points."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from segmentry.llm import bpe, chat, near_dedup, quality_model

CONTROL = re.compile(r"<\||</?s>|\[/?INST\]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_digests_with_clashing_columns_and_long_texts(spark, tmp_path):
    rng = random.Random(2)
    bits = ["<|end|>", "<|turn|>", "\\", "[INST]", "</s>", "<", "[", "|", "word ", "\n", "é", "漢"]
    text = lambda n: "".join(rng.choice(bits) for _ in range(n))
    rows = [(1, 0, "user", text(60_000)), (1, 1, "assistant", "x" * 500_000 + text(9)), (1, 2, "assistant", text(40_000))]
    rows += [(2, k, rng.choice(["user", "assistant", None, "<|x"]), rng.choice([text(12), "", None])) for k in range(80)]
    rows += [(3, 0, "user", None), (4, 0, "assistant", None), (None, 3, "assistant", "r"), (None, 1, "user", "q"), (5, 0, "assistant", "s"), (5, 0, "assistant", "s")]
    clashing = "t pieces roles chars example formatted loss_start loss_chars raw piece whole turns loss".split()
    fields = ", ".join(f"{c} string" for c in clashing)
    df = spark.createDataFrame([(*r, *["<|end|>"] * len(clashing)) for r in rows], f"conv_id long, turn long, role string, text string, {fields}")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    ok = "</s>[INST] ok [/INST]"
    told = defaultdict(list)
    for conv, turn, role, said in [*rows, (-7, 0, "user", ok), (-7, 1, "assistant", ok)]:
        told[conv].append((turn, role or "", said or ""))
    want = {}
    for conv, turns in told.items():
        turns.sort()
        sizes = [23 + sum(len(s) + s.count("\\") + len(CONTROL.findall(s)) for s in (r, x)) for _, r, x in turns]
        upto, loss = np.cumsum(sizes).tolist(), "".join(x for _, r, x in turns if r == "assistant")
        chars = sum(n for i, (n, t) in enumerate(zip(upto, turns)) if t[1] == "assistant" or i == len(turns) - 1)
        want[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), chars)
    found = chat.op2_chat_format(spark, str(tmp_path))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in found.collect()}
    assert got == want


def test_component_ids_like_plain_search(spark):
    rng = np.random.default_rng(8)
    prints = [int(p) for p in rng.integers(0, 2**62, 60)]
    for _ in range(90):  # chains of links, one or two bits a step
        at = prints[int(rng.integers(0, len(prints)))]
        for j in rng.choice(62, int(rng.integers(1, 3)), replace=False):
            at ^= 1 << int(j)
        prints.append(at)
    ids = [None if rng.random() < 0.3 else int(i) for i in rng.permutation(300)[:200]]
    rows = [(ids[i], "f", i, prints[int(rng.integers(0, len(prints)))]) for i in range(200)]
    known = spark.createDataFrame(rows, "doc_id long, key_file string, key_row long, print long")
    classes = known.groupBy("print").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "first_id")
    placed = near_dedup.placed_rows(known, classes, near_dedup.components(near_dedup.links(classes.select("print"), 2))).collect()
    seen, of = sorted({r[3] for r in rows}), {}
    for first in seen:
        if first in of:
            continue
        of[first], todo = first, [first]
        while todo:
            a = todo.pop()
            for b in seen:
                if b not in of and (a ^ b).bit_count() <= 2:
                    of[b] = first
                    todo.append(b)
    smallest = {}
    for doc, _, _, p in rows:
        smallest[of[p]] = min((d for d in (doc, smallest.get(of[p])) if d is not None), default=None)
    assert {r["key_row"]: (r["doc_id"], r["component_id"]) for r in placed} == {k: (d, smallest[of[p]]) for d, _, k, p in rows}
    assert len(set(of.values())) < len(seen)


def test_statistics_like_regular_expressions():
    rng = random.Random(6)
    texts = ["a", "A|b! \n\n#x", "É 漢字 é", "x" * 70, *("".join(rng.choice("aB 9#|!.\né,&") for _ in range(rng.randint(1, 400))) for _ in range(60))]
    for t in texts:
        data = t.encode()
        w, lines = data.split(), [x for x in data.split(b"\n") if x]
        many = lambda p: len(re.findall(p, data))
        n, k = len(data), max(len(w), 1)
        upper, lower = many(rb"[A-Z]"), many(rb"[a-z]")
        want = [
            np.log(1 + n), np.log(1 + len(w)), min(n / k, 50), upper / max(upper + lower, 1), many(rb"[0-9]") / n, many(rb"[#*$%&|<>]") / k, many(rb"!") / k,
            many(rb"[.,:;?]") / k, many(rb"\n") / k, many(rb"[\x80-\xff]") / n, many(rb"\|") / k,
            len(set(w)) / k + (len(lines) - len(set(lines))) / max(len(lines), 1), sum(a == b for a, b in zip(w, w[1:])) / k,
        ]
        assert quality_model.statistics(data).tolist() == pytest.approx(want)


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, quality_model.N_STATS))
    z = quality_model.Model(np.zeros(quality_model.N_STATS), np.ones(quality_model.N_STATS)).features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * quality_model.WIDTH**2))
    off = np.abs(z @ z.T - kernel)
    # the mean of 128 cosines has a deviation of at most 1 / sqrt(128) = 0.09
    assert off.mean() < 0.09 and off.max() < 0.4


def test_all_code_points_like_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Bpe(bpe.default_vocabulary())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 2048):
        text = "".join(f"a{c}1 {c}'s" for c in points[at : at + 2048])
        ids = lib.encode(text, add_special_tokens=False).ids
        mine = b"".join(own.encode(list(own.pieces(text))))
        assert np.frombuffer(mine, "<u4").tolist() == ids, hex(ord(points[at]))
        assert own.decode(mine) == lib.decode(ids, skip_special_tokens=False)
