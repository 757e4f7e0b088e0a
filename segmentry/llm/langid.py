"""Language ID by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. A word's probability is the sum, over all ways
to cut it into pieces, of the product of their probabilities: a forward pass over its characters, made for many words
at once. A text's is the product over its words (runs of letters, lower-cased), and the language with the largest
posterior under equal priors is predicted.

Training: expectation-maximisation with the same forward pass and a backward one, over the word counts of a sample:
at most about ``max_docs`` documents a language, taken by a hash of id and text (all of them where there are fewer). Every
language is learned; as they do not depend on one another, they are learned, and texts scored, in blocks of ``langs_at_once``
languages, and only a text's best language and the sum of its likelihoods are carried from block to block. Longer words
than 32 letters are learned from in parts of that length. Every document is scored, each on its whole text and every word
as a whole; words of more letters go through the same forward pass by themselves, rescaled as they go.

Defined cases: null text, or a text without a letter, is ``und`` with score 0, as is all when no language was learned;
ties go to the first language in order; characters outside the vocabulary are one piece of their own; null or repeated
ids and repeated rows are scored each; rows with a null id are not learned from; columns other than doc_id, text and lang
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from segmentry.llm.common import crc_mod, in_small_batches, read, stored, text_or_empty

MAX_DOCS, LANGS_AT_ONCE, ROUNDS, SMOOTH = 5000, 200, 3, 0.02
#: Longer words are scored one by one, and learned from in parts; the table of known words is emptied beyond so many.
WORD_CHARS, BATCH_CHARS, KNOWN_WORDS = 32, 1 << 19, 300_000
_LETTERS, _NO_LETTER = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces as a trie in sorted arrays; piece 0 stands for a character that is not a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        pieces = ["", *sorted({model.id_to_piece(i).lower() for i in plain} - {""})]
        self.n = len(pieces)
        nodes, steps, self.piece_at = {"": 0}, {}, [0]
        for i, piece in enumerate(pieces):
            for end in range(1, len(piece) + 1):
                if piece[:end] not in nodes:
                    nodes[piece[:end]] = len(nodes)
                    self.piece_at.append(0)
                    steps[nodes[piece[: end - 1]] << 21 | ord(piece[end - 1])] = nodes[piece[:end]]
            self.piece_at[nodes[piece]] = i
        self.keys = np.array(sorted(steps), np.int64)
        self.to = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.piece_at, self.longest = np.array(self.piece_at), max(map(len, pieces))

    def edges(self, words: list[str], mark: str = "▁") -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of every piece in every word, by end."""
        marked = [mark + w for w in words]
        sizes = np.array([len(w) for w in marked])
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, node, reach, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0, []
        while len(at):
            alive = at + reach < len(chars)
            at, node = at[alive], node[alive]
            inside = word[at + reach] == word[at]
            at, node = at[inside], node[inside]
            key = node << 21 | chars[at + reach]
            hit = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[hit] == key
            reach += 1
            piece = np.where(ok, self.piece_at[self.to[hit]], 0)
            emit = (piece > 0) | (reach == 1)
            found.append(np.stack([word[at], place[at], place[at] + reach, piece])[:, emit])
            at, node = at[ok], self.to[hit[ok]]
        every = np.concatenate(found, axis=1)
        return tuple(every[:, np.argsort(every[2], kind="stable")])

    def forward(self, words: list[str], p: np.ndarray):
        """Sums over all segmentations of each prefix: [word, chars of it, language]; and the edges."""
        word, start, end, piece = edges = self.edges(words)
        alpha = np.zeros((len(words), max(map(len, words), default=0) + 2, p.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, end.max(initial=0) + 1):
            e = slice(*np.searchsorted(end, [j, j + 1]))
            np.add.at(alpha, (word[e], j), alpha[word[e], start[e]] * p[piece[e]])
        return alpha, edges

    def score(self, words: list[str], p: np.ndarray, most: int = WORD_CHARS) -> np.ndarray:
        """Log probabilities: [word, language]."""
        out, short = np.zeros((len(words), p.shape[1])), np.array([len(w) <= most for w in words], bool)
        few = [w for w in words if len(w) <= most]
        if few:
            alpha, _ = self.forward(few, p)
            out[short] = np.log(alpha[np.arange(len(few)), [len(w) + 1 for w in few]] + 1e-300)
        for i in np.flatnonzero(~short):
            out[i] = self.score_long(words[i], p)
        return out

    def score_long(self, word: str, p: np.ndarray, part: int = 4096) -> np.ndarray:
        """The same forward pass over a word of any length, which keeps only the sums that a piece can still reach."""
        marked, room = "▁" + word, self.longest + 1
        alpha, log = np.zeros((room, p.shape[1])), np.zeros(p.shape[1])
        alpha[0] = 1
        for at in range(0, len(marked), part):
            _, start, end, piece = self.edges([marked[at : at + part + self.longest]], mark="")
            order = np.argsort(start, kind="stable")
            start, end, chance = start[order], end[order], p[piece[order]]
            cuts = np.searchsorted(start, np.arange(part + 1))
            for j in range(min(part, len(marked) - at)):
                e, here = slice(cuts[j], cuts[j + 1]), (at + j) % room
                alpha[(at + end[e]) % room] += alpha[here] * chance[e]
                alpha[here] = 0
                if j % 8 == 0:
                    top = alpha.max(axis=0)
                    alpha /= top
                    log += np.log(top)
        return np.log(alpha[len(marked) % room] + 1e-300) + log

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece; counts: [word, language]."""
        alpha, (word, start, end, piece) = self.forward(words, p)
        last = np.array([len(w) + 1 for w in words])
        beta = np.zeros_like(alpha)
        beta[np.arange(len(words)), last] = counts / (alpha[np.arange(len(words)), last] + 1e-300)
        for j in range(end.max(initial=0), 0, -1):
            e = slice(*np.searchsorted(end, [j, j + 1]))
            np.add.at(beta, (word[e], start[e]), beta[word[e], j] * p[piece[e]])
        out = np.zeros((self.n, p.shape[1]))
        np.add.at(out, piece, alpha[word, start] * p[piece] * beta[word, end])
        return out


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _stretches(text: str, size: int) -> Iterator[str]:
    """Stretches of ``text`` that end before a character that is no letter."""
    at = 0
    while at < len(text):
        cut = _NO_LETTER.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


#: Languages and their piece probabilities, [piece, language].
Block = tuple[list[str], np.ndarray]


def train(docs: DataFrame, max_docs: int = MAX_DOCS, rounds: int = ROUNDS, path: str | None = None, langs_at_once: int = LANGS_AT_ONCE) -> list[Block]:
    """All languages of ``docs`` (doc_id, text, lang) in blocks, by name, from rows with a language and an id."""
    path = path or default_vocabulary()
    docs = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    n_docs = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    langs = sorted(r["lang"] for r in n_docs.select("lang").collect())
    blocks = [langs[at : at + langs_at_once] for at in range(0, len(langs), langs_at_once)]
    if not blocks:
        return []
    share = F.create_map(*[F.lit(x) for r in n_docs.collect() for x in (r["lang"], min(1.0, max_docs / r["n_docs"]))])
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    token = F.regexp_extract_all(F.lower(text_or_empty()), F.lit(rf"\p{{L}}{{1,{WORD_CHARS}}}"), F.lit(0))
    tokens = docs.where(chosen).select("lang", F.explode(token).alias("word"))
    counts = stored(tokens.groupBy("word", "lang").count(), "word-counts")
    return [_trained(counts.where(F.col("lang").isin(block)) if len(blocks) > 1 else counts, block, rounds, path) for block in blocks]


def _trained(counts: DataFrame, langs: list[str], rounds: int, path: str) -> Block:
    """Expectation-maximisation over counts (word, lang, count) of ``langs``."""
    column = {lang: i for i, lang in enumerate(langs)}
    p = np.full((pieces(path).n, len(langs)), 1 / pieces(path).n)
    for _ in range(rounds):

        def uses(batches, p=p):
            total = np.zeros((pieces(path).n, len(column)))
            for batch in batches:
                for at in range(0, len(batch), 5000):
                    part = batch.iloc[at : at + 5000]
                    names, words = pd.factorize(part["word"])
                    n = np.zeros((len(words), len(column)))
                    np.add.at(n, (names, part["lang"].map(column).to_numpy()), part["count"].to_numpy())
                    total += pieces(path).expected(list(words), n, p)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        sums = counts.mapInPandas(uses, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        p = np.full_like(p, SMOOTH)
        p[sums["piece"], sums["lang"]] += sums["n"]
        p /= p.sum(axis=0)
    return langs, p


#: Of the languages seen so far: the best one, its log probability, the sum of all over the best; and whether there is a word.
_SEEN = StructType([StructField("lang", StringType()), StructField("top", DoubleType()), StructField("mass", DoubleType()), StructField("n", LongType())])


class Scorer:
    def __init__(self, path: str, p: np.ndarray):
        self.pieces, self.p = pieces(path), p
        self.forget()

    def forget(self):
        self.row, self.rows, self.chars = {"": 0}, np.zeros((1, self.p.shape[1])), 0

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of texts, and their numbers of words."""
        split = [[w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in _LETTERS.findall(t.lower())] for t in texts]
        if len(self.row) > KNOWN_WORDS or self.chars > KNOWN_WORDS * WORD_CHARS:
            self.forget()
        if new := list(set().union(*split) - self.row.keys()):
            scored = [self.pieces.score(new[i : i + 5000], self.p) for i in range(0, len(new), 5000)]
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            self.chars += sum(map(len, new))
            self.rows = np.concatenate([self.rows, *scored])
        n = np.array([len(s) for s in split])
        at = np.fromiter((self.row[w] for s in split for w in s), np.int64, n.sum())
        sums = np.add.reduceat(np.append(self.rows[at], [self.rows[0] * 0], axis=0), np.minimum(np.cumsum(n) - n, len(at)), axis=0)
        return np.where(n[:, None] > 0, sums, 0), n


_SCORERS: dict = {}


def likelihoods(text: Column | str, langs: list[str], p: np.ndarray, path: str | None = None) -> Column:
    """A struct (lang, top, mass, n) for a text column: the best language of the block, the log of its probability, the sum
    of all the block's probabilities over that of the best, the number of words."""
    path = path or default_vocabulary()
    model = hashlib.sha256(p.tobytes()).hexdigest()

    @F.arrow_udf(_SEEN)
    def seen(texts: pa.Array) -> pa.Array:
        if model not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model] = Scorer(path, p)
        scorer, total, n = _SCORERS[model], np.zeros((len(texts), len(langs))), np.zeros(len(texts), np.int64)
        group, chars = [], 0

        def settle():
            if group:
                sums, words = scorer.sums([t for _, t in group])
                rows = [r for r, _ in group]
                np.add.at(total, rows, sums)
                np.add.at(n, rows, words)
                group.clear()

        for row, text in enumerate(texts):
            text = text.as_py() or ""
            for part in _stretches(text, BATCH_CHARS):
                group.append((row, part))
                chars += len(part)
                if chars >= BATCH_CHARS:
                    settle()
                    chars = 0
        settle()
        best, top = total.argmax(axis=1), total.max(axis=1)
        mass = np.exp(total - top[:, None]).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array([langs[b] for b in best], pa.string()), pa.array(top), pa.array(mass), pa.array(n)], names=_SEEN.names)

    return seen(text)


def _merged(a: Column, b: Column) -> Column:
    """Of two blocks' likelihoods, those of both together; ties go to the first."""
    first = a["top"] >= b["top"]
    mass = F.when(first, a["mass"] + b["mass"] * F.exp(b["top"] - a["top"])).otherwise(b["mass"] + a["mass"] * F.exp(a["top"] - b["top"]))
    return F.struct(F.when(first, a["lang"]).otherwise(b["lang"]).alias("lang"), F.greatest(a["top"], b["top"]).alias("top"), mass.alias("mass"), a["n"].alias("n"))


def predicted(rows: DataFrame, text: str, blocks: list[Block], path: str | None = None) -> DataFrame:
    """Adds l, a struct (lang_pred, score), for the column ``text``. With several blocks, what is seen so far is written to the
    shared folder between them, so a task holds one block."""
    if not blocks:
        return rows.withColumn("l", F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")))
    rows = in_small_batches(rows)
    for i, (langs, p) in enumerate(blocks):
        found = likelihoods(F.col(text), langs, p, path)
        if i:
            rows = stored(rows.withColumn("now", found), "languages").withColumn("seen", _merged(F.col("seen"), F.col("now"))).drop("now")
        else:
            rows = rows.withColumn("seen", found)
    some = F.col("seen.n") > 0
    l = F.struct(F.when(some, F.col("seen.lang")).otherwise("und").alias("lang_pred"), F.when(some, 1 / F.col("seen.mass")).otherwise(0.0).alias("score"))
    return rows.withColumn("l", l).drop("seen")


def _learned(docs: DataFrame, langs_at_once: int) -> list[Block]:
    return train(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"), langs_at_once=langs_at_once)


def languages(docs: DataFrame, langs_at_once: int = LANGS_AT_ONCE) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return predicted(rows, "text", _learned(docs, langs_at_once)).select("doc_id", "held_out", "l.*")


def with_language(docs: DataFrame, least: float = 0.5, langs_at_once: int = LANGS_AT_ONCE) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a posterior of at least ``least``."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    found = predicted(docs.select(row.alias("row")), "row.text", _learned(docs, langs_at_once))
    return found.where((F.col("l.lang_pred") != "und") & (F.col("l.score") >= least)).select("row.*")


def op9_language_id(spark, sf_dir):
    return languages(read(spark, sf_dir, "documents"))
