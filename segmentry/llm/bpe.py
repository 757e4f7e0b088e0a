"""BPE encoding and decoding in batched numpy merge rounds.

The words of many texts that are not in the worker's table yet lie in one flat array of symbol ids. A round forms the key
``left * size + right`` of every adjacent pair, finds it by binary search among the sorted keys of all merges, takes the
lowest rank of each word, merges there, and closes the gaps; words without a merge leave the array. The table of known
words is bounded and only saves work. The vocabulary file is read where its path points, once a worker.

Defined cases: null text counts as empty and has no tokens; strings of special tokens inside a text become those tokens,
as in the library; texts of any length are cut at white space, which no word spans; of pairs of one rank in a word the
first goes first; repeated rows are encoded each; columns other than doc_id and text are not looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from segmentry.llm.common import in_small_batches, read

#: The table of known words is emptied beyond so many words, or characters in them.
PIECE_CHARS, KNOWN_WORDS, KNOWN_CHARS = 1 << 18, 150_000, 1 << 24
_NONE = np.iinfo(np.int64).max
_CUT = re.compile(r"[ \t-\r]")
# Code points that newer Unicode tables than the library's have as letters or digits.
_NEWER = """
558 58b-58c 88f c5c cdc 1c89 208f 209d-209f a7cb-a7cc a7ce-a7cf a7d2 a7d4 a7da a7dc-a7dd a7e2 a7f1
ab6c-ab6d 107bb-107bf 10940-10959 10d50-10d65 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1
1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20
18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f
"""
_NEWER_SET = "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in _NEWER.split())
_HAS_NEWER = re.compile(f"[{_NEWER_SET}]")
# Capitals of newer Unicode tables, which the library lower-cases: first, last, small form of the first.
_NEWER_CAPITALS = """
1c89 1c89 1c8a, a7cb a7cb 264, a7cc a7cc a7cd, a7ce a7ce a7cf, a7d2 a7d2 a7d3, a7d4 a7d4 a7d5, a7da a7da a7db, a7dc a7dc 19b,
10d50 10d65 10d70, 16ea0 16eb8 16ebb
"""
_NEWER_SMALL = {a + i: small + i for a, b, small in ([int(x, 16) for x in row.split()] for row in _NEWER_CAPITALS.split(",")) for i in range(b - a + 1)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_signs() -> list[str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, the others as the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}
    return [rest.get(b, chr(b)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        self.nfc, self.lower = (any(s["type"] == kind for s in steps) for kind in ("NFC", "Lowercase"))
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        white = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        pattern = split["pattern"]["Regex"].replace(r"\s", white)
        self.words = regex.compile(pattern)
        # the same with the newer letters and digits among the other signs
        others = rf"[^{white}\p{{L}}\p{{N}}]"
        newer = pattern.replace(others, f"(?:{others}|[{_NEWER_SET}])")
        for kind in (r"\p{L}", r"\p{N}"):
            newer = newer.replace(f"[{kind}]", f"[{kind}--[{_NEWER_SET}]]")
        self.words_of_newer = regex.compile(newer, regex.V1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        signs = _byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + end] for s in signs], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in part], np.int64) for part in zip(*((a, b, a + b) for a, b in merges)))
        rank = np.arange(len(merges))
        # merging all places of a pair at once is only the same if no later pair of the new token has a lower rank
        first_use = np.full(self.size, _NONE)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks, self.made = (left * self.size + right)[order], rank[order], made[order]
        self.one_by_one = (first_use[made] < rank)[order]
        self.known: dict[str, bytes] = {}
        self.known_chars = 0

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each (non-empty) word, as little-endian unsigned 32-bit integers."""
        coded = [w.encode() for w in words]
        sizes = np.array([len(c) for c in coded])
        raw = np.frombuffer(b"".join(coded), np.uint8)
        ids, ends = self.inner[raw], np.cumsum(sizes) - 1
        ids[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [], []
        while len(ids):
            pair = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            found = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(found, self.ranks[at], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = best == _NONE
            done_ids.append(ids[over])
            done_owner.append(owner[over])
            here = np.flatnonzero((rank == best) & ~over)
            if len(here):
                run = np.append(True, np.diff(here) != 1)
                here = here[(here - np.maximum.accumulate(np.where(run, here, 0))) % 2 == 0]  # aaa: the first two
                again = np.append(False, owner[here[1:]] == owner[here[:-1]])
                here = here[~(again & self.one_by_one[at[here]])]
                ids[here] = self.made[at[here]]
                over[here + 1] = True
            ids, owner = ids[~over], owner[~over]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        ids = ids[np.argsort(owner, kind="stable")].astype("<u4")
        cuts = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def pieces(self, text: str) -> Iterator[str]:
        """Stretches of ``text`` that end before white space."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PIECE_CHARS)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def split(self, text: str) -> list[str]:
        found = []
        for n, part in enumerate(self.specials.split(text)):
            if n % 2:
                found.append(part)
                continue
            if self.nfc:
                part = unicodedata.normalize("NFC", part)
            newer = _HAS_NEWER.search(part)
            if self.lower:
                if newer:
                    part = part.translate(_NEWER_SMALL)
                part = part.replace("Σ", "σ").lower()  # sigma by itself, whatever follows
            found += (self.words_of_newer if newer else self.words).findall(part)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        need = set().union(*split)
        if len(self.known) > KNOWN_WORDS or self.known_chars > KNOWN_CHARS:
            self.known, self.known_chars = {}, 0
        if not self.known:
            self.known = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        if new := list(need - self.known.keys()):
            self.known.update(zip(new, self.merged(new)))
            self.known_chars += sum(map(len, new))
        return [b"".join(map(self.known.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        """The library's text for a vocabulary without a decoder: the tokens with blanks between."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def _groups(texts: pa.Array, codec: Bpe) -> Iterator[list[tuple[int, str]]]:
    """(row, stretch of its text), together up to about PIECE_CHARS."""
    group, chars = [], 0
    for row, text in enumerate(texts):
        for piece in codec.pieces(text.as_py() or ""):
            group.append((row, piece))
            chars += len(piece)
            if chars >= PIECE_CHARS:
                yield group
                group, chars = [], 0
    yield group


def encode(text: Column | str, path: str | None = None) -> Column:
    """The ids of a text column, as array<int>."""
    path = path or default_vocabulary()

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        codec, out = bpe(path), [[] for _ in texts]
        for group in _groups(texts, codec):
            for (row, _), coded in zip(group, codec.encode([t for _, t in group])):
                out[row].append(coded)
        flat = [b"".join(x) for x in out]
        offsets = np.append(0, np.cumsum([len(x) // 4 for x in flat])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), "<i4")))

    return ids(text)


def decode(ids: Column | str, path: str | None = None) -> Column:
    """The text of a column of ids."""
    path = path or default_vocabulary()

    @F.arrow_udf(StringType())
    def text(lists: pa.Array) -> pa.Array:
        codec = bpe(path)
        return pa.array([codec.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in lists])

    return text(ids)


_TRIP = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def round_trip(text: Column | str, path: str | None = None) -> Column:
    """Number and digest of the ids, and the digest of the text decoded from those ids, in one pass and stretch by stretch."""
    path = path or default_vocabulary()

    @F.arrow_udf(_TRIP)
    def trip(texts: pa.Array) -> pa.Array:
        codec = bpe(path)
        n, digests, back = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for group in _groups(texts, codec):
            for (row, _), coded in zip(group, codec.encode([t for _, t in group])):
                if coded:
                    digests[row].update(coded)
                    back[row].update((" " * bool(n[row]) + codec.decode(coded)).encode())
                    n[row] += len(coded) // 4
        columns = [pa.array(n, pa.int64()), *(pa.array([h.hexdigest() for h in x], pa.string()) for x in (digests, back))]
        return pa.StructArray.from_arrays(columns, names=_TRIP.names)

    return trip(text)


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    return in_small_batches(docs).select("doc_id", round_trip("text", path).alias("t")).select("doc_id", "t.*")


def op8_bpe_round_trip(spark, sf_dir):
    return round_trips(read(spark, sf_dir, "documents"))
