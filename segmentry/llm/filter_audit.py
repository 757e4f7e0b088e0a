"""Filter interaction audit: which filter of an ordered chain removes what, for every order, from one pass over the texts.

Texts are read once, by a byte transducer given as two tables over UTF-8: a byte's class is the state after it (between
words, capital, symbol, other ASCII, first byte of a longer character, later byte of one), and the action of a byte depends
on the state before it and its class: begin a word, end one, count a code point, a capital, a symbol. As the state after a
byte does not depend on the one before, a whole batch of texts goes through the tables at once. The word spans that it emits
are inserted into an open hash table, keyed by text and word; a slot is shared only by words whose bytes have been
compared, so the number of distinct words never depends on a hash.

A text's failed filters are five bits. Rows are counted by part, these bits and labels, and every number of the audit, for
all 120 orders, follows from these few counts: a filter removes the documents that fail it and none before it, and of the
120 orders it is the first of a document's k failed filters in 120 / k.

Filters: A: under 200 words (runs of other bytes than space and 0x09-0x0D). B: distinct words under half of them. C: A-Z over
3% of the code points. D: a character of ``#$%&*|``. E: the text equals that of a row with a smaller doc_id.

Defined cases: null text is empty, and fails A, and E if such a row has a smaller id (B and C compare 0 with 0); null lang is
the part with the empty name, as is an empty one; a null doc_id is neither smaller nor larger than others and has no labels; rows with equal ids are counted each
and are not smaller than one another; a document is good or toxic if any of its labels says so; very long texts are read in
pieces that end between words; other columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from segmentry.llm.common import read, stored, text_or_empty

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
#: Texts go through the tables in groups of about so many bytes; longer words are compared one by one.
GROUP_BYTES, LONG_WORD = 1 << 20, 256

_GAP, _CAPITAL, _SYMBOL, _OTHER, _FIRST, _LATER = range(6)
_BEGIN, _END, _POINT, _UPPER, _MARK = (1 << i for i in range(5))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and the action for (state before, class)."""
    state = np.full(256, _OTHER, np.uint8)
    state[list(b" \t\n\x0b\x0c\r")], state[65:91], state[list(SYMBOLS)], state[0xC0:], state[0x80:0xC0] = _GAP, _CAPITAL, _SYMBOL, _FIRST, _LATER
    action = np.zeros((6, 6), np.uint8)
    action[:, :_LATER] |= _POINT
    action[:, _CAPITAL] |= _UPPER
    action[:, _SYMBOL] |= _MARK
    action[_GAP, 1:] |= _BEGIN
    action[1:, _GAP] |= _END
    return state, action.ravel()


_STATE, _ACTION = _tables()
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def transduce(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Actions of all bytes of texts that begin at ``starts``; each text is entered from a gap."""
    after = _STATE[data]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[starts[starts < len(data)]] = _GAP
    return _ACTION[before * np.uint8(6) + after]


def _words_of(at: np.ndarray, size: np.ndarray, data: np.ndarray):
    """The 8-byte pieces of words, piece by piece: (words that have one, the piece, masked to the word)."""
    view = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    for k in range(int(size.max(initial=0) + 7) // 8):
        own = np.flatnonzero(size > 8 * k)
        yield own, view[at[own] + 8 * k] & _KEEP[np.minimum(size[own] - 8 * k, 8)]


def distinct_words(data: np.ndarray, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words are the first of their text in the table. ``data`` ends with 8 spare bytes.

    Open addressing: words that find a free slot enter it (of several one wins), then all look at who holds their slot: the
    same word of the same text, byte by byte, or else they go on to the next slot."""
    short = np.flatnonzero(size <= LONG_WORD)
    first, at_s, size_s = np.zeros(len(at), bool), at[short], size[short]
    h = text[short].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size_s.astype(np.uint64)
    for own, piece in _words_of(at_s, size_s, data):
        h[own] = (h[own] ^ piece) * np.uint64(0xD6E8FEB86659FD93)
        h[own] ^= h[own] >> np.uint64(29)
    mask = (1 << int(2 * len(short) + 16).bit_length()) - 1
    slot, table = (h & np.uint64(mask)).astype(np.int64), np.full(mask + 1, -1, np.int64)
    todo = np.arange(len(short))
    while len(todo):
        free = todo[table[slot[todo]] < 0]
        table[slot[free]] = free
        holder = table[slot[todo]]
        first[short[todo[holder == todo]]] = True
        maybe = (h[holder] == h[todo]) & (size_s[holder] == size_s[todo]) & (text[short[holder]] == text[short[todo]]) & (holder != todo)
        a, b = todo[maybe], holder[maybe]
        equal = np.ones(len(a), bool)
        for (own, x), (_, y) in zip(_words_of(at_s[a], size_s[a], data), _words_of(at_s[b], size_s[a], data)):
            equal[own] &= x == y
        done = holder == todo
        done[np.flatnonzero(maybe)[equal]] = True
        todo = todo[~done]
        slot[todo] = (slot[todo] + 1) & mask
    seen = set()
    for i in np.flatnonzero(size > LONG_WORD):
        word = (int(text[i]), data[at[i] : at[i] + size[i]].tobytes())
        first[i] = word not in seen
        seen.add(word)
    return first


def _counted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Counts [text, (words, distinct words, capitals, code points, symbols)]; and the spans of the first words."""
    n, action = len(starts), transduce(data, starts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    begin = np.flatnonzero(action & _BEGIN)
    text = np.searchsorted(starts, begin, side="right") - 1
    stop = np.flatnonzero(action & _END)
    # a word ends at the first end after it, or with its text
    end = np.minimum(np.append(stop, len(data))[np.searchsorted(stop, begin)], ends[text])
    first = distinct_words(padded, text, begin, end - begin)
    out = np.zeros((n, 5), np.int64)
    out[:, 0], out[:, 1] = np.bincount(text, minlength=n), np.bincount(text[first], minlength=n)
    for column, flag in ((2, _UPPER), (3, _POINT), (4, _MARK)):
        sums = np.concatenate([[0], np.cumsum((action & flag) > 0, dtype=np.int64)])
        out[:, column] = sums[ends] - sums[starts]
    return out, begin[first], end[first]


def counts(data: np.ndarray, offsets: np.ndarray, group_bytes: int = GROUP_BYTES) -> np.ndarray:
    """Counts of texts that lie one after another in ``data``; a text longer than a group is read in pieces."""
    n, at = len(offsets) - 1, 0
    out = np.zeros((n, 5), np.int64)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + group_bytes, side="right")) - 1)
        low, high = offsets[at], offsets[to]
        if high - low <= 4 * group_bytes:
            out[at:to] = _counted(data[low:high], offsets[at:to] - low, offsets[at + 1 : to + 1] - low)[0]
        else:
            out[at] = _long(data[low:high], group_bytes)
        at = to
    return out


_GAPS = re.compile(rb"[ \t-\r]")


def _long(data: np.ndarray, piece: int) -> np.ndarray:
    whole, total, seen, at = data.tobytes(), np.zeros(5, np.int64), set(), 0
    while at < len(whole):
        cut = _GAPS.search(whole, at + piece)
        end = cut.end() if cut else len(whole)
        own, begin, stop = _counted(data[at:end], np.array([0]), np.array([end - at]))
        seen.update(whole[at + b : at + e] for b, e in zip(begin.tolist(), stop.tolist()))
        total += own[0]
        at = end
    total[1] = len(seen)
    return total


_COUNTS = StructType([StructField(c, LongType()) for c in ("words", "distinct_words", "capitals", "code_points", "symbols")])


@F.arrow_udf(_COUNTS)
def text_counts(texts: pa.Array) -> pa.Array:
    """A text's counts: words, distinct words, capitals, code points, symbols."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    found = counts(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(5)], names=_COUNTS.names)


def failed(c: Column) -> Column:
    """Bits of the filters A to D that a text with these counts fails."""
    fails = [
        c["words"] < LEAST_WORDS, 100 * c["distinct_words"] < DISTINCT_PERCENT * c["words"],
        100 * c["capitals"] > CAPITAL_PERCENT * c["code_points"], c["symbols"] > 0,
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of each part fail exactly the filters of ``mask``. Only digests and numbers
    are shuffled, and every shuffle is of sums made beforehand."""
    text = text_or_empty(docs["text"])
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_counts(text).alias("c"))
    rows = stored(rows.select("doc_id", "part", F.unhex("digest").alias("digest"), failed(F.col("c")).alias("mask")), "failed")
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    alike = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]
    known = alike.where("doc_id is not null").join(told, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", *marks)
    known = known.unionByName(alike.where("doc_id is null").select("doc_id", "part", "digest", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")))
    # of each text: how many rows of a part and label have the smallest id, how many others, how many no id
    lone = F.col("doc_id").isNull()
    kinds = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum(F.when(lone, F.col("n")).otherwise(0)).alias("no_id"), F.sum(F.when(lone, 0).otherwise(F.col("n"))).alias("with_id"),
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"),
    )
    of_all = F.min("least").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    several = kinds.withColumn("of_all", of_all).withColumn("stay", F.col("no_id") + F.when(F.col("least") == F.col("of_all"), F.col("at_least")).otherwise(0))
    split = several.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), F.col("stay").alias("n")),
        F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("no_id") + F.col("with_id") - F.col("stay")).alias("n")),
    )).alias("m"))
    return split.where("m.n > 0").groupBy("part", "m.mask").agg(
        F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("good")).alias("good"), F.sum(F.col("m.n") * F.col("toxic")).alias("toxic")
    )


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before) of every step of every order."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(order), i + 1, bit[f], sum(bit[g] for g in order[:i])) for order in permutations(FILTERS) for i, f in enumerate(order)]


def audit(counted: DataFrame) -> DataFrame:
    """Every part's numbers for every step of every order, from ``histogram``."""
    by_mask = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 a part
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before")) for o, s, b, p in _steps()])
    rows = by_mask.select("part", "m", F.explode(steps).alias("s")).select("part", "m", "s.*")
    fails, gone = lambda x: x["mask"].bitwiseAND(F.col("bit")) != 0, lambda x: x["mask"].bitwiseAND(F.col("before")) != 0
    total = lambda value, where: F.aggregate(F.filter("m", where), F.lit(0).cast("long"), lambda a, x: a + value(x))
    orders = F.lit(factorial(len(FILTERS)))
    here = lambda x: fails(x) & ~gone(x)
    n = lambda x: x["n"]
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda x: ~gone(x) & ~fails(x)).alias("kept"), total(n, here).alias("removed"), total(n, lambda x: fails(x) & gone(x)).alias("redundant"),
        total(n, lambda x: x["mask"] == F.col("bit")).alias("unique_fails"), total(lambda x: x["good"], here).alias("good_lost"),
        total(lambda x: x["toxic"], here).alias("toxic_lost"), total(lambda x: x["n"] * (orders / F.bit_count(x["mask"])).cast("long"), fails).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir):
    return audit(histogram(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


ORACLE = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
w as (select t.*, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first_id from t),
f as (select w.part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
             map {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
                  'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first_id, false)} as fails
      from w left join l on l.doc_id = w.doc_id),
c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
k(a) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o as (select p.a || q.a || r.a || s.a || t.a as filter_order from k p, k q, k r, k s, k t where len(list_distinct([p.a, q.a, r.a, s.a, t.a])) = 5),
s as (select filter_order, i as step, filter_order[i] as a, string_split(filter_order[:i - 1], '') as before from o, range(1, 6) x(i)),
b as (select c.*, s.*, fails[a] as fail, i_gone as gone from c, s, lateral (select coalesce(bool_or(fails[e]), false) as i_gone from (select unnest(before) as e) where e <> '')),
r as (select part, filter_order, step, a, sum(n) filter (not gone and not fail) as kept, sum(n) filter (fail and not gone) as removed, sum(n) filter (fail and gone) as redundant,
             sum(n) filter (fail and len(list_filter(map_values(fails), lambda v: v)) = 1) as unique_fails,
             sum(good) filter (fail and not gone) as good_lost, sum(toxic) filter (fail and not gone) as toxic_lost from b group by part, filter_order, step, a)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
       coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       coalesce(sum(removed) over (partition by part, a), 0)::bigint as shapley
from r
"""
