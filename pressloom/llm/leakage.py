"""Evaluation texts leaking into training text (problem 8).

Method: training suffix arrays. The corpus is read in shards. Of each shard's token stream a suffix
array is made: suffixes ordered by their first k tokens, where ranks of 1, 2, 4, 8, ... tokens come from
prefix doubling. Every suffix of every test item is then found by binary search, which gives all places
that agree with it on k tokens. The longest verbatim match of a document and an item is found on these
places by steps of halved length; its first place and the number of all places are told.
Suffixes that begin with a token, pair, four or eight tokens no test item has are left out of the
array as soon as that rank is known: they cannot match, and what is sorted stays small.

Tokens are words; for items in scripts without blanks they are characters. A document that has such
characters goes through both streams, whatever language it claims. Test items are sent to the tasks
in blocks of a bounded size; the corpus is never collected.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, CHARACTERS = 12, 20
#: Languages whose items are matched by characters.
BY_CHARACTER = ("zh", "ja")
#: Characters of corpus text per shard, and of test text per block sent to the tasks.
SHARD_CHARS, BLOCK_CHARS = 4_000_000, 20_000_000

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*>|<!--.*?-->", re.S)
# fixed values: elements that stand between words
_BLOCK_TAGS = frozenset("p br div li ul ol h1 h2 h3 h4 h5 h6 tr td th table hr section article blockquote pre figure".split())
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")


def plain(text: str) -> str:
    """Text without markup, invisible characters and differences of case and Unicode form."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " if (m.group(2) or "").lower() in _BLOCK_TAGS else "", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
        return unicodedata.normalize("NFKC", text.casefold())
    return text.lower()


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def characters(text: str) -> list[str]:
    return list("".join(_WORD.findall(text)))


@dataclass
class Queries:
    """Test items of one kind of token, with ranks by prefix doubling over their own suffixes."""

    vocab: dict[str, int]
    tables: list[np.ndarray]  # sorted pair keys of each doubling
    ranks: list[np.ndarray]  # ranks of 1, 2, 4, ... tokens at each position; -1 beyond an item's end
    item: np.ndarray
    offset: np.ndarray
    need: np.ndarray  # tokens that must agree, by item index
    ids: np.ndarray


def _double(rank: np.ndarray, step: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which both halves of twice the length are known, and their keys."""
    at = np.flatnonzero(rank[: max(len(rank) - step, 0)] >= 0)
    at = at[rank[at + step] >= 0]
    return at, rank[at] * base + rank[at + step]


def compile_items(items: list[tuple[int, list[str]]], least: int) -> Queries | None:
    """Ranks of all suffixes of ``items`` (id, tokens); items without a token are left out."""
    items = [(i, t) for i, t in items if t]
    if not items:
        return None
    vocab: dict[str, int] = {}
    stream, item, offset = [], [], []
    for k, (_, tokens) in enumerate(items):
        stream += [vocab.setdefault(t, len(vocab)) for t in tokens] + [-1]
        item += [k] * (len(tokens) + 1)
        offset += range(len(tokens) + 1)
    ranks, tables, step, base = [np.array(stream, np.int64)], [], 1, len(vocab)
    longest = max(len(t) for _, t in items)
    while step * 2 <= longest:
        at, key = _double(ranks[-1], step, base)
        tables.append(np.unique(key))
        new = np.full(len(stream), -1, np.int64)
        new[at] = np.searchsorted(tables[-1], key)
        ranks.append(new)
        step, base = step * 2, max(len(tables[-1]), 1)
    need = np.array([min(least, len(t)) for _, t in items])
    return Queries(vocab, tables, ranks, np.array(item), np.array(offset), need, np.array([i for i, _ in items], np.int64))


def _shard_ranks(q: Queries, stream: np.ndarray) -> list[np.ndarray]:
    """Ranks of a shard's suffixes among the items' ones; -1 where no item goes on like that."""
    ranks, step, base = [stream], 1, len(q.vocab)
    for table in q.tables:
        at, key = _double(ranks[-1], step, base)
        new = np.full(len(stream), -1, np.int64)
        if len(table) and len(at):
            found = np.minimum(np.searchsorted(table, key), len(table) - 1)
            known = table[found] == key
            new[at[known]] = found[known]
        ranks.append(new)
        step, base = step * 2, max(len(table), 1)
    return ranks


def _keys(q: Queries, ranks: list[np.ndarray], at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the positions have k tokens known to the items, and their keys of that depth.

    One rank of the greatest power of two within k, and where that is short of k the same rank once
    more, ending at k. Keys differ wherever the tokens do: the base is the number of ranks.
    """
    level = k.bit_length() - 1
    base = len(q.vocab) if level == 0 else max(len(q.tables[level - 1]), 1)
    rank, rest = ranks[level], k - (1 << level)
    kept = np.flatnonzero((at + rest < len(rank)) & (rank[at] >= 0))
    if rest:
        kept = kept[rank[at[kept] + rest] >= 0]
        return kept, rank[at[kept]] * base + rank[at[kept] + rest]
    return kept, rank[at[kept]]


def longest_matches(q: Queries, tokens: list[list[str]]) -> pd.DataFrame:
    """``doc, item, longest, at, places``: of each document (by index) and item the longest verbatim match.

    ``at`` is the document's token at which it starts (the first of equally long ones), ``places`` the
    number of the document's tokens at which a match of the length asked for starts. Repeats do not
    multiply: a document's places meet an item once, however often the item says the same.
    """
    none = pd.DataFrame({c: np.empty(0, np.int64) for c in ("doc", "item", "longest", "at", "places")})
    get = q.vocab.get
    sizes = np.array([len(t) for t in tokens])
    stream = np.full(int(sizes.sum()) + len(tokens), -1, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(tokens) else np.empty(0, np.int64)
    for s, t in zip(starts, tokens, strict=True):
        stream[s : s + len(t)] = np.fromiter((get(w, -1) for w in t), np.int64, len(t))
    ranks = _shard_ranks(q, stream)
    everywhere, own = np.arange(len(stream)), np.arange(len(q.item))
    found = []
    for k in np.unique(q.need).tolist():
        kept, key = _keys(q, ranks, everywhere, k)
        if not len(kept):
            continue
        order = np.argsort(key, kind="stable")  # the shard's suffix array to depth k
        array, place = key[order], kept[order]
        mine = own[q.need[q.item] == k]
        asked, want = _keys(q, q.ranks, mine, k)
        asked = q.item[mine[asked]]
        want, asked = np.unique(np.stack([want, asked]), axis=1)  # what an item says twice is asked once
        lo, hi = np.searchsorted(array, want, "left"), np.searchsorted(array, want, "right")
        many = hi - lo
        if many.sum():
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append((place[np.repeat(lo, many) + inside], np.repeat(asked, many), np.full(many.sum(), k)))
    if not found:
        return none
    pos, item, length = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = np.searchsorted(starts, pos, "right") - 1
    pair, which = np.unique(doc * len(q.ids) + item, return_inverse=True)
    places = np.bincount(which)
    # the places of each pair go on as far as any of them agrees: lengths by halving steps
    best = np.zeros(len(pair), np.int64)
    best[which] = length
    step = 1 << (len(q.tables))
    while step:
        grown = best + step
        reach = np.zeros(len(pair), bool)
        for k in np.unique(grown).tolist():
            if k.bit_length() - 1 >= len(ranks):
                continue
            try_ = np.flatnonzero(grown[which] == k)
            kept, key = _keys(q, ranks, pos[try_], k)
            try_ = try_[kept]
            if not len(try_):
                continue
            theirs, want = _keys(q, q.ranks, own, k)
            table = np.unique(want)
            said = np.unique(np.searchsorted(table, want) * len(q.ids) + q.item[own[theirs]])
            at = np.searchsorted(table, key)
            known = (at < len(table)) & (table[np.minimum(at, max(len(table) - 1, 0))] == key) if len(table) else np.zeros(len(key), bool)
            hit = known & np.isin(at * len(q.ids) + item[try_], said)
            reach[which[try_[hit]]] = True
        best = np.where(reach, grown, best)
        step //= 2
    # the first place of that length
    first = np.full(len(pair), np.iinfo(np.int64).max)
    for k in np.unique(best).tolist():
        try_ = np.flatnonzero(best[which] == k)
        kept, key = _keys(q, ranks, pos[try_], k)
        try_ = try_[kept]
        theirs, want = _keys(q, q.ranks, own, k)
        table = np.unique(want)
        said = np.unique(np.searchsorted(table, want) * len(q.ids) + q.item[own[theirs]])
        at = np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))
        hit = (table[at] == key) & np.isin(at * len(q.ids) + item[try_], said)
        np.minimum.at(first, which[try_[hit]], pos[try_[hit]])
    d = pair // len(q.ids)
    return pd.DataFrame({"doc": d, "item": q.ids[pair % len(q.ids)], "longest": best, "at": first - starts[d], "places": places})


def _scan(shared):  # noqa: ANN001
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_word, by_char = shared.value
        ids: list[int] = []
        texts: list[str] = []
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            if by_word is not None:
                m = longest_matches(by_word, [words(t) for t in texts])
                yield pd.DataFrame({"doc_id": np.array(ids, np.int64)[m["doc"].to_numpy(np.int64)], "item_id": m["item"], "longest": m["longest"], "at": m["at"], "places": m["places"]})
            if by_char is not None and (cjk := [i for i, t in enumerate(texts) if _CJK.search(t)]):
                m = longest_matches(by_char, [characters(texts[i]) for i in cjk])
                yield pd.DataFrame({"doc_id": np.array(ids, np.int64)[np.array(cjk)[m["doc"].to_numpy(np.int64)]], "item_id": m["item"], "longest": m["longest"], "at": m["at"], "places": m["places"]})

        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                ids.append(i)
                texts.append(plain(t))
                size += len(t)
                if size >= SHARD_CHARS:
                    yield from flush()
                    ids, texts, size = [], [], 0
        if texts:
            yield from flush()

    return run


def leaks(spark: SparkSession, docs: DataFrame, did: str, text: str, items: DataFrame, iid: str, item_text: str, item_lang: str) -> DataFrame:
    """``doc_id, item_id, longest, at, places``: documents that hold an item, fully or partly.

    A document holds an item if at least ``WORDS`` consecutive words of it (``CHARACTERS`` characters
    in languages of ``BY_CHARACTER``), or all of a shorter one, stand in it. Repeated rows count once,
    null ids and null texts hold nothing, items without a word match nothing. Empty tables give no
    rows. Test items come to the driver in blocks of at most ``BLOCK_CHARS`` characters.
    """
    told = items.filter(F.col(iid).isNotNull() & F.col(item_text).isNotNull()).select(F.col(iid).cast("long").alias("i"), F.col(item_lang).alias("l"), F.col(item_text).alias("t")).distinct()
    corpus = docs.filter(F.col(did).isNotNull() & F.col(text).isNotNull()).select(F.col(did).cast("long").alias("id"), F.col(text).alias("text"))
    out, block, size = None, [], 0

    def scan(rows: list) -> DataFrame:  # noqa: ANN001
        split: dict[bool, list[tuple[int, list[str]]]] = {False: [], True: []}
        for r in rows:
            by_char = (r["l"] or "").lower().split("-")[0] in BY_CHARACTER
            text_ = plain(r["t"])
            split[by_char].append((r["i"], characters(text_) if by_char else words(text_)))
        shared = spark.sparkContext.broadcast((compile_items(split[False], WORDS), compile_items(split[True], CHARACTERS)))
        return corpus.mapInPandas(_scan(shared), "doc_id long, item_id long, longest long, at long, places long")

    for r in told.toLocalIterator():
        block.append(r)
        size += len(r["t"])
        if size >= BLOCK_CHARS:
            part = scan(block)
            out, block, size = part if out is None else out.union(part), [], 0
    if block or out is None:
        part = scan(block)
        out = part if out is None else out.union(part)
    best = F.max(F.struct("longest", (-F.col("at")).alias("at")))
    found = out.groupBy("doc_id", "item_id").agg(best.alias("b"), F.max("places").alias("places"))
    return found.select("doc_id", "item_id", F.col("b.longest").alias("longest"), (-F.col("b.at")).alias("at"), "places")


def without_leaks(docs: DataFrame, did: str, found: DataFrame) -> DataFrame:
    """The corpus without the documents that hold an item."""
    return docs.join(found.select(F.col("doc_id").alias("_leak")).distinct(), F.col(did) == F.col("_leak"), "left_anti")
