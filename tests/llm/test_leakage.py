import random
import time

import numpy as np

from pressloom.llm import leakage as L

DOCS = "doc_id long, text string, id long, t string"
ITEMS = "item_id long, text string, lang string, i long"


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    return {(r["doc_id"], r["item_id"]): (r["longest"], r["at"]) for r in L.leaks(spark, d, "doc_id", "text", i, "item_id", "text", "lang").collect()}


def brute(docs, items):
    out = {}
    for d, text in docs:
        if d is None or text is None:
            continue
        for i, t, lang in items:
            if i is None or t is None:
                continue
            split, least = (L.characters, L.CHARACTERS) if (lang or "")[:2] in ("zh", "ja") else (L.words, L.WORDS)
            a, b = split(L.plain(t)), split(L.plain(text))
            need = min(least, len(a))
            best = None
            if split is L.characters and not L._CJK.search(L.plain(text)):
                continue
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if n and n >= need and (best is None or (n, -y) > (best[0], -best[1])):
                        best = (n, y)
            if best and need:
                out[(d, i)] = best
    return out


def test_longest_matches_equal_brute_force(spark):
    rng = random.Random(14)
    vocab = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([5, 11, 12, 13, 30, 40]))), "en") for k in range(12)]
    docs = []
    for k in range(60):
        text = rng.choices(vocab, k=rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            text += w[a : a + rng.randrange(8, 30)] + rng.choices(vocab, k=4)
        docs.append((k, " ".join(text)))
    want = brute(docs, items)
    assert len(want) > 10
    assert run(spark, docs, items) == want


def test_form_does_not_matter(spark):
    item = "Although the portrait seemed sparse, 23 members of the café commission closed it and wrote that nobody came"
    messy = "X. ALTHOUGH the por\xadtrait <em>seemed</em>\nsparse 23 mem​bers — of “the café commission” closed it; and wrote that nobody&nbsp;came later"
    assert run(spark, [(1, messy), (2, item[: len(item) // 3])], [(7, item, "en")]) == {(1, 7): (18, 1)}


def test_scripts_without_blanks(spark):
    zh = "当谷桥桥把北东镇的港口与边境全部要求之后，北谷泽联盟仍在奇怪的税收旁边清点了三十六座港口"
    docs = [(1, "前言。" + zh[5:30].replace("，", "\n") + "结束"), (2, zh[:15]), (3, "english only text"), (4, zh)]
    got = run(spark, docs, [(1, zh, "zh")])
    assert set(got) == {(1, 1), (4, 1)}
    assert got == brute(docs, [(1, zh, "zh")])


def test_short_items_nulls_repeats_long_texts_and_empty(spark):
    items = [(1, "name the fine", "en"), (2, None, "en"), (3, "...", None), (None, "name", "en"), (1, "name the fine", "en")]
    docs = [(1, "please name the fine now"), (1, "please name the fine now"), (2, None), (None, "name the fine"), (3, ""), (4, "filler " * 200_000 + "Name the Fine."), (5, "name the")]
    assert set(run(spark, docs, items)) == {(1, 1), (4, 1)}
    assert run(spark, docs, [(2, None, "en")]) == {}
    assert run(spark, [(2, None)], items) == {}


def test_shards_and_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(15)
    vocab = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(vocab, k=14)), "en") for k in range(5)]
    docs = [(k, " ".join(rng.choices(vocab, k=10)) + " " + rng.choice(items)[1]) for k in range(20)]
    whole = run(spark, docs, items)
    monkeypatch.setattr(L, "BLOCK_CHARS", 60)
    assert run(spark, docs, items) == whole


def test_documents_without_leaks(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    f = spark.createDataFrame([(1, 5)], "doc_id long, item_id long")
    assert [r["doc_id"] for r in L.without_leaks(d, "doc_id", f).collect()] == [2]


def test_repeats_do_not_multiply():
    q = L.compile_items([(1, ["x"] * 3000), (2, ["x", "y"] * 1500)], L.WORDS)
    began = time.perf_counter()
    got = L.longest_matches(q, [["x"] * 2000, ["y", "x"] * 4000 + ["z"]])
    assert time.perf_counter() - began < 5
    assert {tuple(r) for r in got[["doc", "item", "longest", "at", "places"]].to_numpy().tolist()} == {(0, 1, 2000, 0, 1989), (1, 2, 3000, 1, 7989)}


def test_keys_stay_apart_at_any_number_of_ranks():
    """Two ranks of a key are told apart whatever the number of different windows."""
    tokens = [str(k) for k in range(5000)]
    q = L.compile_items([(1, tokens)], L.WORDS)
    kept, key = L._keys(q, q.ranks, np.arange(len(q.item)), 12)
    assert len(np.unique(key)) == len(kept) == 5000 - 11
