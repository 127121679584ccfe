"""Phrase collocations against plain counting, and the automata that hold the counts."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline import session
from ledgerline.llm import bloom, collocations
from ledgerline.llm.count_automata import Automaton, build, union

keys = st.lists(st.sampled_from([b"a", b"b", b"cc", b"\xc3\xa9"]), max_size=4).map(tuple)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(keys, st.integers(0, 2**62), max_size=25), max_size=4), st.integers(0, 5))
def test_automata(shards, least):
    automata = [build(sorted(shard.items())) for shard in shards]
    for shard, automaton in zip(shards, automata):
        again = Automaton.from_bytes(automaton.to_bytes())
        assert list(again.items()) == list(automaton.items()) == sorted(shard.items())
    total: Counter = Counter()
    for shard in shards:
        total.update(shard)
    wanted = sorted((key, count) for key, count in total.items() if count >= least)
    united = union(automata, least)
    assert list(united.items()) == wanted
    asked = sorted(set(list(total)[::2]) | {(b"zz",), (b"a", b"zz")})
    found = dict(united.compose(build((key, 0) for key in asked)))
    assert found == {key: count for key, count in wanted if key in set(asked)}


def test_endings_are_shared():
    """A thousand phrases of the same shape need as many arcs at the root and one state at the end."""
    one = build(sorted(((str(i).encode(), b"of", b"the"), 7) for i in range(1000)))
    assert len(one.states) == 4


def brute(rows, least, contained, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    dropped = {
        (lang, p[i : i + m]) for (lang, p), (_, a, *_) in out.items() for m in range(2, len(p))
        for i in range(len(p) - m + 1) if 100 * a >= contained * out[lang, p[i : i + m]][1]
    }
    result = set()
    for lang in {lang for lang, _ in out}:
        kept = [(-s, -a, " ".join(p).encode(), l, r) for (g, p), (s, a, l, r) in out.items() if g == lang and (g, p) not in dropped]
        for rank, (s, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            result.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -s))
    return result


def invented(count: int, seed: int) -> list[tuple]:
    source = random.Random(seed)
    words = ["the", "Of", "é", "to\x00", "red fox ran home", "red fox", "\t a", "x. y", "new york", "b!", "日本", "ß﻿"]
    rows = [
        (" ".join(source.choice(words) for _ in range(source.randint(0, 60))), source.choice(["en", "de", None, "und", ""]))
        for _ in range(count)
    ]
    return rows + rows[:5] + [(None, "en"), ("", None), (" \t\n", "de")]


@pytest.mark.parametrize("small", [False, True])
def test_matches_plain_counting(spark, monkeypatch, small):
    """Whole chunks and one range; tiny chunks that cut texts, many flushes and ranges, a Bloom filter that says yes too often."""
    if small:
        for name, value in (("CHUNK", 90), ("HELD_HASHES", 50), ("HELD_PHRASES", 40), ("RANGE", 15)):
            monkeypatch.setattr(collocations, name, value)
        monkeypatch.setattr(bloom, "MAX_BITS", 1 << 9)
    rows = invented(250, 5)
    docs = spark.createDataFrame([(i, t, g, "x") for i, (t, g) in enumerate(rows)], "doc_id int, text string, lang string, phrase string")
    for least, contained, top in ((5, 80, 2000), (12, 55, 7)):
        out = collocations.collocations(docs.repartition(4), least, contained, top).collect()
        wanted = brute(rows, least, contained, top)
        assert len(wanted) > 20 and {tuple(r) for r in out} == wanted


def test_long_texts_are_cut_without_loss(monkeypatch):
    source = random.Random(2)
    text = " ".join(source.choice(["aa", "b", "cc.", "d" * 200, "e\n"]) for _ in range(400))

    def grams():
        out = Counter()
        for chunk in collocations.chunks(pd.DataFrame({"text": [text, "aa b"], "lang": ["en", None]})):
            for m, _, counted in chunk.keys():
                out.update(chunk.phrase(i, m) for i in counted.nonzero()[0])
        return out

    whole = grams()
    for size in (1, 7, 64, 300):
        monkeypatch.setattr(collocations, "CHUNK", size)
        assert grams() == whole


def test_empty_and_rare(spark):
    none = spark.createDataFrame([], "doc_id int, text string, lang string")
    assert collocations.collocations(none).count() == 0
    rare = spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], "doc_id int, text string, lang string")
    assert collocations.collocations(rare).count() == 0
    hot = spark.createDataFrame([(1, "a a " * 4000, "en")], "doc_id int, text string, lang string")
    assert {tuple(r) for r in collocations.collocations(hot, top=1).collect()} == brute([("a a " * 4000, "en")], 30, 80, 1)


def admits(every: bool) -> SimpleNamespace:
    return SimpleNamespace(has=lambda keys: np.full(len(keys), every))


def test_phrases_of_rare_words_are_not_held(monkeypatch):
    monkeypatch.setattr(collocations, "read_bloom", lambda given: given)
    batch = pd.DataFrame({"text": ["a b a b"], "lang": ["x"]})
    assert not list(collocations._counted(iter([batch]), [admits(False), admits(True)]))
    ((*items,),) = collocations._counted(iter([batch]), [admits(True), admits(True)])
    assert [n for _, n in items] == [2, 2, 2, 1]  # a, a b, b, b a


def test_repeated_text_takes_no_more_memory(monkeypatch):
    """A task holds each phrase and its count once, however often it is read."""
    monkeypatch.setattr(collocations, "read_bloom", lambda given: given)
    batch = pd.DataFrame({"text": [" ".join(f"w{i}" for i in range(10_000))], "lang": ["x"]})
    tracemalloc.start()
    ((*items,),) = collocations._counted((batch for _ in range(40)), [admits(True)] * 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(items) == 39_994 and {n for _, n in items} == {40}
    assert peak < 20 << 20


def peak_of(run) -> int:
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_hashes_are_counted_where_they_are_held():
    """A task holds no second copy of the hashes that it counts, and counts all of them."""
    run = collocations._count_hashes(SimpleNamespace(mapInPandas=lambda run, schema: run), (1,), None)
    batches = [pd.DataFrame({"text": [" ".join(f"{i}" for i in range(at, at + 50_000))], "lang": ["x"]}) for at in range(0, 2_000_000, 50_000)]
    seen = []
    assert peak_of(lambda: seen.extend(int(f["n"].sum()) for f in run(iter(batches)))) < 32 << 20
    assert sum(seen) == 2 * 2_000_000  # by hash and by lang


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=30), max_size=6), st.integers(1, 20), st.integers(1, 5))
def test_held_hashes(parts, room, handed):
    before, collocations.HANDED = collocations.HANDED, handed
    try:
        held, total = collocations.Held(room), Counter()
        given = [np.array(part, dtype=np.uint64) for part in parts]
        for keys, n in [x for part in given for x in held.add(part)] + list(held.counts()):
            assert len(set(keys.tolist())) == len(keys)
            total.update(dict(zip(keys.tolist(), n.tolist())))
    finally:
        collocations.HANDED = before
    assert total == Counter(key for part in parts for key in part)


def test_one_automaton_is_unpacked_at_a_time():
    phrases = sorted((b"78", str(i).encode(), b"of") for i in range(3000))
    blob = build((key, 1) for key in phrases).to_bytes()
    united = []

    def unite(count):
        united.append(collocations._united(pd.DataFrame({"range": 3, "automaton": [blob] * count}), count))

    assert peak_of(lambda: unite(60)) < 1.5 * peak_of(lambda: unite(2))
    (place, found), = united[0].itertuples(index=False)
    assert place == 3 and list(Automaton.from_bytes(found).items()) == [(key, 60) for key in phrases]


def test_texts_go_in_small_batches(spark, monkeypatch):
    """While texts are read few rows are decoded at once; the session's own setting comes back."""
    seen, before = [], spark.conf.get(session.DECODED)
    count = collocations._count_hashes
    monkeypatch.setattr(collocations, "_count_hashes", lambda *a: seen.append(int(spark.conf.get(session.DECODED))) or count(*a))
    collocations.collocations(spark.createDataFrame([(1, "a b", "en")], "doc_id int, text string, lang string"))
    assert seen and max(seen) <= collocations.DECODED and spark.conf.get(session.DECODED) == before
