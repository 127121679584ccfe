"""The training-data operators against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import io
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline import session
from ledgerline.llm import (
    best_fit,
    cap_filters,
    entropy_mix,
    learned_partitions,
    lsh_forest,
    naive_bayes,
    pii,
    rule_ensemble,
    table_boosting,
    transcripts,
    trees,
    warc,
    words,
)

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "score double, kept string, size string, id string, `stat_chars` int, copy string, row string, `key` string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], DOC)


def awkward(spark):
    """Null in every column, empty and blank texts, a long one, repeated rows and equal texts."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, "b"), (4, "one", "en", None),
        (5, "one", "en", "a"), (5, "one", "en", "a"), (None, "one", "en", "a"), (6, long, "en", "a"), (7, long + " end", "de", "b"),
        (8, "üä \U0001f600 z\u0000z a+b@c.de 4111 1111 1111 1111", "de", "b"), (8, "other text of the same id", "de", "b"),
    ]
    docs = docs_of(spark, rows)
    return docs.select("*", *[F.lit(None).cast("string").alias(c.split()[0].strip("`")) for c in CLASH.split(", ")])


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} or ({tuple(found)} if found else set())


def near_corpus(count=160, seed=3):
    draw = random.Random(seed)
    texts = []
    for _ in range(count):
        if texts and draw.random() < 0.7:
            own = draw.choice(texts).split(" ")
            for _ in range(draw.randint(0, 6)):
                own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(f"W{draw.randrange(4000)}" for _ in range(draw.randint(30, 120))))
    return texts


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent, monkeypatch):
    texts = near_corpus()
    docs = docs_of(spark, [(i * 3, t, "en", "s") for i, t in enumerate(texts)])
    sets = [shingles(t, k) for t in texts]
    links = [
        (3 * i, 3 * j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    want = brute_components([3 * i for i in range(len(texts))], links)
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(docs, k, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {3 * i: len(s) for i, s in enumerate(sets)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_large_regions_are_split_and_joined_again(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "WIDTH", 12)
    monkeypatch.setattr(lsh_forest, "CENTRAL", 4)
    base, draw, rows = [f"b{i}" for i in range(300)], random.Random(1), []
    for i in range(120):
        own = list(base)
        own[draw.randrange(300)] = f"y{i}"
        rows.append((i, " ".join(own), "en", "s"))
    found = lsh_forest.near_duplicates(docs_of(spark, rows), 3, 85).collect()
    assert {r.component_id for r in found} == {0}


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_through_large_regions_equal_brute_force(spark, monkeypatch, seed):
    """Members link to their neighbours in a chain alone, far from any center of their regions."""
    monkeypatch.setattr(lsh_forest, "WIDTH", 4)
    monkeypatch.setattr(lsh_forest, "CENTRAL", 1)
    draw, rows = random.Random(seed), []
    own = [f"b{i}" for i in range(300)]
    for i in range(70):
        for _ in range(draw.choice((5, 6, 6, 9))):
            own[draw.randrange(300)] = f"y{draw.randrange(10**6)}"
        rows.append((i, " ".join(own), "en", "s"))
    draw.shuffle(rows)
    sets = {i: shingles(t, 3) for i, t, *_ in rows}
    links = [(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = brute_components(list(sets), links)
    assert len(set(want.values())) > 1
    found = lsh_forest.near_duplicates(docs_of(spark, rows), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_near_duplicates_of_awkward_rows(spark):
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(awkward(spark), 3, 85).collect()]
    assert len(found) == 12
    assert found.count((5, 1, 4, False)) == 2 and (4, 1, 4, True) in found
    assert (2, 0, 2, True) in found and (3, 0, 3, True) in found and (7, 978, 6, False) in found
    assert (None, 1, None, True) in found and (None, 0, None, True) in found
    none = docs_of(spark, [])
    assert lsh_forest.near_duplicates(none).count() == 0 and lsh_forest.keep_first(none).count() == 0
    with pytest.raises(ValueError, match="surely"):
        lsh_forest.near_duplicates(none, 3, 60)


def test_pipeline_keeps_unrelated_rows_of_one_id(spark):
    """One of each group stays, whatever doc_id its rows share; a third of the rows share one."""
    texts = near_corpus(120, seed=5)
    rows = [(500 if i % 3 == 0 else i % 50, t) for i, t in enumerate(texts)]
    rows += [(500, texts[0].upper()), (500, texts[1]), (500, " "), (500, None), (500, ""), (None, texts[0])]
    sets = [shingles(t, 5) for _, t in rows]
    grouped = [i for i, (doc_id, _) in enumerate(rows) if sets[i] and doc_id is not None]
    links = [(i, j) for i in grouped for j in grouped if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = brute_components(grouped, links)
    least = {}
    for i in grouped:
        least[group[i]] = min(least.get(group[i], 10**9), rows[i][0])
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert all(r in rows for r in kept)
    assert sum(r[0] is None for r in kept) == 1
    assert sum(r[0] == 500 and not (r[1] or "").strip() for r in kept) == 3
    found = [(group[min(i for i in grouped if rows[i] == r)], r[0]) for r in kept if r[0] is not None and (r[1] or "").strip()]
    assert sorted(found) == sorted(least.items())


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = near_corpus(20) + ["", None, "  a ", "A"]
    whole = [h.tolist() for h in words.word_hashes(texts)]
    monkeypatch.setattr(words, "PIECE", 64)
    assert [h.tolist() for h in words.word_hashes(texts)] == whole
    assert whole[-1] == whole[-2] and whole[-3] == whole[-4] == []


def vectors_of(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "WIDTH", 16)
    draw = np.random.default_rng(0)
    x = draw.standard_normal((60, 24))
    near = [x[i % 10] * draw.uniform(0.5, 2) + draw.standard_normal(24) * s for i, s in enumerate(np.linspace(0.05, 0.6, 140))]
    x = np.concatenate([x, near, x[:5]]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    want = brute_components(range(len(x)), zip(*np.nonzero(linked)))
    got = {r.vec_id: r for r in cap_filters.near_vectors(vectors_of(spark, x)).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: int(n) for i, n in enumerate(linked.sum(axis=1))}
    assert {i: r.component_id for i, r in got.items()} == want


def test_no_pair_is_missed_with_the_codebook_of_a_large_table(spark, monkeypatch):
    """2,000 pairs just above the threshold, with the thin caps that 100 million rows get."""
    words = cap_filters.code_size(100_000_000)
    monkeypatch.setattr(cap_filters, "code_size", lambda rows: words)
    draw = np.random.default_rng(11)
    x, z = draw.standard_normal((2000, 64)), draw.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9001 * x + np.sqrt(1 - 0.9001**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    rows = vectors_of(spark, np.concatenate([x, y]).astype(np.float32))
    found = {r.vec_id: r.component_id for r in cap_filters.near_vectors(rows).collect()}
    assert [i for i in range(2000) if found[2000 + i] != i] == []


def test_codes_grow_with_the_codebook():
    counts = [cap_filters.code_count(64, cap_filters.code_size(n), 0.9) for n in (20_000, 500_000, 5_000_000, 50_000_000)]
    assert counts[0] == cap_filters.CODES and counts == sorted(counts) and counts[-1] > counts[0]


ODD = [
    (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
    (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (50, [2.0, 4.1]), (100, [5.0]),
]


def test_vectors_that_take_no_part(spark):
    rows = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("x", F.lit(1))
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in cap_filters.near_vectors(rows).collect())
    assert got == sorted(
        [(str(i), 0, str(i), True) for i in (1, 2, 3, 4, 5, 6, 9, 100)] + [("None", 0, "None", True)]
        + [("7", 3, "7", True), ("8", 3, "7", False), ("8", 3, "7", False), ("50", 3, "7", False)]
    )
    assert cap_filters.near_vectors(rows.limit(0)).count() == 0
    found = learned_partitions.nearest(rows, lambda i: i % 50 == 0, k=5).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found)] == [(50, 1, 7), (50, 2, 8)]
    assert learned_partitions.nearest(rows.limit(0), lambda i: i % 50 == 0).count() == 0


def test_nearest_recall_and_exact_scores(spark):
    x = np.random.default_rng(4).standard_normal((1500, 16)).astype(np.float32)
    x[700:710] = x[0]
    found = learned_partitions.nearest(vectors_of(spark, x), lambda i: i % 20 == 0, k=5).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 20):
        own = found[found.query_id == q].sort_values("rank")
        score = u @ u[q]
        score[q] = -2
        best = sorted(range(1500), key=lambda i: (-round(score[i], 12), i))[:5]
        hits += len(set(best) & set(own.vec_id))
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        np.testing.assert_allclose(own.score, score[own.vec_id], atol=1e-12)
    assert hits >= 0.9 * 5 * 75
    assert found[found.query_id == 0].sort_values("rank").vec_id.tolist() == [700, 701, 702, 703, 704]


def test_balanced_cut_is_balanced():
    x = np.random.default_rng(2).standard_normal((320, 8))
    part = learned_partitions.balanced_cut(x, learned_partitions.neighbour_lists(x, x, 5, own=True), 8)
    assert np.bincount(part).tolist() == [40] * 8


def quality_corpus(spark):
    draw, rows, labels = random.Random(9), [], []
    for i in range(400):
        good = i % 3 != 0
        own = [f"wo{draw.randrange(900)}rd" for _ in range(draw.randint(20, 80))]
        rows.append((i, (" " if good else "$$$ ").join(own) + ".", "en", "s"))
        labels.append((i, int(good), 0))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_separate_and_compile_to_the_same_score(spark):
    docs, labels = quality_corpus(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = rule_ensemble.quality(docs, labels, held).join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality)[got.held_out].mean() >= 0.98
    rules = rule_ensemble.learn_quality(docs, labels, ~held)
    rows, names = rule_ensemble.with_features(docs)
    frame = rows.select("doc_id", *names).toPandas().merge(got[["doc_id", "score"]], on="doc_id")
    np.testing.assert_allclose(rules.chances(frame[names].to_numpy(dtype=float)), frame.score, atol=1e-9)
    assert 0 < len(rules.weighted) < 60


def test_quality_of_awkward_rows(spark):
    docs, labels = quality_corpus(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema))
    for known in (odd, odd.limit(0)):
        got = rule_ensemble.quality(awkward(spark), known, held).collect()
        assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    kept = rule_ensemble.keep_good(awkward(spark), odd, held)
    assert kept.columns == awkward(spark).columns and kept.count() <= 12
    assert rule_ensemble.quality(docs.limit(0), labels, held).count() == 0


def test_lasso_drops_what_says_nothing():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 2, (2000, 12)).astype(float)
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    _, w = rule_ensemble.lasso_logistic(x, y, 0.02)
    assert (np.abs(w[:2]) > 0.3).all() and (np.abs(w[2:]) < 0.05).all()


def test_trees_fit_a_product():
    draw = np.random.default_rng(1)
    x = draw.uniform(-1, 1, (1500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = trees.boost(x, y, 60, depth=3)
    assert ((model.chances(x) > 0.5) == y).mean() > 0.95
    for tree in model.trees[:5]:
        assert all(1 <= len(p) <= 3 for p in tree.paths())


def language_corpus(spark):
    draw, rows = random.Random(5), []
    parts = {"aa": ["tion", "the", "ing"], "bb": ["sch", "ung", "ür"], "cc": ["eau", "é", "que"]}
    for i in range(300):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(draw.choices(parts[lang], k=3)) for _ in range(draw.randint(3, 30))), lang, "s"))
    return docs_of(spark, rows)


def test_language_on_held_out_rows(spark):
    docs = language_corpus(spark)
    got = naive_bayes.identify(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 1).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang)[got.held_out].mean() >= 0.99
    assert got.score.between(0, 1).all() and got.held_out.sum() > 50


def test_a_rare_language_is_learned_from_a_small_sample(spark):
    rows = [(i, f"the house and the garden number {i}", "en", "s") for i in range(3000)]
    rows += [(5000 + i, "quux zyzzy plugh xyzzy", "qx", "s") for i in range(2)]
    names, prior, _ = naive_bayes.fit(docs_of(spark, rows), F.lit(True), sample_rows=60)
    assert names == ["en", "qx"]
    np.testing.assert_allclose(np.exp(prior), [3000 / 3002, 2 / 3002])
    assert naive_bayes.quota([9000, 2, 5000], 12_000) == 6998 and naive_bayes.quota([5, 7], 12_000) >= 7


def test_language_score_is_the_sum_over_ngrams():
    draw = np.random.default_rng(0)
    matrix = draw.standard_normal((256, 2))
    text = "Abé \U0001f600cd" * 5
    codes = [ord(c) for c in text.lower()]
    total = np.zeros(2)
    for order in naive_bayes.ORDERS:
        for i in range(len(codes) - order + 1):
            gram = np.array(codes[i : i + order], dtype=np.uint32)
            total += matrix[naive_bayes.grams(gram, 256)[order - 1][0]]
    np.testing.assert_allclose(naive_bayes.text_scores(text, matrix), total)


def test_language_of_awkward_rows(spark):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = naive_bayes.identify(awkward(spark), held).collect()
    assert len(got) == 12 and {r.lang_pred for r in got} <= {"und", "en", "de"}
    blank = naive_bayes.identify(docs_of(spark, [(1, "12 34", "en", "s"), (2, "abc", None, "s"), (3, None, "en", "s")]), F.lit(True))
    assert {(r.doc_id, r.lang_pred, r.score) for r in blank.collect()} == {(1, "und", 1.0), (2, "und", 0.0), (3, "und", 1.0)}
    assert naive_bayes.identify(docs_of(spark, []), held).count() == 0


def test_gzip_normaliser_round_trip():
    payloads = [b"", b"a\r\n\r\nb" * 50, bytes(range(256)) * 3000]
    plain = [warc.record(i, f"http://x/{i} <", p, warc.base32_sha1(p), None, "s") for i, p in enumerate(payloads)]
    plain.append(warc.record(9, None, payloads[1], warc.base32_sha1(payloads[1]), 1, "s"))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    one = packer.compress(b"".join(plain)) + packer.flush()
    out = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(one), out))
    members = [zlib.decompress(out.getvalue()[at : at + n], 31) for at, n, _ in index]
    assert members == plain and b"".join(warc.inflate(io.BytesIO(out.getvalue()))) == b"".join(plain)
    parsed = [warc.parse_record(m) for m in members]
    assert [(n, d) for _, n, d in parsed[:3]] == [(len(p), warc.base32_sha1(p)) for p in payloads]
    assert parsed[3][0]["warc-type"] == "revisit" and parsed[3][1:] == parsed[1][1:]
    with pytest.raises(Exception):
        list(warc.normalise(io.BytesIO(one[: len(one) // 2]), io.BytesIO()))
    many = out.getvalue()
    for cut in (index[2][0] - 1, len(many) - 8, len(many) - 1, index[1][0] + 5):
        with pytest.raises(EOFError, match="cut off"):
            list(warc.normalise(io.BytesIO(many[:cut]), io.BytesIO()))
    assert len(list(warc.normalise(io.BytesIO(many[: index[2][0]]), io.BytesIO()))) == 2  # whole members alone
    assert list(warc.normalise(io.BytesIO(b""), io.BytesIO())) == []
    assert b"".join(warc.inflate(io.BytesIO(zlib.compress(b"z" * 3_000_000, wbits=31)))) == b"z" * 3_000_000


def test_spark_paths():
    assert warc.filesystem("dbfs:/a/b")[1] == "/dbfs/a/b" and warc.filesystem("file:/a/b")[1] == "/a/b"


def test_letters():
    for text in ("12 \u00b3", "\u00bd\u2460\u2167", "_", "", None, "\u0301", "3.5%"):
        assert not naive_bayes.has_letter(text)
    for text in ("a", "\u00e9", "1\u00b3x", "\u65e5", "x_1"):
        assert naive_bayes.has_letter(text)


def test_models_travel_without_the_package():
    """What is broadcast holds its classes: a worker that lacks the package can load it."""
    from pyspark import cloudpickle

    for value in (pii.Chooser(None, {"email": 1.0}), transcripts.model_of(pd.DataFrame(columns=["kind", "a", "b", "n"]))):
        raw = cloudpickle.dumps(value)
        code = "import sys, pickle; from pyspark import cloudpickle; x = cloudpickle.loads(sys.stdin.buffer.read()); print(type(x).__name__, 'ledgerline' in sys.modules)"
        out = subprocess.run([sys.executable, "-c", code], input=raw, capture_output=True, cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert out.stdout.split() == [type(value).__name__.encode(), b"False"], out.stderr.decode()


def test_archives_of_awkward_pages(spark):
    rows = [(3, "http://a b", "x"), (1, None, "x"), (1, None, "x"), (None, "u\r\nv", "x"), (None, "", "only"), (5, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\n" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hash", F.lit("clash")).withColumn("first", F.lit(0))
    got = warc.archive_pages(pages).collect()
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        least = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        same = least is None or least == page
        want.append((str(page), len(payload), warc.base32_sha1(payload), "response" if same else "revisit", None if same else least))
    rows_back = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(rows_back, key=str) == sorted(want, key=str)
    large = warc.archive_pages(pages, min_bytes=100).collect()
    assert {r.record_type for r in large} == {"response"}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_best_fit_equals_a_plain_search():
    draw = random.Random(8)
    packer, bins = best_fit.Packer(100, 2), []
    for _ in range(600):
        size, source, cluster = draw.randint(0, 100), draw.choice("abbb"), draw.choice([None, *range(40)])
        fits = [
            (room - size, n) for n, (room, clusters, sources) in enumerate(bins)
            if room >= size and room > 0 and (cluster is None or cluster not in clusters) and sources.count(source) < 2
        ]
        number = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([100, set(), []])
        place = len(bins[number][2])
        assert packer.put(size, source, cluster) == (number, place)
        bins[number][0] -= size
        bins[number][1] |= set() if cluster is None else {cluster}
        bins[number][2].append(source)


def test_packing_keeps_every_word_and_conflict(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice(["a", "a", "b", None]), draw.choice([None, 1, 2, i]), draw.choice([None, 0, 5, 90, 250, 1000])) for i in range(300)]
    items = spark.createDataFrame(rows * 2, "doc_id long, source string, cluster long, size long").withColumn("shard", F.lit("x"))
    got = best_fit.pack(items, capacity=100, per_source=3, shard_rows=50).toPandas()
    assert got.groupby("doc_id").words.sum().to_dict() == {i: 2 * (s or 0) for i, _, _, s in rows}
    assert got.groupby("bin_id").words.sum().max() <= 100
    cluster = {i: c for i, _, c, _ in rows}
    own = got.assign(cluster=got.doc_id.map(cluster))
    assert own.dropna(subset=["cluster"]).groupby(["bin_id", "cluster"]).size().max() == 1
    assert own.assign(source=own.source.fillna("")).groupby(["bin_id", "source"]).size().max() <= 3
    assert not got.duplicated(["bin_id", "place"]).any()
    assert best_fit.pack(items.limit(0)).count() == 0
    odd = best_fit.pack(best_fit.items_of(awkward(spark)), capacity=4096).toPandas()
    assert odd.words.sum() == 60_000 + 60_001 + 4 + 8 + 6


BASE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute_base(text):
    def good(kind, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
            return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    patterns = {"email": BASE, "ip": plain, "card": pii.CARD, "phone": pii.PHONE}
    out = [(m.start(), list(patterns).index(k), m.end(), k) for k, p in patterns.items() for m in p.finditer(text) if good(k, m[0])]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(6)
    bits = ["a@b.c", "@", ".", "x", " ", "-", "+1 (017) 555-7713", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "12", "é", "%", "007.0255.1.2", "4111111111111112", "a.b@c-d.e.f"]
    for _ in range(4000):
        text = "".join(draw.choices(bits, k=draw.randint(1, 9)))
        assert pii.base_spans(text) == brute_base(text), text


def test_long_runs_take_linear_time():
    text = "7" * 400_000 + " " + "1.2.3.4 a@b.c " * 20_000 + "12 345 678 " * 20_000
    taken = pii.Taken(pii.base_spans(text))
    assert len(taken.starts) == 40_000 and not taken.free(400_001, 400_002) and taken.free(0, 400_001)


def test_taken_stretches_equal_a_plain_search():
    draw = random.Random(8)
    for _ in range(300):
        spans = [(a, a + draw.randint(1, 6), "ip") for a in draw.choices(range(60), k=draw.randint(0, 8))]
        taken, plain = pii.Taken(spans), [(a, b) for a, b, _ in spans]
        for _ in range(12):
            start = draw.randrange(60)
            end = start + draw.randint(1, 5)
            free = not any(a < end and start < b for a, b in plain)
            assert taken.free(start, end) == free
            if free and draw.random() < 0.5:
                taken.add(start, end)
                plain.append((start, end))


def pii_corpus(spark):
    draw, rows = random.Random(3), []
    for i in range(240):
        own = [f"wo{chr(97 + draw.randrange(26))}rd" for _ in range(60)]
        if i % 4 == 0:
            own[draw.randrange(60)] = draw.choice(["jo.doe@mail.example.com", "10.20.30.40", "4111 1111 1111 1111", "+1 (212) 555-0123"])
        rows.append((i, " ".join(own), "en", "s"))
    return docs_of(spark, rows)


def test_candidates_add_spans_and_leave_clean_texts(spark):
    docs = pii_corpus(spark)
    chooser = pii.fit(docs.select("doc_id", "text"), sample=240)
    got = pii.find(docs, chooser).toPandas().merge(docs.toPandas(), on="doc_id")
    for r in got.itertuples():
        base = brute_base(r.text)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for *_, k in base) for kind in pii.KINDS]
        assert base or r.spans == ""
    found = chooser.all_spans("please mail to anna (at) firma (dot) de now")[1]
    assert [k for *_, k in found] == ["email"]
    assert chooser.all_spans("it was on 2024-05-17 at the dot of noon")[1] == []


def test_candidates_are_learned_from_whole_texts(spark, monkeypatch):
    """All candidates lie beyond 40,000 characters; a text of very many gives a bounded number."""
    kept, boost = [], pii.boost
    monkeypatch.setattr(pii, "boost", lambda x, y, *a, **k: kept.append(len(x)) or boost(x, y, *a, **k))
    tail = " ".join(f"mail p{i}@firma{i}.de now" for i in range(60))
    pii.fit(docs_of(spark, [(i, "word " * 8000 + f"n{i} " + tail, "en", "s") for i in range(30)]))
    assert kept[0] >= 60 * 10
    many = pii.examples("word " * 8000 + " ".join(f"mail p{i}@firma{i}.de now" for i in range(3000)), 1)
    assert pii.PER_TEXT <= len(many) < pii.PER_TEXT + 200


def test_candidates_are_learned_from_all_texts(spark, monkeypatch):
    """Every text of 3,000 teaches or calibrates, and each of many candidates of one text."""
    seen, boost = [], pii.boost
    monkeypatch.setattr(pii, "boost", lambda x, y, *a, **k: seen.append(x) or boost(x, y, *a, **k))
    monkeypatch.setattr(pii, "ROUNDS", 2)
    numbers = 23  # the feature that holds a span's largest number
    pii.fit(docs_of(spark, [(i, f"t{i} mail p987654321@firma.de now", "en", "s") for i in range(3000)]))
    assert 1_850 < (seen[0][:, numbers] == 987654321).sum() < 2_150
    tail = " ".join(f"mail p{700_000 + i}@firma.de" for i in range(1_500))
    pii.fit(docs_of(spark, [(i, f"t{i} " + tail, "en", "s") for i in range(6)]))
    number, n = np.unique(seen[1][:, numbers], return_counts=True)
    n = n[(number >= 700_000) & (number < 701_500)]
    assert len(n) == 1_500 and n.min() == np.median(n)


def test_trees_learned_in_a_table_are_those_of_the_driver(spark, monkeypatch):
    docs = pii_corpus(spark)
    monkeypatch.setattr(pii, "ROUNDS", 7)
    here = pii.fit(docs)
    monkeypatch.setattr(pii, "ON_DRIVER", 0)
    monkeypatch.setattr(table_boosting, "REFRESH", 3)
    there = pii.fit(docs.repartition(5))
    x = np.array([f for i, r in enumerate(docs.collect()) for f, _ in pii.examples(r.text, i)], dtype=float)
    a, b = here.trees.chances(x), there.trees.chances(x)
    assert len(there.trees.trees) == 7 and np.abs(a - b).max() < 0.05 and np.abs(a - b).mean() < 0.002
    assert here.limits == pytest.approx(there.limits, abs=0.02)


def test_redaction_and_awkward_rows(spark):
    assert pii.redacted("a b@c.de +1 4", [(2, 8, "email"), (5, 9, "ip")]) == "a [EMAIL]+1 4"
    chooser = pii.fit(awkward(spark).select("doc_id", "text"))
    got = pii.find(awkward(spark), chooser).collect()
    assert len(got) == 12 and sum(r.n_email for r in got) == 1 and sum(r.n_card for r in got) == 1
    out = pii.redact(awkward(spark), chooser)
    assert out.columns == awkward(spark).columns and out.count() == 12
    clean = [r for r in out.collect() if r.doc_id == 8 and "[EMAIL]" in r.text]
    assert "[CARD]" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    empty = docs_of(spark, [])
    assert pii.find(empty, pii.fit(empty)).count() == 0 and pii.redact(empty, pii.fit(empty)).count() == 0


def test_roles_are_recovered(spark):
    draw, rows = random.Random(7), []
    for c in range(150):
        roles = (["system"] if c % 4 == 0 else []) + ["user", "assistant"] * draw.randint(1, 3)
        for t, role in enumerate(roles):
            lines = [" ".join(draw.choices(["alpha", "beta", "gamma", "delta"], k=draw.randint(3, 9))).capitalize() + "." for _ in range(draw.randint(1, 3))]
            rows.append((c, t, role, "\n".join(lines)))
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = transcripts.parse(transcripts.transcripts(talk), transcripts.fit(talk)).toPandas().set_index("conv_id")
    right = 0
    for c in range(150):
        turns = [(r, t) for i, _, r, t in rows if i == c]
        right += got.roles[c] == ",".join(r for r, _ in turns) and got.rendered[c] == transcripts.canonical(turns)
    assert right >= 0.95 * 150


def test_viterbi_equals_all_paths():
    draw = np.random.default_rng(3)
    size = len(transcripts.STATES)
    model = transcripts.Model(draw.standard_normal(size), draw.standard_normal((size, size)), [draw.standard_normal((size, w)) for w in transcripts.WIDTHS])
    lines = ["User: hello", "", "what?"]
    seen = transcripts.line_features(lines)
    emit = [[sum(t[s, v] for t, v in zip(model.seen, row)) for s in range(size)] for row in seen]
    best = max(
        ((a, b, c) for a in range(size) for b in range(size) for c in range(size)),
        key=lambda p: model.start[p[0]] + emit[0][p[0]] + model.move[p[0], p[1]] + emit[1][p[1]] + model.move[p[1], p[2]] + emit[2][p[2]],
    )
    assert tuple(model.states(lines)) == best


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 3, "robot", ""), (2, 999, "assistant", "x " * 50_000)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("p")).withColumn("turns", F.lit(1))
    got = transcripts.parse(transcripts.transcripts(talk), transcripts.fit(talk)).collect()
    assert sorted((str(r.conv_id), r.part) for r in got) == [("1", -1), ("1", 0), ("2", 3), ("None", 0)]
    none = transcripts.parse(spark.createDataFrame([(1, 0, None), (2, 0, "")], "conv_id long, part long, text string"), transcripts.fit(talk))
    assert [(r.n_turns, r.rendered) for r in none.collect()] == [(0, ""), (0, "")]
    empty = talk.limit(0)
    assert transcripts.parse(transcripts.transcripts(empty), transcripts.fit(empty)).count() == 0


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight, target, closed = {s: i % 3 + 1 for i, s in enumerate(names)}, dict.fromkeys(names, 0.0), set()
    while True:
        rest = sum(sizes.values()) - sum(target[s] for s in closed)
        share = sum(weight[s] for s in names if s not in closed)
        for s in set(names) - closed:
            target[s] = rest * weight[s] / share
        over = {s for s in set(names) - closed if target[s] > 3 * sizes[s]}
        for s in over:
            target[s] = 3.0 * sizes[s]
        closed |= over
        if not over or closed == set(names):
            return target


def test_mixture_meets_targets(spark):
    draw, rows = random.Random(1), []
    for i in range(2000):
        source = draw.choice(["hot"] * 12 + ["é", "b", None, "tiny"] if i % 50 == 0 else ["hot"] * 6 + ["b", "é", None])
        rows.append((i, "w " * min(400, int(draw.expovariate(1 / 40))), "en", source))
    got = entropy_mix.mixture(docs_of(spark, rows)).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "t", "l", "source"]), on="doc_id")
    sizes = {s: int(g["size"].sum()) for s, g in got.fillna({"source": "~"}).groupby("source")}
    want = plain_targets({None if s == "~" else s: n for s, n in sizes.items()})
    for s, g in got.fillna({"source": "~"}).groupby("source"):
        own = want[None if s == "~" else s]
        np.testing.assert_allclose(g.target, own, rtol=1e-9)
        assert abs(g.taken.sum() - own) <= 0.02 * own + 5, s
        assert (g.source_size == sizes[s]).all()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got["size"] * got.copies).all()


@pytest.mark.parametrize("giants, long", [(1, 30_000), (3, 9_000), (1, 500)])
def test_mixture_around_giant_documents(spark, giants, long):
    """A source half of which is one document still meets its target to a short document's length."""
    rows = [(i, "w " * 100, "en", "a") for i in range(300)] + [(1000 + i, "w " * long, "en", "a") for i in range(giants)]
    rows += [(2000 + i, "w " * 50, "en", "b") for i in range(400)] + [(5000 + i, "w " * (i % 90 + 1), "en", "c") for i in range(300)]
    got = entropy_mix.mixture(docs_of(spark, rows)).toPandas()
    got["source"] = got.doc_id.map({r[0]: r[3] for r in rows})
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(100, 0.001 * g.target.iloc[0])
    assert (got.copies <= 3).all() and (got.copies >= 0).all()


def test_dual_solution_is_the_maximum_entropy_one(spark):
    rows = [("=a", n, 5) for n in range(1, 40)] + [("=b", n, 50) for n in range(1, 20)]
    solved = {r.key: r for r in entropy_mix.solve(spark.createDataFrame(rows, "key string, size long, n long")).collect()}
    for key, r in solved.items():
        if not r.full:
            words_ = sum(n * s * min(3.0, np.exp(r["lambda"] * s / r.scale)) for k, s, n in rows if k == key)
            assert words_ == pytest.approx(r.target, rel=1e-5)


def test_mixture_of_awkward_rows(spark):
    got = entropy_mix.mixture(awkward(spark)).collect()
    assert len(got) == 12 and all(0 <= r.taken <= 3 * r.size for r in got)
    first = sorted((str(r.doc_id), r.size, r.taken) for r in got)
    assert first == sorted((str(r.doc_id), r.size, r.taken) for r in entropy_mix.mixture(awkward(spark)).collect())
    mixed = entropy_mix.mix(awkward(spark))
    assert mixed.columns == awkward(spark).columns
    assert mixed.count() == sum(r.taken // r.size for r in got if r.size)
    empty = docs_of(spark, [])
    assert entropy_mix.mixture(empty).count() == 0 and entropy_mix.mix(empty).count() == 0


def test_whole_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Of 17 MB of texts in one partition no worker holds more than about TEXTS at once; the session stays as it was."""
    before, most, hashed = spark.conf.get(session.BATCH), session.TEXTS + (1 << 20), lsh_forest.word_hashes

    def guarded(texts):
        texts = list(texts)
        assert sum(map(len, texts)) <= most
        return hashed(texts)

    monkeypatch.setattr(lsh_forest, "word_hashes", guarded)
    rows = spark.range(0, 1200, 1, 1).withColumnRenamed("id", "doc_id").withColumn("text", F.repeat(F.concat_ws(" ", F.lit(" w"), F.col("doc_id") % 600), 2500))
    assert rows.select(F.sum(F.length("text"))).first()[0] > 2 * most
    assert lsh_forest.keep_first(rows).count() == 600
    sizes = rows.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) > most >= max(r.n for r in session.durable(sizes, "sizes", session.TEXTS).collect())
    assert spark.conf.get(session.BATCH) == before


def test_redaction_in_parts_of_a_batch(spark, monkeypatch):
    """A batch is redacted in parts, nulls and texts at their edges included."""
    monkeypatch.setattr(pii, "TEXTS", 40)
    texts = [None, "", "write to ann.lee@mail.com now", "x" * 100, "host 10.0.0.1", None, "plain", "bob@mail.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    chooser = pii.Chooser(None, dict.fromkeys(pii.KINDS, 2.0))
    found = [r.text for r in pii.redact(docs, chooser).orderBy("doc_id").collect()]
    assert found == [None, "", "write to [EMAIL] now", "x" * 100, "host [IP]", None, "plain", "[EMAIL]"]
    assert pii.redact(docs.limit(0), chooser).count() == 0
