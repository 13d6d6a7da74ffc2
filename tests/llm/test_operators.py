"""The training-data operators against brute force, and nulls, empty tables, ties, repeats and odd columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("sheaf.llm")
from sheaf.llm import ann, common, context_tree, decontaminate, langid, licenses, packing, sharding, simhash, suffix_dedup, toxicity  # noqa: E402
from sheaf.llm.queries import tokenizer_files  # noqa: E402

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, held_out string"
DATA = "/root/testdata/sf0.001"


def rows_of(spark, rows):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 0.5, 9, "x") for i, t, lang in rows], DDL)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "é"]) for _ in range(rng.randint(1, 3)))
    base = [" ".join(word() for _ in range(rng.randint(30, 90))) for _ in range(12)]
    rows = []
    for i in range(150):
        t = rng.choice(base)
        if i % 3 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        if i % 5 == 0:
            t = word() + " " + t[rng.randrange(40) :]
        rows.append((i, t, rng.choice(["aa", "bb"])))
    return rows + [(900, None, "aa"), (901, "", None), (902, "  \n", "bb"), (903, "12 34", "aa"), (904, "a" * 3000, "aa"), (905, "ab" * 1500, "bb"), (3, rows[3][1], rows[3][2]), (906, base[0], None)]


def test_suffix_dedup_is_the_brute_force(spark, cases, monkeypatch):
    def brute(rows):
        seen, out = set(), {}
        for d, t in sorted({(i, t or "") for i, t, _ in rows}):
            b = t.encode()
            gone = bytearray(len(b))
            for s in range(len(b) - 99):
                if b[s : s + 100] in seen:
                    gone[s : s + 100] = b"\1" * 100
                seen.add(b[s : s + 100])
            out[d] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
        return out

    want = brute(cases)
    for hot, many in ((64, 512), (2, 3)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        got = suffix_dedup.without_repeats(rows_of(spark, cases)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert len(got) == len(cases) and {r[0]: tuple(r[1:]) for r in got} == want


def test_suffix_dedup_of_one_doc_id_with_two_texts(spark):
    """Each text loses its own bytes: what the other, or an earlier document, holds as well."""
    rng = random.Random(1)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(3))
    rows = [(1, a, "x"), (2, a[:150] + b, "x"), (2, c + b[50:300], "x"), (2, a[:150] + b, "x")]
    got = [(r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in suffix_dedup.without_repeats(rows_of(spark, rows)).collect()]
    first = (550, 150, b) in got
    want = [(400, 0, a)] + ([(550, 150, b)] * 2 + [(650, 250, c)] if first else [(550, 400, b[:50] + b[300:])] * 2 + [(650, 0, c + b[50:300])])
    assert sorted(got) == sorted(want)


def test_sampled_windows_agree_on_their_offset():
    a, b = b"xyz" * 9 + b"the same hundred and more bytes stand here " * 4, b"q" * 31 + b"the same hundred and more bytes stand here " * 4
    names = lambda t: {t[s : s + 100]: (int(h), s) for h, _, lo, n in zip(*suffix_dedup.runs(t), strict=True) for s in range(lo, lo + n)}
    x, y = names(a), names(b)
    assert set(x) & set(y) and all(x[w][0] == y[w][0] for w in set(x) & set(y))


def reference_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components_are_the_brute_force(spark, cases, monkeypatch):
    fps = {i: reference_fingerprint(t) for i, t, _ in cases}
    for small in (48, 2):
        monkeypatch.setattr(simhash, "SMALL", small)
        got = simhash.near_duplicates(rows_of(spark, cases)).collect()
        assert len(got) == len(cases) and all(r.fingerprint == f"{fps[r.doc_id]:016x}" for r in got)
        up = {i: i for i in fps}
        for _ in fps:
            new = {i: min(up[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}
            if new == up:
                break
            up = new
        assert {r.doc_id: r.component_id for r in got} == up


def test_simhash_rows_of_one_doc_id_are_one_document(spark):
    docs = rows_of(spark, [(5, "one two three four five six", "aa"), (5, "other words stand here for once", "aa"), (1, "one two three four five six", "aa"), (9, "other words stand here for once", "aa"), (7, "neither of the two texts before", "aa")])
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(1, 1), (5, 1), (5, 1), (7, 7), (9, 1)]


def test_simhash_groups_are_whole_across_loads(spark, cases, monkeypatch):
    want = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows_of(spark, cases)).collect())
    monkeypatch.setattr(simhash, "LOAD", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows_of(spark, cases)).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_simhash_large_groups_keep_their_components():
    rng = np.random.default_rng(0)
    fp = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, (300, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64))
    node = np.arange(len(fp))
    edges = list(simhash.search(node, fp))
    assert len(edges) <= len(fp) - 1 and all((int(fp[a]) ^ int(fp[b])).bit_count() <= 4 for a, b in edges)


def test_language_id(spark, cases):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = langid.identified(rows_of(spark, cases)).collect()
    assert len(odd) == len(cases) and {r.lang_pred for r in odd if r.doc_id in (900, 901, 902, 903)} == {"und"}
    assert {r.lang_pred for r in odd if r.doc_id < 150} <= {"aa", "bb"}


def test_language_id_is_the_brute_force(spark):
    """Profiles, distances and scores from strings, for every document of a table."""
    from collections import Counter

    def grams(t):
        own = []
        for ch in "\1" + "".join(x if x.isalpha() else "\1" for x in t.lower()) + "\1":
            if ch != "\1" or not own or own[-1] != "\1":
                own.append(ch)
        own = "".join(own)
        return [x for x in own if x != "\1"] + [own[i : i + 2] for i in range(len(own) - 1)] + [own[i : i + 3] for i in range(len(own) - 2) if own[i + 1] != "\1"]

    ranked = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:300]]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows, by = docs.collect(), {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            by.setdefault(r.lang, Counter()).update(grams(r.text))
    profiles = {k: {g: n for n, g in enumerate(ranked(v))} for k, v in sorted(by.items())}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs).collect()}
    for r in rows:
        own = ranked(Counter(grams(r.text)))
        apart = {k: sum(min(abs(p[g] - n), 300) if g in p else 300 for n, g in enumerate(own)) for k, p in profiles.items()}
        best = min(apart, key=lambda k: (apart[k], k))
        assert got[r.doc_id][0] == best and abs(got[r.doc_id][1] - (1 - apart[best] / (300 * len(own)))) < 1e-12


def test_out_of_place_distance_by_hand():
    p = langid.Profiles({"x": np.array([5, 6, 7]), "y": np.array([7, 9])}, top=3)
    assert p.predict(np.array([7, 7, 9])) == ("y", 1.0)
    assert p.predict(np.array([6, 6, 5, 5, 5])) == ("x", 1.0)
    assert p.predict(np.array([1])) == ("x", 0.0) and p.predict(np.zeros(0, np.int64)) == ("und", 0.0)


def test_toxicity_learns_labels_and_holds_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = [(50_000, None, None, None, None), (50_001, "", "en", "s", 0), (50_002, "x " * 300_000, "en", "s", 600_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(5))
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    above = [(a > b) + (a == b) / 2 for a, x in held if x for b, y in held if not y]
    assert above and sum(above) / len(above) > 0.85
    # what is held out does not tell: other labels there leave the scores as they are
    other = labels.withColumn("toxic", F.when(common.remainder(5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.scored(docs, other).collect()} == {(r.doc_id, r.score) for r in got}
    assert not toxicity.scored(docs.limit(20), labels.limit(0)).where("score <> 0.5").count()


def test_toxicity_nearest_is_the_brute_force_cosine(monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    draw = lambda: {w: rng.randint(1, 4) for w in rng.sample(words[: rng.choice([5, 60])], rng.randint(1, 5))}
    examples = [draw() for _ in range(1500)]
    start = np.concatenate([[0], np.cumsum([len(e) for e in examples])])
    term, n = (np.array([x for e in examples for x in c(e)]) for c in (lambda e: [words.index(w) for w in e], dict.values))
    for dense in (0, 10, 512):  # short lists alone, both kinds, long lists alone
        monkeypatch.setattr(toxicity, "DENSE", dense)
        ix = toxicity.Index(pa.array(words), 0.1 + np.arange(60) / 9, np.array([(i, i % 2, 1.0) for i in range(1500)]), start, term, n)
        ix = toxicity.received(toxicity.shipped(ix))
        every = np.zeros((len(ix.ids), len(words)))
        for at, i in enumerate(ix.ids):
            t, x = ix.vector(examples[i])
            every[at, t] = x
        asked = [ix.vector(draw()) for _ in range(90)] + [ix.vector({})]
        left = np.array([rng.choice([-1, rng.randrange(1500)]) for _ in asked])
        for but in (np.full(len(asked), -1), left):
            for n_, ((t, x), (ids, got)) in enumerate(zip(asked, ix.nearest(asked, 25, but), strict=True)):
                sims = every[:, t] @ x
                if but[n_] >= 0:
                    sims[but[n_]] = 0
                want = np.sort(sims)[::-1][: len(ids)]
                assert len(ids) == min(25, (sims > 1e-12).sum()) and np.allclose(got, want) and np.allclose(sims[ids], got)


def test_toxicity_keeps_rare_terms_and_counts_them_over_all_documents(spark):
    """A term of three toxic examples tells; its document frequency is that of the whole table."""
    rows = [(i, "ba ke lo " + ("vile" if i < 3 else "foul" if i < 300 else "mi"), "aa") for i in range(3000)]
    rows += [(5000 + i, "ba vile", "aa") for i in range(40)]
    docs = rows_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(3000) if i >= 3 or zlib.crc32(str(i).encode()) % 5], "doc_id long, toxic int")
    ix = toxicity.fit(docs, labels).ready()
    assert {"vile", "foul", "mi"} <= set(ix.term)
    n = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(3))
    train = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5]
    share = sum(i < 300 for i in train) / len(train)
    want = (np.log(3041 / 44) + 1) * ((n + 10 * share) / (n + 10) - share)
    assert abs(ix.idf[ix.term["vile"]] - want) < 1e-9


NOTICES = {
    "MIT": "Copyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
    "GPL-2.0": "# This program is free software; you can redistribute it and/or\n# modify it under the terms of the GNU General Public License\n# as published by the Free Software Foundation; either version 2\n# of the License, or (at your option) any later version.",
    "Apache-2.0": "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0",
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.",
    "unknown": "The Harbour Community Licence. You may copy and use this software\nfor research provided that this notice is kept and no fee is charged; all\nother rights are reserved by the copyright holder.",
}


def test_licences_are_found_and_unknown_ones_said(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    body = docs.where("length(text) between 300 and 900 and not lower(text) like '%licen%'").orderBy("doc_id").limit(2).collect()
    plain = {9000: body[0].text, 9001: None, 9002: "", 9003: "of the and for", 9004: body[1].text + "\n"}
    told = {9100 + n: t for n, t in enumerate(NOTICES.values())}
    inside = {9200 + n: body[n % 2].text + "\n" + t + "\n" + body[1 - n % 2].text for n, t in enumerate(NOTICES.values()) if n < 5}
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in {**plain, **told, **inside}.items()], docs.schema)
    got = {r.doc_id: r for r in licenses.scanned(docs.unionByName(more)).collect()}
    assert len(got) == docs.count() + len(plain) + len(told) + len(inside)
    assert all(got[i].licence is None for i in plain) and got[9001].n_paragraphs == got[9002].n_paragraphs == 0
    assert [got[i].licence for i in told] == list(NOTICES) and [got[i].licence for i in inside] == list(NOTICES)[:5]
    assert [f.paragraph for f in got[9100].findings] == [1] and got[9100].n_paragraphs == 2
    # every document of the table with a licence sentence, and hardly any other
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    want = {r.doc_id: k for r in docs.collect() for x, k in lines.items() if x in r.text}
    assert len(want) > 20 and all(got[i].licence == k for i, k in want.items())
    assert sum(r.licence is not None and i < 9000 and i not in want for i, r in got.items()) <= 0.01 * len(got)


def test_windows_are_the_features_of_their_words():
    """Logits by running sums are those of each window by itself."""
    model = licenses.Classifier(["ba ke lo mi tu " * 20, "and of the to in " * 9])
    words = licenses.WORD.findall((NOTICES["MIT"] + " ba ke lo " * 9).lower())
    start, p = model.windows(words)
    for s, got in zip(start.tolist(), p, strict=True):
        z = model._features(words[s : s + licenses.WIDTH])[:-1] @ model.weights + model.bias
        assert np.allclose(model._soft(z[None] / model.heat)[0], got, atol=1e-4)
    assert set(range(len(words))) == {k for s in start.tolist() for k in range(s, min(len(words), s + licenses.WIDTH))}


def test_context_tree_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    s = context_tree.strings([bytes(rng.choice(list(b"abc "), 40).tolist()) for _ in range(30)], 5)
    tables = [np.unique(s & np.uint64((1 << (8 * (d + 1))) - 1), return_counts=True) for d in range(6)]
    for cut in (0, 1):
        m = context_tree.Model([(c[n > cut], n[n > cut]) if d > 3 else (c, n) for d, (c, n) in enumerate(tables)])
        for ctx in [*np.unique(s >> np.uint64(8))[:4], np.uint64(0x7A7A7A7A7A), np.uint64(0x7A7A616262)]:
            assert abs((2.0 ** m.bits_of(ctx << np.uint64(8) | np.arange(256, dtype=np.uint64))).sum() - 1) < 1e-5


def test_mixture_is_context_tree_weighting():
    """One bit of one depth, worked out from the definition."""
    zeros, ones = np.array([3.0, 0.0]), np.array([1.0, 2.0])
    kt = lambda a, b: np.prod([(i + 0.5) / (n + 1) for n, i in enumerate(range(int(a)))]) * np.prod([(j + 0.5) / (int(a) + j + 1) for j in range(int(b))])
    assert np.allclose(np.exp(context_tree.kt(zeros, ones)), [kt(a, b) for a, b in zip(zeros, ones, strict=True)])


def test_base_scores_are_the_brute_force(spark, cases):
    got = {(r.doc_id): r for r in context_tree.scored(rows_of(spark, cases)).collect()}
    train = [(t or "").encode().lower().split() + [None] for i, t, _ in cases if zlib.crc32(str(i).encode()) % 7 != 2]
    flat = [w for t in train for w in t]
    n, v = len(flat), len(set(flat))
    from collections import Counter

    c = Counter(flat)
    for i, t, _ in cases:
        w = (t or "").encode().lower().split() + [None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in c for x in w), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert abs(r.base_score - sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 and r.score < 0


def test_long_texts_that_differ_in_the_middle_are_scored_apart(spark, monkeypatch):
    """Packs of one doc_id with equal ends each get their own replies, and U+0000 in a text is not its end."""
    monkeypatch.setattr(context_tree, "PACKED", 1 << 14)
    same = "ba ke lo mi tu " * 400
    texts = [same + "one two " * 300 + same, same + "three " * 400 + same, "a\0b ba", "a"]
    got = context_tree.scored(rows_of(spark, [(7, t, "aa") for t in texts]).repartition(1)).collect()
    words = [t.split() + [None] for t in texts]
    flat = [w for t in words for w in t]
    n, v = len(flat), len(set(flat))
    want = sorted(sum(np.log10((flat.count(x) + 1) / (n + v + 1)) for x in w) for w in words)
    assert np.allclose(sorted(r.base_score for r in got), want) and all(r.score < 0 for r in got)


def test_context_tree_scores_are_the_definition(spark, cases):
    """Every string counts, and what depth 5 lacks is taken from the deepest depth that has the bits so far."""
    from collections import defaultdict
    from functools import cache
    from math import lgamma, log, log10, pi

    rows = [(i, t and t[:120], lang) for i, t, lang in cases[:60]] + [(i, t, "aa") for i, t in ((2000, "ba!e lo kex"), (2001, "zzba kelo"), (2002, "Ä"))]
    held = [i for i in range(3000, 3100) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows += list(zip(held, ["xbalo mi", "tu?ke lo ba", "", "q\u4e16"], ["aa"] * 4, strict=True))
    count, below = defaultdict(lambda: [0, 0]), defaultdict(set)

    def bits(t):
        b = context_tree.EDGE * 5 + t.encode() + context_tree.EDGE
        for at in range(5, len(b)):
            for k in range(8):
                yield b[at - 5 : at], (k, b[at] >> (8 - k)), b[at] >> (7 - k) & 1

    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for ctx, node, bit in bits(t or ""):
                for d in range(6):
                    count[ctx[5 - d :], node][bit] += 1
                    if d:
                        below[ctx[6 - d :], node].add(ctx[5 - d :])
    own = lambda ctx, node: lgamma((c := count[ctx, node])[0] + 0.5) + lgamma(c[1] + 0.5) - lgamma(sum(c) + 1) - log(pi)

    @cache
    def weighted(ctx, node):
        return own(ctx, node) if len(ctx) == 5 else np.logaddexp(own(ctx, node), sum(weighted(c, node) for c in below[ctx, node])) - log(2)

    @cache
    def log_p(ctx, node, bit):
        mass, left, p = 0.0, 1.0, 0.5
        for d in range(6):
            c = ctx[5 - d :]
            if (c, node) not in count:
                break
            one = (count[c, node][bit] + 0.5) / (sum(count[c, node]) + 1)
            p, stop = mass + left * one, np.exp(own(c, node) - log(2) - weighted(c, node)) if d < 5 else 1.0
            mass, left = mass + left * stop * one, left * (1 - stop)
        return log10(p)

    got = {r.doc_id: r.score for r in context_tree.scored(rows_of(spark, rows)).collect()}
    for i, t, _ in rows:
        assert abs(got[i] - sum(log_p(*x) for x in bits(t or ""))) < 1e-4, i


def check_packing(got, docs, room=2048):
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for rows in seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= room
    return by, seq


def test_packing_places_every_id_once(spark, cases):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files()[0])
    docs = [r for r in cases if r[0] != 3] + [(907, "x <|endoftext|> y", "aa"), (908, "lo mi " * 4000, "aa")]
    by, _ = check_packing(packing.packed_documents(rows_of(spark, docs), *tokenizer_files()).collect(), docs)
    for i, text, _ in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_ids_of_a_whole_table_are_the_tokenizers(spark):
    """The ranks give the tokenizer's ids on every text, and hardly any room of a sequence is left."""
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(tokenizer_files()[0]), packing.encoder(*tokenizer_files())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").union(spark.read.parquet(f"{DATA}/documents.parquet"))
    for r in docs.select("text").collect():
        assert fast([r.text])[0] == whole.encode(r.text, add_special_tokens=False).ids
    got = packing.packed_documents(docs, *tokenizer_files()).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in got) / (2048 * len(got)) > 0.97


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 3000)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    got = packing.patterns(counts, 256)
    assert all(sum(s * n for s, n in one.items()) <= 256 for _, one in got)
    assert {s: sum(k * one.get(s, 0) for k, one in got) for s in counts} == counts
    assert sum(k for k, _ in got) <= 1.02 * sizes.sum() / 256 + 1 and packing.patterns({}, 256) == []


def test_neighbours_reach_the_recall_and_the_edges(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    same = [(10_000 + i, [1.0] + [0.0] * 63) for i in range(150)]
    odd = [(20_000, None), (20_100, []), (20_200, [0.0] * 64), (20_300, [float("nan")] * 64), (20_400, [1.0, None] + [0.0] * 62), (20_500, [1.0, 2.0])]
    rows = e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).union(spark.createDataFrame(same + odd, "vec_id long, embedding array<double>"))
    got = {}
    for r in ann.neighbours(rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    short = np.array([1.0, 2.0] + [0.0] * 62)  # zeros after its last component
    table = [(r.vec_id, np.array(r.embedding, float)) for r in rows.collect() if r.vec_id < 20_000] + [(20_500, short)]
    ids, x = np.array([i for i, _ in table]), np.stack([v for _, v in table])
    hit = 0
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(s == d[ids == i][0] for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hit / (10 * len(got)) >= 0.9
    assert [i for _, i, _ in got[10_100]] == list(range(10_000, 10_010))
    assert ann.neighbours(rows.limit(0)).count() == 0
    assert {r.vec_id for r in ann.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()} == {1}


def test_vectors_of_one_id_are_taken_together(spark):
    """A candidate counts with its nearest vector, a query with each; repeated rows once."""
    rows = [(0, [0.0, 1.0]), (0, [9.0, 1.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [9.0, 4.0]), (2, [100.0, 100.0]), (3, [50.0, 50.0])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r.rank, r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 3.0), (3, 3, round(float(np.hypot(41, 49)), 6))]


def test_sharding_laws(spark, cases):
    rows = rows_of(spark, cases)
    got = sharding.shards_by_bytes(rows).collect()
    assert len(got) == len(cases)
    text = {i: t or "" for i, t, _ in cases}
    where, slots = {}, {}
    for r in got:
        assert r["size"] == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and 0 <= r.shard < 40
        where.setdefault(text[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in where.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_a_table_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    load = {}
    for r in sharding.shards_by_bytes(docs).collect():
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert len(load) == 40 and max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 40


def test_best_fit_decreasing_takes_the_tightest_bin():
    assert sharding.best_fit_decreasing([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 1000, 4000)]
    load = np.bincount(sharding.near_equal(sizes, 40), sizes, 40)
    assert load.max() - load.min() <= 0.01 * load.mean()


def test_decontamination_finds_planted_items_alone(spark, cases):
    item = "which of the ten rivers runs north past the old mill and the town? the quiet one by the hill runs north"
    w = item.split()
    near = " ".join(w[:9] + w[10:])  # one word lost: 5 of 18 shingles
    asked = item.split("?")[0] + "? "
    more = [(1, "filler " * 300 + item.upper() + " filler" * 50, "en"), (2, near, "en"), (4, " ".join(w[:19]) + " zz", "en"), (5, asked + "nobody here can say where that one ends", "en")]
    docs = rows_of(spark, [*cases, *more])
    items = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "", "x"), (10, "zig zag", "x"), (7, item, "x")], "item_id long, text string, doc_id string")
    got = [(r.doc_id, r.item_id, round(r.overlap, 2)) for r in decontaminate.leaks(docs, items).collect()]
    assert sorted(got) == [(1, 7, 1.0), (4, 7, 0.83)]
    left = decontaminate.without_leaks(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 2
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_a_question_without_its_answer_is_no_leak():
    item = "which of the ten rivers runs north past the old mill and the town and then through the long valley? the Ems"
    ix = decontaminate.Index([(1, item)])
    assert [r[0] for r in ix.search("x y " + item + " z")] == [1] and ix.search("x y " + item)[0][1:4] == (1.0, 1.0, 1.0)
    assert ix.search("x y " + item.split("?")[0] + "? the Lys and more of it") == []
    assert decontaminate.parts("Sum of two and two\nAnswer: four it is") == (6, 3) and decontaminate.parts("one two\nthree") == (3, 0)


def test_wand_finds_all_that_reach_the_threshold():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    ix = decontaminate.Index(list(enumerate(items)))
    start, item, value = ix.post
    some = 0
    for _ in range(200):
        terms = sorted({ix.term[w] for w in [*rng.sample(words, rng.randint(1, 20)), *rng.choice(items).split()] if w in ix.term})
        score = np.zeros(len(ix.ids))
        for t in terms:
            score[item[start[t] : start[t + 1]]] += value[start[t] : start[t + 1]]
        want = set(np.flatnonzero(score >= 1 + 1e-9).tolist())
        got = list(ix.wand(terms))
        assert got == sorted(set(got)) and want <= set(got) <= set(np.flatnonzero(score >= 1 - 1e-9).tolist())
        some += len(got)
    assert some >= 200


def test_pruning_loses_no_leak(spark):
    """Every document of a table against every item, by counting shingles alone."""
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet").collect(), spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    ix = decontaminate.Index([(r.item_id, r.text) for r in bench])
    tok = lambda t: decontaminate.WORD.findall(t.lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    want = {(d.doc_id, b.item_id) for d in docs for own in [set(grams(tok(d.text)))] for b in bench if sum(g in own for g in grams(tok(b.text))) >= 0.8 * len(grams(tok(b.text)))}
    assert {(d.doc_id, i) for d in docs for i, *_ in ix.search(d.text)} == want and want


@pytest.mark.parametrize("run", [lambda d, s: simhash.near_duplicates(d), lambda d, s: langid.identified(d), lambda d, s: toxicity.scored(d, s.read.parquet(f"{DATA}/labels.parquet")), lambda d, s: licenses.scanned(d), lambda d, s: context_tree.scored(d), lambda d, s: packing.packed_documents(d, *tokenizer_files()), lambda d, s: sharding.shards_by_bytes(d), lambda d, s: suffix_dedup.without_repeats(d)])
def test_empty_tables_give_no_rows(spark, run):
    assert run(rows_of(spark, [(1, "x", "en")]).where("doc_id = 2"), spark).count() == 0


def test_rows_without_doc_id_do_not_fail(spark):
    docs = rows_of(spark, [(None, "some words here to read", "en"), (None, "some words here to read", "en"), (1, "some words here to read", "en")])
    assert simhash.near_duplicates(docs).where("component_id is null").count() == 2
    assert langid.identified(docs).count() == sharding.shards_by_bytes(docs).count() == context_tree.scored(docs).count() == suffix_dedup.without_repeats(docs).count() == 3
    assert packing.packed_documents(docs, *tokenizer_files()).count() == 3


def test_written_uses_the_shared_folder(spark):
    df = common.written(spark.range(3).toDF("x"))
    assert all(f.startswith(common.shared_folder(spark).replace("file://", "file:///").replace("////", "///")) for f in df.inputFiles())


@pytest.fixture(scope="module")
def licence_model(spark):
    return licenses.trained(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_the_classifier_names_and_the_template_confirms(licence_model):
    """Every identifier of the families, identifiers outside them, dual licences, denials, and every statement alone."""
    names = lambda t: [f[0] for f in licence_model.document(t)[1]]
    for family, ids in licenses.SPDX.items():
        for i in ids:
            assert names(f"SPDX-License-Identifier: {i}") == names(f"// SPDX-License-Identifier: {i}\n\nint x;") == [family], i
    for i in ("AFL-3.0", "MS-RL", "EUPL-1.2", "NCSA", "PostgreSQL", "Ruby", "X11", "CC-BY-ND-4.0", "CC-BY-3.0", "EPL-1.0", "MPL-1.1", "Apache-1.1", "GPL-1.0-only", "CC-BY-NC-SA-4.0"):
        assert names(f"SPDX-License-Identifier: {i}") == ["unknown"], i
    assert names("not licensed under the Apache License, Version 2.0; it is proprietary") == ["unknown"]
    assert set(names("Dual licensed under the MIT License or the GNU General Public License, version 2")) == {"MIT", "GPL-2.0"}
    assert set(names("SPDX-License-Identifier: MIT OR Apache-2.0")) == {"MIT", "Apache-2.0"}
    for family, statements in licenses.TEMPLATES.items():
        for t in statements:
            assert names(t) == [family], t


def test_likeness_is_the_best_template_of_the_family(licence_model):
    """By brute force over all statements: the likeness that is told is that of the named family's best statement."""
    pairs = lambda t: licenses.pairs_of(licenses.WORD.findall(t.lower()))
    for t in NOTICES.values():
        for family, sure, like, _ in licence_model.document(t)[1]:
            if family != "unknown":
                assert 0 < sure <= 1 and licenses.LIKE <= like <= max(len(pairs(x) & pairs(t)) / len(pairs(x)) for x in licenses.TEMPLATES[family]) + 1e-12
    long = "plain words here and there " * 40_000 + "\n\nReleased under the MIT License.\n\n" + "more " * 300_000
    assert [f[0] for f in licence_model.document(long)[1]] == ["MIT"]
