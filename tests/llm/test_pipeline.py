"""The pipeline against a brute-force version of its filters."""

import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from sheaf.llm import common  # noqa: E402
from tests.llm.test_operators import reference_fingerprint  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_keep_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(7000, None, "en", "s", None), (7001, "123 !!", "en", "s", 6)], docs.schema)
    docs = docs.unionByName(odd)
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, DATA)
    assert one.columns == docs.columns and {r.doc_id for r in docs.join(one, "doc_id", "left_anti").collect()} == {7000, 7001}
    texts = {r.doc_id: r.text for r in one.collect()}
    fps = {i: reference_fingerprint(t) for i, t in texts.items()}
    up = {i: i for i in fps}
    while (new := {i: min(up[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}) != up:
        up = new
    two = stages["near_dedup"](spark, one, DATA)
    assert {r.doc_id for r in two.collect()} == {i for i in up if up[i] == i}
    seen, left = set(), {}
    for i in sorted(x.doc_id for x in two.collect()):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        rest = bytes(x for x, g in zip(b, gone) if not g)
        if rest or not b:
            left[i] = texts[i] if rest == b else rest.decode("utf-8", "replace")
    three = stages["suffix_dedup"](spark, two, DATA)
    got = {r.doc_id: r for r in three.collect()}
    assert set(got) == set(left) and all(got[i].text == t and got[i].n_chars == len(t) for i, t in left.items() if "�" not in t)
    four = stages["decontaminate"](spark, three, DATA)
    assert four.columns == docs.columns and 0 < four.count() < three.count()
    five = stages["pack"](spark, four, DATA)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}


def test_stages_take_clashing_names_repeats_and_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    names = ("score", "lang_pred", "_text", "kept", "n_bytes", "n_removed", "n_spans", "_spans", "_doc", "component_id", "fp", "twin", "size", "Root")
    wide = docs.select("*", *(F.lit("own").alias(c) for c in names))
    wide = wide.unionByName(wide).unionByName(wide.limit(1).withColumn("doc_id", F.lit(8000).cast("long")).withColumn("text", F.lit("").cast("string")))
    stages, at = corpus_pipeline.STAGES, wide
    for name, stage in stages[:-1]:
        at = common.written(stage(spark, at, DATA))
        assert at.columns == wide.columns and at.count() and all(at.where(F.col(c) != "own").count() == 0 for c in names), name
        if name == "near_dedup":
            assert at.count() == at.select("doc_id").distinct().count()
    assert stages[-1][1](spark, at, DATA).count() >= at.count()
    for _, stage in stages:
        assert stage(spark, wide.limit(0), DATA).count() == 0


def test_language_stage_rejects_what_is_near_no_profile_and_fills_lang(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(9000, "数据处理是一个系统", None, "s", 9), (9001, "zxq wvk jjq xqz", None, "s", 15), (9002, docs.where("lang = 'de'").first().text, None, "s", 1)]
    got = corpus_pipeline.identify(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), DATA)
    assert {r.doc_id: r.lang for r in got.where("doc_id >= 9000").collect()} == {9002: "de"}
    assert got.count() == docs.count() + 1


def test_long_texts_pass_all_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    long = " ".join(r.text for r in docs.where("lang = 'en'").collect()) * 6
    at = docs.limit(30).unionByName(spark.createDataFrame([(9100, long, "en", "s", len(long))], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = common.written(stage(spark, at, DATA))
    left = at.where("doc_id = 9100").first().text
    assert 0 < len(left) < len(long) / 4
    # the joined texts hold benchmark items, so the long document goes; one without them is packed whole
    clean = at.withColumn("text", F.when(F.col("doc_id") == 9100, F.regexp_replace("text", "[a-m]", "q")).otherwise(F.col("text")))
    kept = common.written(corpus_pipeline.decontaminate(spark, clean, DATA))
    assert kept.where("doc_id = 9100").count() == 1
    parts = corpus_pipeline.pack(spark, kept, DATA).where("doc_id = 9100").collect()
    assert len(parts) == -(-parts[0].doc_tokens // 2048) > 10 and sum(p.length for p in parts) == parts[0].doc_tokens


def test_run_is_the_brute_force(spark):
    """All five stages on every document: which documents and texts are left, and their ids, one piece each; sequences are full and gapless."""
    from tokenizers import Tokenizer

    from sheaf.llm import decontaminate
    from sheaf.llm.queries import tokenizer_files

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    fps = {i: reference_fingerprint(t) for i, t in texts.items()}
    up = {i: i for i in fps}
    while (new := {i: min(up[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}) != up:
        up = new
    seen, left = set(), {}
    for i in sorted(i for i in up if up[i] == i):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        rest = bytes(x for x, g in zip(b, gone) if not g)
        if rest or not b:
            left[i] = rest
    tok = lambda t: decontaminate.WORD.findall(t.lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    items = [grams(tok(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    valid = {i: b.decode("utf-8", "replace") for i, b in left.items()}
    clean = {i: t for i, t in valid.items() if not any(sum(g in own for g in item) >= 0.8 * len(item) for own in [set(grams(tok(t)))] for item in items)}
    assert 0 < len(clean) < len(left) < len(texts)
    whole = Tokenizer.from_file(tokenizer_files()[0])
    want = set()
    for i, t in clean.items():
        if "\ufffd" not in t:
            ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4")
            want |= {(i, s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, DATA).collect()
    cut = {i for i, t in clean.items() if "\ufffd" in t}
    assert {r.doc_id for r in got} == set(clean)
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id not in cut} == want
    rows = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at: dict[int, int] = {}
    for sequence, offset, length in rows:
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length
    assert max(at.values()) <= 2048 and sum(at.values()) / (2048 * len(at)) > 0.9
