"""Rules of threads, logs, plan rows, reports, links and ledgers on small cases, with columns of other names."""

from pyspark.sql import functions as F

from sheaf.functions import chat, labels
from sheaf.operators import graph, ledger, links, reports, threads
from sheaf.plans import retrieving


def test_threads_are_cut_where_events_start(spark):
    rows = [(1, "x/a.md", "before\nSubject: one\nFrom: A\nbody\nRE: two\nmore"), (2, "x/a.md", "plain\ntext"), (3, "x/[Teams] a.md", "RE: one\nRE: two"), (4, "x/a.md", "Họp daily tuần\n\nTừ: An\nx"), (5, "x/a.md", ""), (6, "x/a.md", "# RE: no\nTrang 2")]
    got = threads.event_blocks(spark.createDataFrame(rows, "doc_id long, path string, text string")).orderBy("doc_id", "block_no").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.body)
    assert by == {1: ["before", "Subject: one\nFrom: A\nbody", "RE: two\nmore"], 2: ["plain\ntext"], 3: ["RE: one\nRE: two"], 4: ["Họp daily tuần\n\nTừ: An\nx"], 5: [""], 6: ["# RE: no\nTrang 2"]}


def test_log_status_by_type(spark):
    cases = [("raid-log", None, "overdue item", "Overdue"), ("alerts", "", "x", "Cảnh báo"), ("decision-log", " ", "was superseded", "Superseded"), ("raid-log", None, "opened? no: enclosed", "Issue"), ("milestone-log", None, "Trễ", "Dời mốc"), ("adr", "[a] Chốt", "x", "chốt"), (None, None, None, "Ghi nhận")]
    rows = spark.createDataFrame([c[:3] for c in cases], "k string, d string, t string")
    assert [r[0] for r in rows.select(reports.log_status(F.col("k"), F.col("d"), F.col("t"))).collect()] == [c[3] for c in cases]


def test_numbers_that_stand_together_share_a_status(spark):
    rows = spark.createDataFrame([(1, "QLYC-1 / 2 late EK7 done"), (2, "none"), (3, "YC-5 a YC-5 b"), (4, None)], "doc_id int, text string")
    got = {(r.doc_id, r.key): r.body for r in reports.status_chunks(rows).collect()}
    assert got == {(1, "1"): "QLYC-1 / 2 late ", (1, "2"): "QLYC-1 / 2 late ", (1, "EK7"): "EK7 done", (3, "5"): "YC-5 a "}


def test_upload_intents(spark):
    asked = ["[ctx] review this", "file này", "trong tài liệu có gì", "profile có gì", "previewed", "", None, "nội dung này là gì"]
    rows = spark.createDataFrame([(x,) for x in asked], "m string")
    assert [r[0] for r in rows.select(chat.upload_intent(F.col("m"))).collect()] == [True, False, True, False, False, False, False, True]
    assert spark.createDataFrame([("[chg-111-11] see chg-222-22",)], "m string").select(chat.change_key(F.col("m"))).first()[0] == "CHG-222-22"


def test_links_over_any_table(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y"], "p", "2024-01-02"), (2, "a", ["x"], "q", "2024-02-02"), (3, "b", [], None, "2024-01-09"), (4, None, None, "p", "2024-01-01")], "k int, team string, tags array<string>, who string, day string")
    got = {(r.facet, r.value): r.n for r in links.facet_counts(rows, {"team": "team", "tag": "tags"}, 1).collect()}
    assert got == {("team", "a"): 2, ("tag", "x"): 2}
    top = {r.key: (r.n_docs, r.projects, r.latest) for r in links.link_map(rows, "tags", "team", "who", "who", "day").collect()}
    assert top == {"x": (2, ["a"], "2024-02-02"), "y": (1, ["a"], "2024-01-02")}
    near = links.related(rows.withColumn("people", F.array("who")), "k", 1, 5, "team", "tags", "people", "who", "day", "day").collect()
    assert [(r.k, r.score) for r in near] == [(2, 7), (4, 4), (3, 1)]
    assert links.related(rows, "k", 99, 5, "team", "tags", "tags", "who", "day", "day").count() == 0


def test_ledgers_over_any_table(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int"), spark.createDataFrame([("b", 3), ("c", 4), ("a", None)], "id string, n int")
    assert sorted(tuple(r) for r in ledger.upserted(old.where("id = 'b'").union(old.where("id = 'a'")), new.where("id <> 'a'"), "id", "n").collect()) == [("a", 1, "keep"), ("b", 3, "update"), ("c", 4, "insert")]
    known = spark.createDataFrame([(1, "i1", "k1"), (2, "i2", None), (3, None, "k3"), (4, None, "k3")], "t int, i string, k string")
    rows = spark.createDataFrame([("i2", "k1"), ("none", "k3"), (None, None)], "id string, key string")
    assert [(r.hit, r.via) for r in ledger.cascade(rows, known, "t", [("id", "i"), ("key", "k")]).orderBy(F.col("id").desc_nulls_last()).collect()] == [(3, "key"), (2, "id"), (None, "none")]
    files = spark.createDataFrame([("a", "h1", False), ("b", "h2", True), ("c", "h3", None)], "f string, h string, bad boolean")
    got = ledger.convert_ledger(files, spark.createDataFrame([("a", "h1"), ("b", "old")], "f string, h string"), "f", "h", F.col("bad"), F.col("f") == "c")
    assert {r.f: r.status for r in got.collect()} == {"a": "unchanged", "b": "error", "c": "needs_ocr"}


def test_placeholders_and_issues(spark):
    p = spark.createDataFrame([("Chưa triển khai", "x", "x", "x", "x"), ("chưa rõ", "", "Chưa rõ", "", "chưa chốt"), ("chưa rõ", "", "An", "", ""), ("Viết", "", "", "", "")], "t string, s string, p string, u string, d string")
    assert [r[0] for r in p.select(reports.placeholder(*(F.col(c) for c in "tspud"))).collect()] == [True, True, False, False]


def test_rules_fold_a_text_once(spark):
    """A fold that each phrase writes out again is done again for each of them."""
    d = spark.createDataFrame([("a", ["x"])], "text string, lines array<string>")
    text = F.col("text")
    rules = {
        "codes": (labels.process_codes(text), 1), "generic": (threads.generic(text), 1),
        "subject": (threads.line_subject(F.col("lines")), 1), "code": (labels.has_code(text), 1),
    }
    for name, (rule, n) in rules.items():
        plan = d.select(rule.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("translate(") == n, name


def test_headings_without_a_description_are_looked_through_once(spark):
    """Linear in the headings; the rules on small odd sections."""
    import time

    parts = ["### a/b\n## Purpose\n\n\n## Next\nx", "### a/b\n### REQ-A1 **Mô tả:** no\ntext\n**Mô tả:** yes **Mô tả:** twice\n### REQ-B\n### REQ-C\n**Mô tả:**\n\n next\n### REQ-D", "### a/b", "### \na/b\n**Given:** x"]
    rows = spark.createDataFrame(list(enumerate(parts)), "doc_id int, text string")
    got = {r.doc_id: (r.purpose, r.requirements) for r in reports.requirement_facts(rows).collect()}
    assert got == {0: ("## Next\nx", []), 1: ("", ["REQ-A1 **Mô tả:** no: yes **Mô tả:** twice", "REQ-B: next"])}

    def took(n):
        long = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("### a/b\n**Given:** x\n"), F.repeat(F.lit("### REQ-1 x\n"), n)).alias("text"))
        start = time.time()
        assert reports.requirement_facts(long).first().scenarios == ["x"]
        return time.time() - start

    took(100)
    small, large = took(3000), took(30_000)
    assert large < 12 * max(small, 0.5), (small, large)


def test_an_ontology_goes_to_the_relations(spark):
    rows = spark.createDataFrame([("DEPENDS_ON", "Part", "Supplier", i) for i in range(20)] + [("MADE_BY", "Part", "Person", 20)], "relation string, from_type string, to_type string, no int")
    kept, lost = graph.validated(rows.repartition(4, "no"), spark.createDataFrame([("DEPENDS_ON", "Part", "Supplier")], "relation string, from_type string, to_type string"))
    assert {r.no for r in kept.collect()} == set(range(20)) and [r.no for r in lost.collect()] == [20]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan, plan  # dealt by the kind of relation, all would be in one task


def test_entities_are_made_distinct_as_numbers(spark):
    _, ent = retrieving.relations(spark, "/root/testdata/sf0.001")
    keys = [x.split("[")[1] for x in ent._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert len(keys) == 2 and not [x for x in keys if "name" in x], keys
    assert ent.count() == ent.distinct().count()


def test_requirement_facts_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    """Texts that are blank or begin with a heading, and spaces that engines see in different ways."""
    import duckdb

    from sheaf.plans import threading

    texts = ["", " ", "\n", "\x0b", "\n##", "\n\n## x", " \r\n## x\ny", "##", "a\n##b", "x", "\U0001f600", "\x0ba\x0b", "a\x0b\n## b", "\x0b\n## b", "\xa0a\xa0", "a" * 95 + "\xa0" + "b" * 99, "a" * 159 + "\xa0b", "\u2003a\u3000\n", "\x85a\x85", "a \u2028"]
    d = str(tmp_path)
    rows = [(i, t, "en", "src1") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    want = duck.execute(threading.ORACLE["fn51_requirement_facts"]).fetchall()
    got = threading.QUERIES["fn51_requirement_facts"](spark, d).select("doc_id", "file", "purpose", "requirements", "scenarios").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 2 * len(texts)
