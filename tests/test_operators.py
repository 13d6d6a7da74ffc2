"""Operators that SQL does not check: fixtures with rows worked out by hand, properties and plans."""

import datetime
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.operators import chunking, filters, graph, index, joins, ranking, retrieval
from sheaf.sources import notes, payloads
from sheaf.streaming import events as streams

NOTES = {
    "_issues/TKA-1.md": "---\nsource: tracker\ndate: '2026-09-01'\nproject: alpha\nsensitivity: internal\n---\n## TKA-1 retry storm\n\nWorker retries without a limit, TKA-1.\n",
    "_chat/plan.md": "---\nsource: zalo-capture\ndate: 2026-09-02\nproject: alpha\n---\n## Decision\n\nTeam decided: cap retries at three for TKA-1.\n",
    "source-code/retry.md": "---\nsource: artifacts/retry.py\nconverted_at: 2026-09-03T10:00:00\nproject: alpha\n---\n## retry\n\ndef retry(): pass  # TKA-1\n",
    "plain.md": "no frontmatter here\n",
    "broken.md": "--- not closed\ntext\n",
    "blank.md": "   \n",
    "README.md": "not a note\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, body in NOTES.items():
        p = tmp_path / "notes" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return tmp_path / "notes"


def test_fold_tables_are_the_letters_without_marks():
    for marked, plain in ((text.MARKED, text.PLAIN), (text.OTHER_MARKED, text.OTHER_PLAIN)):
        assert "".join(ch for ch in unicodedata.normalize("NFD", marked) if unicodedata.category(ch) != "Mn") == plain


def test_fold_compat(spark):
    from sheaf.functions.compat import fold_compat

    rows = spark.createDataFrame([("Đường ﬁ ①",), (None,), ("",)], "t string").select(fold_compat("t").alias("x")).collect()
    assert [r.x for r in rows] == ["Duong fi 1", None, ""]


def test_notes(spark, tree):
    rows = {r.rel_path: r for r in notes.documents(notes.read_notes(spark, str(tree)), "t").collect()}
    assert set(rows) == {k for k in NOTES if k not in ("blank.md", "README.md")}
    r = rows["_issues/TKA-1.md"]
    assert (r.date, r.project, r.meta["source"], r.lines_before) == ("2026-09-01", "alpha", "tracker", 6)
    assert r.text.startswith("## TKA-1") and rows["source-code/retry.md"].date == "2026-09-03"
    assert rows["broken.md"].meta == {} and rows["broken.md"].text == NOTES["broken.md"]


def golden_chunks(spark, tree):
    d = notes.documents(notes.read_notes(spark, str(tree)), "t").where("project = 'alpha'")
    c = chunking.chunks(d).withColumnRenamed("chunk", "text")
    empty = F.array().cast("array<string>")
    meta = d.select("doc_id", F.col("rel_path").alias("source_path"), F.lit("").alias("section"), "project", F.lit("mom").alias("doc_type"), F.lit("chat").alias("source_channel"), F.lit("high").alias("reliability"), empty.alias("ticket_ids"), empty.alias("people"), F.lit("shared").alias("visibility"), "date")
    return c.join(meta, "doc_id")


def test_golden_question_reaches_every_pillar(spark, tree):
    q = spark.createDataFrame([(1, "TKA-1: why does it retry, what does the code do, what was decided?")], "question_id int, text string")
    c = golden_chunks(spark, tree)
    got = retrieval.hybrid(q, c, 20).join(c.select("chunk_id", "source_path"), "chunk_id").collect()
    assert {r.source_path.split("/")[0] for r in got} == {"_issues", "_chat", "source-code"}
    packed = retrieval.pack(retrieval.hybrid(q, c, 20), c).first()
    assert packed.n_blocks == 3 and packed.context.count("\n---\n") == 2


def test_hybrid_does_not_depend_on_partitions(spark, tree):
    q = spark.createDataFrame([(1, "retry limit TKA-1 decided")], "question_id int, text string")
    c = golden_chunks(spark, tree)
    a, b = (sorted(map(tuple, retrieval.hybrid(q, x, 20).collect())) for x in (c.repartition(1), c.repartition(5)))
    assert a == b


def test_rebuild_is_idempotent_and_drops_the_deleted(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(i, t, f"h{t}", "m") for i, t in r], "doc_id long, text string, content_hash string, meta_hash string")
    t = index.ChunkTable(spark, f"file://{tmp_path}/index")
    assert t.build(rows((1, "one"), (2, "two"), (3, "three"))) == {"changed": 3, "deleted": 0}
    before = sorted(map(tuple, t.all().collect()))
    assert t.build(rows((1, "one"), (2, "two"), (3, "three"))) == {"changed": 0, "deleted": 0}
    assert sorted(map(tuple, t.all().collect())) == before
    assert t.build(rows((1, "new"), (2, ""))) == {"changed": 2, "deleted": 1}
    assert [(r.doc_id, r.chunk) for r in t.all().collect()] == [(1, "new")]
    assert t.history().count() == 3
    t.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert t.all().count() == 0


def test_code_sections(spark):
    code = "import x\n\n@d\ndef f():\n    pass\n\nclass A:\n    y = 1\n    def g(self):\n        pass\n"
    rows = notes.code_sections(spark.createDataFrame([("a.py", code), ("b.py", "def ("), ("c.py", None)], "rel_path string, text string")).collect()
    assert [(r.rel_path, r.name, r.start_line, r.end_line) for r in rows] == [("a.py", "module", 1, 2), ("a.py", "f", 3, 5), ("a.py", "A", 7, 8), ("a.py", "A.g", 9, 10), ("b.py", "file", 1, 1)]


def test_code_scan_prunes(spark, tmp_path):
    for p in ("a.py", "pkg/b.py", ".git/c.py", "node_modules/d.py", "x.egg-info/e.py"):
        f = tmp_path / "code" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x = 1\n")
    assert {r.rel_path for r in notes.read_code(spark, str(tmp_path / "code")).collect()} == {"a.py", "pkg/b.py"}


def test_record_notes_are_a_snapshot(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, "t", "open", "high", "2026-01-01", "b") for i in ids], "item_id int, title string, status string, priority string, date string, body string")
    notes.write_notes(rows(1, 2), str(tmp_path / "out"))
    notes.write_notes(rows(2), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == ["item_id=2"]


def test_issues_and_attachments(spark):
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "text", "text": "b"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "c"}]}]}
    raw = [{"key": "K-1", "fields": {"summary": "s", "updated": "2026-01-02T03:04", "description": tree, "attachment": [{"filename": "x.PDF", "content": "u"}, {"filename": "y.bin", "content": "v"}]}}, {"key": "K-2", "fields": {}}]
    rows = payloads.issues(spark.createDataFrame([(json.dumps(r),) for r in raw], "value string"))
    got = {r.key: r for r in rows.collect()}
    assert got["K-1"].description == "a\nb\n\nc" and got["K-1"].date == "2026-01-02" and got["K-1"].status == "unknown"
    assert got["K-2"].assignee == "unassigned" and got["K-2"].description == ""
    assert [(r.filename, r.convertible) for r in payloads.attachments(rows).collect()] == [("x.PDF", True), ("y.bin", False)]


def test_wiki_pages(spark):
    raw = [{"id": "1", "type": "page", "title": "Kiến trúc: Notify!", "space": {"key": "S"}, "version": {"when": "2026-01-01T00"}, "body": {"storage": {"value": "<p>x</p>"}}}, {"id": "2", "type": "comment"}]
    r = payloads.wiki_pages(spark.createDataFrame([(json.dumps(x),) for x in raw], "value string")).collect()
    assert [(x.page_id, x.slug, x.html) for x in r] == [("1", "kiến-trúc-notify", "<p>x</p>")]


def test_page_tables_expand_spans(spark):
    html = "<h2>T</h2><p>one <b>two</b></p><script>no</script><table><tr><th>a</th><th colspan=2>b</th></tr><tr><td rowspan=2>1</td><td>2</td><td>3</td></tr><tr><td>4</td><td>5</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [(r.kind, r.level, r.text) for r in payloads.page_blocks(pages).collect()] == [("heading", 2, "T"), ("p", 0, "one two")]
    rows = {}
    for r in payloads.page_cells(pages).collect():
        rows.setdefault(r.row_no, {})[r.col_no] = r.text
    assert rows == {0: {0: "a", 1: "b", 2: "b"}, 1: {0: "1", 1: "2", 2: "3"}, 2: {0: "1", 1: "4", 2: "5"}}


def test_sections_cover_the_text(spark):
    body = "intro\n# A\nx\n\n## B\ny"
    s = chunking.sections(spark.createDataFrame([(1, body)], "doc_id long, text string")).orderBy("section_no").collect()
    assert "\n".join(r.body for r in s) == body and [r.heading for r in s] == ["", "A", "B"]


def test_alias_variants_quote_patterns(spark):
    reg = spark.createDataFrame([("C++ (x)", ["cpp"])], "canonical string, aliases array<string>")
    q = spark.createDataFrame([(1, "is C++ (x) up?")], "question_id int, text string")
    assert sorted(r.variant for r in joins.alias_variants(q, reg).collect()) == ["is C++ (x) up?", "is cpp up?"]


def test_budget_rules_differ(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 4)], "g string, o int, s int")
    assert [r.o for r in ranking.budget_stop(rows, ["g"], "s", "o", 10).collect()] == [1]
    assert sorted(r.o for r in ranking.budget_skip(rows, "g", "s", "o", 10).collect()) == [1, 3]


def test_guest_never_sees_the_owners_rows(spark):
    from sheaf.plans.binding import docs

    d = docs(spark, "/root/testdata/sf0.001")
    assert {r.visibility for r in filters.readable(d, True).select("visibility").distinct().collect()} == {"shared"}
    assert not retrieval.search(d, "the", True, 1000).join(d.where("visibility <> 'shared'"), "doc_id").count()


def test_filters_reach_the_scan_and_no_text_is_shuffled(spark):
    from sheaf.plans.binding import table

    plan = table(spark, "/root/testdata/sf0.001", "orders").where("o_orderkey > 10").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_k_hop_stops_on_an_empty_front(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("x", "r", "y")], "from_id string, relation string, to_id string")
    got = {(r.from_id, r.hop) for r in graph.k_hop(e, spark.createDataFrame([("a",)], "id string"), 9).collect()}
    assert got == {("a", 1), ("b", 2)}


@pytest.fixture
def event_files(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(hours=5 * i), i % 3, "ab"[i % 2], float(i), "{}") for i in range(40)]
    spark.createDataFrame([*rows, *rows[:5]], streams.EVENTS).coalesce(1).write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def drained(query_name, df, mode):
    q = df.writeStream.format("memory").queryName(query_name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(query_name)


def test_stream_and_batch_agree(spark, event_files):
    batch = spark.read.parquet(event_files).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = streams.read_events(spark, event_files)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(drained("m1", streams.distinct_messages(stream, "30 days").select("event_id"), "append")) == rows(batch.select("event_id").distinct())
    assert rows(drained("m2", streams.daily_usage(stream), "complete")) == rows(streams.daily_usage(batch))
    assert rows(drained("m3", streams.sliding_usage(stream), "complete")) == rows(streams.sliding_usage(batch))
    assert rows(drained("m4", streams.cursors(stream), "complete")) == rows(streams.cursors(batch))
    assert rows(drained("m5", streams.quota_charges(stream, 50.0), "append")) == rows(streams.quota_charges(batch, 50.0))
    assert rows(drained("m6", streams.thread_memory(stream), "update")) == rows(streams.thread_memory(batch))


def test_watch_rebuilds_changed_notes(spark, tree, tmp_path):
    t = index.ChunkTable(spark, f"file://{tmp_path}/watched")
    docs_of = lambda files: notes.documents(files, "t").select("doc_id", "text", "content_hash", "meta_hash")
    run = lambda: streams.upsert_documents(spark, str(tree), t, f"file://{tmp_path}/cp", docs_of).start().awaitTermination()
    run()
    n = t.all().count()
    (tree / "new.md").write_text("fresh\n")
    run()
    assert t.all().count() == n + 1


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = index.ChunkTable(spark, f"file://{tmp_path}/buckets", buckets=8)
    docs = lambda rows: spark.createDataFrame([(i, x, f"h{x}", "m") for i, x in rows], "doc_id long, text string, content_hash string, meta_hash string")
    first = t.build(docs([(i, f"text {i}") for i in range(100)]))
    assert first == {"changed": 100, "deleted": 0} and t.all().count() == 100
    before = t.current()[1]["chunks"]["at"]
    assert t.upsert(docs([(3, "new"), (4, "text 4")])) == {"changed": 1, "deleted": 0}
    after = t.current()[1]["chunks"]["at"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r.doc_id: r.chunk for r in t.all().where("doc_id in (3, 4, 5)").collect()} == {3: "new", 4: "text 4", 5: "text 5"}
    assert t.upsert(docs([(3, "new")]))["changed"] == 0 and t.current()[1]["chunks"]["at"] == after
    assert t.build(docs([(i, f"text {i}") for i in range(50)]))["deleted"] == 50 and t.all().count() == 50
    assert t.vacuum() > 0 and t.all().count() == 50 and t.history().count() == 4
    assert {r.doc_id for r in t.list(3).collect()} == {0, 1, 2} and t.list(doc_id=7).count() == 1
    q = spark.createDataFrame([(1, "text 7")], "question_id int, text string")
    assert t.search(q, 1, where="doc_id < 10").first().chunk_id == t.list(doc_id=7).first().chunk_id
    t.delete(docs([(7, "")]))
    assert t.list(doc_id=7).count() == 0 and t.all().count() == 49 and t.get(t.list(2).select("chunk_id")).count() == 2
    t.reset()
    assert t.all() is None


def test_an_embedder_can_be_given(spark):
    class Lengths:
        size = 1

        def attach(self, rows, text):
            return rows.withColumn("embedding", F.array(F.length(text).cast("float")))

    rows = spark.createDataFrame([(1, "abc")], "doc_id int, chunk string")
    assert index.attach_vectors(rows, Lengths()).first().embedding == [3.0] and len(index.attach_vectors(rows, 8).first().embedding) == 8


def test_graph_table_verbs(spark, tmp_path):
    g = index.GraphTable(spark, f"file://{tmp_path}/graph", buckets=4)
    assert g.nodes().count() == g.edges().count() == 0
    edge = "from_id string, relation string, to_id string, doc_id string"
    g.upsert(spark.createDataFrame([("a", "Person", "A"), ("a", "Person", "A"), ("b", "System", "B")], "node_id string, type string, name string"), spark.createDataFrame([("a", "USES", "b", "1"), ("a", "USES", "b", "2"), ("b", "USES", "c", "2")], edge))
    g.upsert(nodes=spark.createDataFrame([("a", "Person", "new")], "node_id string, type string, name string"))
    assert sorted((r.node_id, r.name) for r in g.nodes().collect()) == [("a", "new"), ("b", "B")] and g.edges().count() == 3
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r.from_id, r.hop) for r in g.k_hop(seeds, 2).collect()} == {("a", 1), ("b", 2)}
    g.delete(spark.createDataFrame([("2",)], "doc_id string"))
    assert [(r.from_id, r.doc_id) for r in g.edges().collect()] == [("a", "1")]
    g.reset()
    assert g.edges().count() == 0


def test_sources_union_survives_a_failure(spark, tmp_path):
    from sheaf.sources import registry

    rows = lambda: spark.createDataFrame([(1, "x")], "doc_id int, text string")
    out, failed = registry.union_sources({"notes": rows, "gone": lambda: spark.read.text(f"{tmp_path}/nowhere"), "code": lambda: rows().drop("text")})
    assert sorted((r.origin, r.text) for r in out.collect()) == [("code", None), ("notes", "x")] and set(failed) == {"gone"}


def test_converters_by_extension(spark):
    from sheaf.sources import registry

    known = registry.standard_converters()
    known.register("upper", "up")(lambda files: files.select("path", F.upper(F.col("content").cast("string")).alias("text")))
    files = spark.createDataFrame([("a.md", b"x"), ("b.HTML", b"<p>y</p>"), ("c.up", b"z"), ("d.bin", b"\0"), ("e.txt", b" ")], "path string, content binary")
    got = {r.path: (r.text, r.converter, r.status) for r in known.convert(files).collect()}
    assert got == {"a.md": ("x", "text", "ok"), "b.HTML": ("y", "html", "ok"), "c.up": ("Z", "upper", "ok"), "d.bin": (None, None, "unsupported"), "e.txt": (" ", "text", "empty")}


def test_lanes_in_a_registry(spark):
    from sheaf.sources import registry

    lanes = registry.Lanes()
    for n, day in (("alerts", "02/01/2024"), ("raid", "01/01/2024"), ("adr", "none")):
        lanes.register(n)(lambda s, d=day: s.createDataFrame([(d, "t", "b")], "date_text string, title string, body string"))
    assert [r.lane for r in lanes.timeline(spark).collect()] == ["raid", "alerts", "adr"]
    assert [r.lane for r in lanes.timeline(spark, "alerts").collect()] == ["alerts"]
    with pytest.raises(KeyError):
        lanes.timeline(spark, "nope")


def test_views_give_sql_access(spark):
    from sheaf.plans import views

    assert views.register(spark, "/root/testdata/sf0.001", "ag1_facet_counts") == ["ag1_facet_counts"]
    assert spark.sql("SELECT count(*) FROM ag1_facet_counts").first()[0] > 0 and spark.sql("SELECT count(*) FROM docs WHERE visibility = 'shared'").first()[0] > 0


def test_clamp_of_limits(spark):
    assert [ranking.clamp(x) for x in (-5, 0, 7, 500, None)] == [1, 1, 7, 100, 20]


def test_process_rules_and_statuses(spark):
    from sheaf.functions import labels
    from sheaf.operators import reports

    q = ["Tiếp nhận yêu cầu", "what of QT IT 005?", "qtit019 and UAT", "nothing", "fast  lane golive"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in q], "t string").select(labels.process_codes(F.col("t"))).collect()]
    assert got == [["QT.IT.005"], ["QT.IT.005"], ["QT.IT.009", "QT.IT.019"], [], ["QT.IT.005", "QT.IT.019"]]
    t = ["On-hold, cancelled", "blocked and hoàn thành", "Done", "is done", "ready UAT", "chưa có", "x"]
    rows = spark.createDataFrame([(x,) for x in t], "t string")
    assert [r[0] for r in rows.select(reports.text_status(F.col("t"), F.lit(False), F.lit(False), F.lit("late"))).collect()] == ["cancelled", "blocked", "late", "done", "progress", "open", "late"]
    assert [r[0] for r in rows.select(reports.manual_status(F.col("t"))).collect()] == ["onhold", "blocked", None, None, "progress", "open", None]
    s = ["[Done] x", "golive", "<b>done</b>", "đầu mối plan", "on hold &amp; done", "hoàn thành"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in s], "t string").select(labels.workflow_status(F.col("t"))).collect()] == ["Đang xử lý", "—", "Hoàn thành", "—", "Blocked", "Hoàn thành"]


def test_retrieval_has_no_nested_loop_and_blocks_agree(spark):
    from sheaf.plans import retrieving

    d = "/root/testdata/sf0.001"
    for name in ("jn4_rt1_exact_retrieval", "jn4_rt2_keyword_retrieval", "rt4_term_frequency"):
        plan = retrieving.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.where("vec_id < 40").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))
    one, many = (sorted(map(tuple, retrieval.vectors(q, e, 3, block=b).collect())) for b in (1000, 7))
    assert one == many and len(one) == 120


@pytest.mark.parametrize("few", [100, 0])
def test_terms_are_found_as_parts_of_words(spark, monkeypatch, few):
    """By brute force: a term is in a field when it is in its text, however many terms there are."""
    monkeypatch.setattr(retrieval, "FEW", few)
    words = ["ab", "abc", "xabcx", "b", "tkt-3", "src2/en/doc-42.md", "é"]
    rows = spark.createDataFrame([(i, f"{words[i % 7]} {words[(i * 3) % 7]} z{i}") for i in range(40)], "id int, t string")
    terms = spark.createDataFrame([(x,) for x in ("a", "ab", "abc", "kt-3", "doc-42", "z1", "é", "none")], "term string")
    p = retrieval.postings(rows, ["id"], {"t": F.col("t")})
    got = {(r.term, r.id) for r in retrieval.held_by(terms, p).join(p, "token").select("term", "id").collect()}
    assert got == {(t.term, r.id) for t in terms.collect() for r in rows.collect() if t.term in r.t}


def test_chunks_carry_no_document(spark):
    """What is exploded is a chunk or a section with its labels, and long texts are cut exactly."""
    body = "".join(chr(97 + i % 26) for i in range(9001)) + "đ\U0001f600"
    d = spark.createDataFrame([(1, body, "x"), (2, "", "y"), (3, "ab", "z")], "doc_id long, text string, lang string")
    for size, overlap in ((2048, 256), (100, 60), (50, 0), (7, 6)):
        got = [(r.start, r.chunk) for r in chunking.chunks(d.where("doc_id = 1"), size, overlap, ("lang",)).orderBy("chunk_index").collect()]
        step = size - overlap
        n = 1 if len(body) <= size else -(-(len(body) - size) // step) + 1
        assert got == [(i * step, body[i * step : i * step + size]) for i in range(n)]
    for df in (chunking.chunks(d, keep=("lang",)), chunking.sections(d)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        kept = next(x for x in plan.split("\n") if "Generate posexplode" in x)
        assert "false, [" in kept or "true, [" not in kept
        assert not any(w in ("text", "lines") for w in df.columns)


def test_nearest_event_is_the_brute_force(spark):
    import random

    rng = random.Random(3)
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(40))
    rows = [(i, rng.choice("ab"), day()) for i in range(80)] + [(900, "c", day()), (901, "a", None)]
    events = [(i, rng.choice("ab"), day()) for i in range(12)]

    def best(g, d):
        def key(e):
            gap = (e[2] - d).days
            tier = 0 if gap == 0 else 1 if abs(gap) == 1 else 2 if gap < 0 else 3
            return tier, abs(gap), e[0]

        return min((e for e in events if e[1] == g), key=key, default=None)

    got = {r.id: r.event_id for r in joins.nearest_event(spark.createDataFrame(rows, "id int, g string, day date"), spark.createDataFrame(events, "event_id int, g string, event_day date"), "g").collect()}
    assert got == {i: best(g, d)[0] for i, g, d in rows if d and best(g, d)}


def test_fuzzy_titles_are_the_brute_force(spark):
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)] + ["hot"] * 20
    draw = lambda: sorted({rng.choice(words) for _ in range(rng.randint(1, 6))})
    a, b = [(i, draw()) for i in range(120)] + [(500, [])], [(i, draw()) for i in range(120)]
    for least in (0.3, 0.6, 1.0):
        want = {}
        for i, x in a:
            scores = [(-round((k := len(set(x) & set(y))) / (m := min(len(x), len(y))) + 0.2 * (k == m), 9), j) for j, y in b if x and set(x) & set(y)]
            if scores and -min(scores)[0] >= least:
                want[i] = min(scores)[1]
        got = joins.fuzzy_titles(spark.createDataFrame(a, "id int, tokens array<string>"), spark.createDataFrame(b, "id int, tokens array<string>"), least)
        assert {r.left_id: r.right_id for r in got.collect()} == want


def test_sheets_are_cut_where_a_text_lies(spark):
    """Texts of one doc_id do not mix, only items are shuffled, and odd breaks, blank lines and repeats in other letters are as before."""
    a = "x\ty\n=== Sheet: 1_A ===\nnote\nTitle\tDescription\tQuarter\nlost\nOne\tfirst\r\n more \n\n  \nrest\n\tno title\nTổng sum\t9\nTwo\tb\tQ1\textra\none\tFIRST \nmore\nrest\n"
    b = "=== Sheet: B ===\tTitle\n===Sheet: title\tmô tả===\nOne\tof b"
    docs = spark.createDataFrame([(1, a), (1, b), (2, None)], "doc_id long, text string")
    got = payloads.tab_sheets(docs)
    assert sorted((r.doc_id, r.sheet, r.title, r.description) for r in got.collect()) == [
        (1, "A", "A - One", "first\nmore\nrest"), (1, "A", "A - Two", "Kỳ: Q1 extra. b"), (1, "title\tmô tả", "title\tmô tả - One", "of b")]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "hashpartitioning(doc_id#" not in plan.replace(" ", "") and plan.count("Generate posexplode") == 2


def test_traversals_do_not_make_all_edges_distinct(spark, monkeypatch):
    """The queries hand on edges as they come; repeated edges are met once."""
    from sheaf.plans import retrieving

    given = []
    monkeypatch.setattr(graph, "k_hop_each", lambda e, seeds, hops: given.append(e) or e)
    retrieving.jn12_each(spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.undo()
    e = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c")] * 3, "from_id string, relation string, to_id string")
    got = graph.k_hop_each(e, spark.createDataFrame([(1, "a"), (2, "c")], "question_id int, id string"), 2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", "R", "b", 1), (1, "b", "R", "c", 2), (2, "a", "R", "b", 2), (2, "b", "R", "c", 1)]
