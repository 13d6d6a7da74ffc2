"""Operators 11 to 13 against brute force, and nulls, empty tables, ties, repeats, hot keys and odd columns."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sheaf.llm")
from sheaf.llm import alignment, caps, negatives, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
DDL = "vec_id long, embedding array<float>, label int, score double, rank int, kept string, node long, v string"


def table_of(spark, rows):
    """Vectors with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, v, label, 0.5, 7, "x", 1, "y") for i, v, label in rows], DDL)


def vectors_of(rng, n, width=16):
    x = rng.standard_normal((n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")


def odd(width=16):
    e = [0.0] * width
    one = [1.0] + e[1:]
    return [(9001, None, 1), (9002, [], 1), (9003, e, 2), (9004, [float("nan")] + e[1:], 2), (9005, [None] + e[1:], 3), (9006, [float("inf")] + e[1:], 3), (None, one, 1), (9007, [1.0], 1), (9008, one, None), (9009, one, 1), (9009, one, 1), (9010, [1e30] + e[1:], 1), (9011, [-0.0] + one[1:], 1)]


def brute_links(rows, least=0.9):
    ok = [(i, np.array(v + [0.0] * (16 - len(v)))) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for _, v in ok])
    x = x / abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    root = np.arange(len(ok))
    ids = np.array([i for i, _ in ok])
    least_id = ids.copy()
    while True:
        new = np.array([least_id[row].min() for row in near])
        if (new == least_id).all():
            break
        least_id = new
    del root
    return sorted(zip(ids.tolist(), (near.sum(axis=1) - 1).tolist(), least_id.tolist(), strict=True))


@pytest.mark.parametrize(("block", "share"), [(4096, 1 / 256), (40, 1 / 8), (40, 2.0)])
def test_near_vectors_are_the_brute_force(spark, monkeypatch, block, share):
    """Tight and loose clusters, chains, copies and multiples: with dense spots and without, with full filters cut into blocks."""
    monkeypatch.setattr(caps, "BLOCK", block)
    monkeypatch.setattr(caps, "SHARE", share)
    rng = np.random.default_rng(1)
    centre = vectors_of(rng, 4)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors_of(rng, 300))]
    for k, (noise, n) in enumerate(((0.03, 150), (0.08, 120), (0.12, 60), (0.2, 60))):
        rows += [(1000 * (k + 1) + j, (centre[k] + noise * rng.standard_normal(16)).astype("f4").tolist(), 0) for j in range(n)]
    rows += [(5000 + j, rows[j % 3][1], 0) for j in range(200)] + [(5500 + j, [2 * x for x in rows[310 + j][1]], 0) for j in range(20)]
    rows += odd()
    got = caps.near_vectors(table_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_links(rows)
    valid = {i for i, *_ in want}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in valid) == want
    assert sum(n for _, n, _ in want) > 20_000
    for r in got:
        if r.vec_id not in valid:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept == (None if r.vec_id is None else True)
        else:
            assert r.kept == (r.vec_id == r.component_id)


def test_a_hot_cluster_makes_no_pairs(spark):
    """A third of the rows within the threshold of each other: linked as a whole, with rows in proportion to the table."""
    rng = np.random.default_rng(2)
    hot = vectors_of(rng, 1, 64)[0]
    rows = [(i, (hot + 0.01 * rng.standard_normal(64)).astype("f4").tolist() if i % 3 == 0 else vectors_of(rng, 1, 64)[0].tolist(), 0) for i in range(3000)]
    got = {r.vec_id: r for r in caps.near_vectors(table_of(spark, rows)).collect()}
    assert all(got[i].n_links == 999 and got[i].component_id == 0 for i in range(0, 3000, 3))
    centres = caps.spots(caps.unit([np.array(v, "<f4").tobytes() for _, v, _ in rows], "<f4"), np.arccos(0.9) / 2 - caps.SLACK)
    assert len(centres) == 1 and (centres @ hot > 0.99).all()


@pytest.mark.parametrize("width", [1, 2, 3, 5, 40])
def test_filters_meet_in_any_dimension(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors_of(rng, 400, width))]
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()
    got = {r.vec_id: r.n_links for r in caps.near_vectors(table_of(spark, rows)).collect()}
    assert [got[i] for i in range(400)] == want


def test_decoding_finds_every_filter_exceeded():
    rng = np.random.default_rng(3)
    c = caps.Caps(50_000, 24, 0.9)
    x = vectors_of(rng, 30, 24).astype(float)
    row, f = c.decode(x)
    got = set(zip(row.tolist(), f.tolist(), strict=True))
    assert len(got) == len(row)
    want = set()
    for k in range(caps.CODES):
        y = x @ c.turns[k]
        for code in range(c.words**c.blocks):
            digits = [code // c.words ** (c.blocks - 1 - b) % c.words for b in range(c.blocks)]
            s = sum(y[:, lo:hi] @ w[:, n] for (lo, hi), w, n in zip(c.cuts, c.codes[k], digits, strict=True))
            want |= {(int(i), k * c.words**c.blocks + code) for i in np.flatnonzero(s >= c.height)}
    assert got == want


def test_links_at_the_threshold_are_told_without_rounding():
    x, y = np.array([1.0, 0.0], "<f8").tobytes(), np.array([0.9, np.sqrt(1 - 0.81)], "<f8").tobytes()
    assert caps.exact(x, y, "<f8") == pytest.approx(0.9, abs=1e-15)


# -- hard negatives ------------------------------------------------------------------------------


def sql_of(sql, rows):
    con = duckdb.connect()
    names = [x.split()[0] for x in DDL.split(", ")]
    con.register("t", pa.table({n: pa.array([(i, v, label)[k] for i, v, label in rows], t) for k, (n, t) in enumerate(zip(names, (pa.int64(), pa.list_(pa.float32()), pa.int32()), strict=False))}))
    con.execute("CREATE VIEW embeddings AS SELECT * FROM t")
    return sorted(con.execute(sql).fetchall(), key=str)


def shifted():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize(("page", "tile"), [(64, 4096), (3, 10)])
def test_hard_negatives_are_the_sql(spark, monkeypatch, page, tile):
    """Ties, copies by the hundred, clusters, equal ids with other vectors, odd rows; many small pages and few large ones."""
    monkeypatch.setattr(negatives, "PAGE", page)
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "AT_ONCE", 20)
    rng = np.random.default_rng(4)
    centre = vectors_of(rng, 5)
    rows = [(i, (centre[i % 5] * (i % 2) + 0.5 * rng.standard_normal(16)).astype("f4").tolist(), int(rng.integers(0, 10))) for i in range(600)]
    rows += [(1000 + i, rows[3][1], i % 2) for i in range(300)] + [(2000 + i, rows[50][1], 4) for i in range(40)]
    rows += [(50, rows[7][1], 3), (100, rows[100][1], rows[100][2])] + odd()[:-2]
    got = negatives.hard_negatives(table_of(spark, rows), shift=shifted()).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    rows = [(i, None if v is None else v + [0.0] * (16 - len(v)) if len(v) else v, label) for i, v, label in rows]
    rows = [r for i, r in enumerate(rows) if r[0] != 50 or i == 50]  # equal ids with other vectors: below
    want = sql_of(queries.OP12_SQL, rows)
    assert sorted((tuple(r) for r in got.where("anchor_id <> 50 and positive_id <> 50 and negative_id <> 50").collect()), key=str) == [r for r in want if 50 not in (r[0], r[1], r[3])]
    assert len(want) > 150


def test_hard_negatives_in_several_blocks_of_anchors(spark, monkeypatch):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    rows = [(i, v, label) for i, v, label in rows] + [(10_000 + 50 * i, v, label) for i, v, label in rows[:60]]
    one = sorted((tuple(r) for r in negatives.hard_negatives(table_of(spark, rows), shift=shifted()).collect()), key=str)
    monkeypatch.setattr(negatives, "BLOCK", 16 * 256)
    many = sorted((tuple(r) for r in negatives.hard_negatives(table_of(spark, rows), shift=shifted()).collect()), key=str)
    assert one == many and one
    assert sorted((r[0], r[1], r[2], r[3], r[4], r[5]) for r in one) == sorted(sql_of(queries.OP12_SQL, rows))


def test_pruned_boxes_hold_nothing_wanted():
    """A box is left out only if no row in it can count."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, a = rng.integers(-9, 9, (8, 4)), rng.integers(-9, 9, 4)
        score = x @ a
        low, high = x.min(0), x.max(0)
        top, bottom = np.maximum(a * low, a * high).sum(), np.minimum(a * low, a * high).sum()
        lo, hi = sorted(rng.integers(-200, 200, 2).tolist())
        kth = float(rng.integers(-200, 200))
        hope = negatives.hopes(np.array([top]), np.array([bottom]), np.array([lo]), np.array([hi]), np.array([kth]))[0]
        wanted = score[(score >= lo) & (score <= hi) & (score >= kth)]
        assert not len(wanted) or hope >= wanted.max()


def test_a_page_is_multiplied_with_many_anchors_at_once():
    """512 anchors and 100 pages: a page is read some times a round, not once an anchor; the rows found are those of brute force."""

    class Pages(list):
        reads = 0

        def __getitem__(self, n):
            self.reads += 1
            return super().__getitem__(n)

    rng = np.random.default_rng(6)
    x, label = rng.integers(-300, 300, (6400, 8)).astype("<i4"), np.repeat(np.arange(4), 1600)
    pages = Pages(np.split(x, 100))
    low, high, ids = np.array([p.min(0) for p in pages]), np.array([p.max(0) for p in pages]), np.arange(6400)
    at = rng.choice(6400, 512, replace=False)
    lo, hi = np.tile([1.0, 20_000.0, 1.0], (512, 1)), np.tile([90_000.0, 40_000.0, 0.0], (512, 1))
    anchors, best = negatives.Anchors(ids[at], label[at], x[at], lo, hi), negatives.Best(512, 3, 3)
    negatives.search(anchors, best, label[::64], low, high, np.split(ids, 100), pages, False)
    want, score = [], x[at].astype(np.int64) @ x.T.astype(np.int64)
    for a in range(512):
        for w in range(3):
            ok = np.flatnonzero((label != label[at[a]]) & (score[a] >= lo[a, w]) & (score[a] <= hi[a, w]))
            want += [(a, w, i, score[a, i]) for i in ok[np.lexsort((ok, -score[a, ok]))[:3]]]
    assert sorted(zip(*(c.tolist() for c in best.held(slice(None))), strict=True)) == sorted(want)
    assert pages.reads <= 100 * 4 * 2


def test_components_too_large_for_a_long_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1e300 / 1e270, 0.0], 1), (3, [1.0, 1.0], 2)]
    assert [tuple(r)[:2] for r in negatives.hard_negatives(table_of(spark, rows)).collect()] == [(0, 1)]


# -- alignment -----------------------------------------------------------------------------------


def files():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"), p.path("byte_bpe_50k.tiktoken")


TEXTS = ["Hello  world, this is a test.", "xin chào các bạn\n\tđây là tiếng Việt", "", None, " ", "<|endoftext|> and <s> are text", "emoji 👍🏽 und ß", "a" * 5000, "word " * 4000, "\x00\x01 control \r\n", "▁ is a piece's space", "𝒳 rare 汉字 한국어 العربية", "Hello  world, this is a test.", "don't we'll 123 4567 ...!?", " no-break space"]


def walked(texts):
    """Both cuts walked side by side, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_file, b_file, _ = files()
    t = Tokenizer.from_file(a_file)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=b_file)
    char = alignment.byte_level()
    name = {i: bytes(char[c] for c in s) for s, i in t.get_vocab().items() if i != 50256}
    out, count = [], Counter()
    for x in texts:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        whole = b"" if not x else b" " + x.encode()
        left = [name[i] for i in a]
        right = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(left) != whole or b"".join(right) != whole or not x:
            out.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(y) for y in left]).tolist(), np.cumsum([len(y) for y in right]).tolist()
        links, groups, ga, gb, i, j = [], [], [a[0]], [b[0]], 0, 0
        while True:
            links.append((a[i], b[j]))
            da, db = ends_a[i] <= ends_b[j], ends_b[j] <= ends_a[i]
            if da and db:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                ga, gb = [], []
            i, j = i + da, j + db
            if i == len(a):
                break
            ga += [a[i]] if da else []
            gb += [b[j]] if db else []
        out.append((a, b, groups, links))
        count.update(set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(len(a), len(b), len(g), len(k), sum(count[p] == best[p[0]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, k in out]


@pytest.mark.parametrize("chunk", [2_000_000, 3000, 1])
def test_alignment_is_the_walk(spark, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    docs = spark.createDataFrame([(i, x, 5, "a", "b", 1) for i, x in enumerate(TEXTS)] + [(None, "no id", 5, "a", "b", 1)], "doc_id long, text string, n_a int, x string, lane string, chunk int")
    got = alignment.aligned(docs, *files()).collect()
    key = lambda r: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
    want = walked([*TEXTS, "no id"])
    assert {r.doc_id: key(r) for r in got} == dict(zip([*range(len(TEXTS)), None], want, strict=True))
    assert sum(w[0] == 0 for w in want) == 3  # null, empty, and a text that B does not give back


def test_alignment_of_a_table_and_by_the_tokenizer_itself(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b, ranks = files()
    rows = docs.orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in alignment.aligned(docs, a, b, ranks).collect())
    assert [r[1:] for r in got] == walked([r.text for r in rows])
    assert got == sorted(tuple(r) for r in alignment.aligned(docs, a, b).collect())


def test_ranks_and_tokenizer_cut_every_character_alike():
    a, b, ranks = files()
    fast, slow = alignment.tokenizers(a, b, ranks)[0], alignment.tokenizers(a, b)[0]
    for c in [*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x11000, 0x110000, 97)]:
        x = chr(c)
        s = f" x{x}y {x}1{x} {x}{x}. {x}"
        assert fast(s) == slow(s), hex(c)


def test_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 1000, 60_000):
        keys = np.unique(rng.integers(0, 1 << 36, n))
        h = alignment.PerfectHash.load(alignment.PerfectHash.of(keys).dump())
        assert sorted(h.verified(keys).tolist()) == list(range(len(keys)))
        if n:
            with pytest.raises(ValueError, match="missing"):
                h.verified(np.array([keys[-1] + 1]))


@pytest.mark.parametrize("run", [lambda s: caps.near_vectors(table_of(s, [])), lambda s: negatives.hard_negatives(table_of(s, [])), lambda s: alignment.aligned(s.createDataFrame([], "doc_id long, text string"), *files())])
def test_empty_tables_give_no_rows(spark, run):
    assert run(spark).count() == 0
