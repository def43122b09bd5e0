"""Sharding, WARC and nearest neighbours."""

import gzip
import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import ann, common, sharding, warc
from tidemill.llm.queries import queries


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, shard int, slot int, label string")


def check_shards(got, shards=8):
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert set(counts) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts.get(s, 0)))


def test_shards_of_the_documents(spark, sf_dir):
    got = queries()["op3_sharding"](spark, sf_dir).collect()
    check_shards(got)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    where = {}
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())  # no copies are cut here


def test_hot_group_fills_few_shards(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"pair {i // 4}" if i % 7 == 0 else f"text {i}") for i in range(4000)]
    got = sharding.shard(sharding.equal_texts(docs(spark, rows))).collect()
    check_shards(got)
    text = dict(rows)
    hot = Counter(r.shard for r in got if text[r.id] == "copy")
    assert sum(n for _, n in hot.most_common(3)) > 0.9 * sum(hot.values())  # a third of all rows needs three of eight shards


@pytest.mark.parametrize("paired", [4, 6, 10])
def test_pairs_stay_whole_beside_a_hot_group(spark, paired):
    """A third of the rows is one group; of every 15 rows, ``paired`` are members of pairs (10: no row is free)."""
    rows = [(i, "copy" if i % 3 == 0 else f"pair {i // 30} {i % 15}" if i % 15 in (1, 2, 4, 5, 7, 8, 10, 11, 13, 14)[:paired] else f"text {i}") for i in range(12_000)]
    got = sharding.shard(sharding.equal_texts(docs(spark, rows))).collect()
    check_shards(got)
    text, where = dict(rows), {}
    for r in got:
        where.setdefault(text[r.id], set()).add(r.shard)
    pairs = [s for t, s in where.items() if t.startswith("pair")]
    assert len(pairs) == 400 * paired
    assert sum(len(s) > 1 for s in pairs) <= (0 if paired < 10 else 28)  # without free rows, at most one for two shards


@pytest.mark.parametrize(
    "group, forced",
    [
        (lambda i: f"pair {i // 2}", 0),  # 500 pairs a shard
        (lambda i: f"five {i // 5}", 0),  # 200 groups a shard
        (lambda i: f"seven {i // 7}", 7),  # 1000 is no multiple of 7: an end of a shard cuts one
        (lambda i: "copy" if i % 3 == 0 else f"pair {i // 3}", 8),  # a third needs three shards; an end of a shard cuts one
    ],
)
def test_groups_are_cut_only_where_the_counts_force_it(spark, group, forced):
    rows = [(i, group(i)) for i in range(8000)]
    got = sharding.shard(sharding.equal_texts(docs(spark, rows))).collect()
    check_shards(got)
    text, where = dict(rows), {}
    for r in got:
        where.setdefault(text[r.id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= forced
    assert len(where.get("copy", ())) in (0, 3, 4)


def test_one_repeated_row_is_split(spark):
    """Rows that are equal in every column, id and all, are dealt like any others."""
    got = sharding.shard(sharding.equal_texts(docs(spark, [(1, "same")] * 900 + [(i, f"text {i}") for i in range(2, 1802)]))).collect()
    check_shards(got)
    assert len({r.shard for r in got if r.id == 1}) <= 4


def test_shard_edges(spark):
    rows = [(1, None), (2, None), (3, ""), (3, ""), (None, "a"), (None, "a"), (4, "b" * 100_000)]
    got = sharding.shard(sharding.equal_texts(docs(spark, rows))).collect()
    check_shards(got)
    assert sorted(r.size for r in got) == [1, 1, 1, 1, 2, 2, 100_001]
    assert sharding.shard(sharding.equal_texts(docs(spark, []))).count() == 0
    everything = sharding.shard(sharding.equal_texts(docs(spark, [(i, "same") for i in range(301)]))).collect()
    check_shards(everything)


# ---- WARC


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 5) for i, u, h in rows], "page_id long, url string, html string, digest string, offset int")


BIG = "<p>é</p>" * 200
ROWS = [(1, "http://a/1", BIG), (5, "http://a/5?x=a b\n", BIG), (3, None, BIG), (4, "http://b", "small"), (6, "http://c", "small"), (7, "http://d", None), (8, "", ""), (None, "http://e", BIG), (5, "http://a/5?x=a b\n", BIG), (9, "http://f", "\r\n\r\nWARC/1.1\r\n" * 200)]


def test_archives_hold_what_was_written(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = warc.write(pages(spark, ROWS), folder)
    assert index.count() == len(ROWS)
    got = warc.read(index, folder).collect()
    by_id = {r.page_id: r for r in got}
    assert {i: (r.record_type, r.refers_to) for i, r in by_id.items()} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None), 9: ("response", None), None: ("response", None)}
    for i, _, h in ROWS:
        assert by_id[i].digest == hashlib.sha1((h or "").encode()).hexdigest()
        if by_id[i].record_type == "response":
            assert bytes(by_id[i].payload) == (h or "").encode()
    heads = [head for f in index.select("file").distinct().collect() for head in gzip.GzipFile(fileobj=io.BytesIO((tmp_path / "warc" / f.file).read_bytes())).read().split(b"WARC/1.1\r\nWARC-Type: ")]
    ids = [line for head in heads for line in head.split(b"\r\n") if line.startswith(b"WARC-Record-ID: ")]
    assert len(ids) >= len(ROWS) and len(set(ids)) == len(ids)  # also where page ids repeat or lack
    some = warc.read(index.where("page_id in (4, 9)"), folder).collect()
    assert sorted(r.page_id for r in some) == [4, 9]
    # the files are gzip members that any reader can walk through, in the order of the index
    for f in index.select("file").distinct().collect():
        data = (tmp_path / "warc" / f.file).read_bytes()
        plain = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and plain.endswith(b"\r\n\r\n")
        ends = sorted((r.offset, r.offset + r.length) for r in index.where(F.col("file") == f.file).collect())
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[-1][1] == len(data)
    assert warc.read(warc.write(pages(spark, []), folder), folder).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_warc_of_hot_payloads(spark, tmp_path, monkeypatch, broadcast):
    """A third of all pages share one payload, a third are empty; one page id has two payloads."""
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "HOT", 5)
    rows = [(i, f"http://a/{i}", BIG if i % 3 == 0 else None if i % 3 == 1 else f"<p>{i}</p>") for i in range(300)]
    rows += [(500, "http://b", "x" * 1000), (500, "http://b", "y" * 2000), (400, "http://b", "x" * 1000), (401, "http://b", "y" * 2000)]
    path = str(tmp_path / "in")
    pages(spark, rows).write.parquet(f"{path}/pages.parquet")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op4_warc(spark, path).collect()), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = max(j for j, _, g in rows if g == h)
        revisit = len(data) >= 1000 and first != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_ranges_are_joined():
    rows = [("a", 0, 10, ""), ("a", 10, 5, ""), ("a", 15 + warc.GAP + 1, 5, ""), ("b", 0, 1, ""), ("b", 1, warc.READ, ""), ("b", 2 + warc.READ, 1, "")]
    assert [len(g) for g in warc._ranges(iter(rows))] == [2, 1, 1, 1, 1]


def test_small_tables_only_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    a = spark.range(3).withColumnRenamed("id", "k")
    assert "ResolvedHint" not in common.small(a)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in common.small(a.limit(2))._jdf.queryExecution().analyzed().toString()


# ---- nearest neighbours


def exact(ids, x, queries_, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries_:
        i = ids.index(q)
        s = unit @ unit[i]
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(float(s[j]), 12), ids[j]))[:k]
        out[q] = [(ids[j], float(s[j])) for j in order]
    return out


def test_recall_on_the_embeddings(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{big}/embeddings.parquet").collect()]
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    got = {}
    for r in queries()["op9_ann"](spark, big).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    asked = [i for i in ids if i % 50 == 0]
    want = exact(ids, x, asked, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    true = {q: dict(found) for q, found in exact(ids, x, asked, len(ids)).items()}
    for q, found in got.items():
        assert all(s == pytest.approx(true[q][i], abs=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def vectors_of(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x)], "vec_id long, embedding array<double>")


def test_meetings_are_those_of_the_codes(spark):
    """Every pair with a substring within the flips and the code within the radius, and so every code the pigeonhole promises."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    index = ann.fit_rotations(x, 256)
    index.bits, index.substrings, index.flips, index.radius = 6, 12, 1, 40
    signs = index.signs(x)
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cls long, vector array<double>")
    got = {tuple(r) for r in ann.meetings(classes, classes.where("cls < 40"), index).collect()}
    parts, want = signs[:, :72].reshape(300, 12, 6), set()
    for q in range(40):
        near = ((parts != parts[q]).sum(axis=2) <= 1).any(axis=1) & ((signs != signs[q]).sum(axis=1) <= 40)
        want |= {(q, int(j)) for j in np.flatnonzero(near) if j != q}
        promised = (signs != signs[q]).sum(axis=1) <= 12 * 2 - 1
        assert {(q, int(j)) for j in np.flatnonzero(promised) if j != q} <= want
    assert got == want


def test_calibration_reaches_its_target():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 24))
    index = ann.fit_rotations(x, 1024)
    q = rng.normal(size=(400, 24))
    near = q + rng.normal(size=(400, 24)) * 0.4
    index = ann.calibrate(index, q, near, 1_000_000, 20_000)
    a, b = index.keys(index.signs(q)), index.keys(index.signs(near))
    met = (np.bitwise_count(a ^ b) <= index.flips).any(axis=1)
    assert met.mean() >= ann.TARGET and index.bits >= 10
    random = (np.bitwise_count(a ^ index.keys(index.signs(x[:400]))) <= index.flips).any(axis=1)
    assert random.mean() < 0.25  # most rows aren't met


@pytest.mark.parametrize("broadcast", [True, False])
def test_neighbour_edges(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "HOT", 3)
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (1, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [0.0, 3.0]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [-1.0, 0.0]), (100, [1.0, 2.0, 4.0]), (150, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int")
    use = ann.usable(df)
    got = [tuple(r) for r in ann.search(use, use.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 2), (0, 2, 2), (0, 3, 3), (0, 4, 50), (0, 5, None), (50, 1, None), (50, 2, 0), (50, 3, 2), (50, 4, 2), (50, 5, 3), (100, 1, 9)]
    assert got[0][3] == 1.0 and got[3][3] == 0.0
    none = ann.usable(df.limit(0))
    assert ann.search(none, none).count() == 0
    one = ann.usable(df.where("vec_id = 50"))
    assert ann.search(one, one).count() == 0


def test_rows_that_share_an_id_are_rows(spark):
    use = ann.usable(spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [1.0, 0.01]), (8, [0.5, 0.5]), (0, [0.0, 5.0])], "vec_id long, embedding array<double>"))
    got = ann.search(use, use.where("vec_id = 0"), nearest=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 7), (0, 1, 7), (0, 2, 8), (0, 2, 8)]
    assert max(r.score for r in got) == 1.0 and sorted(r.score for r in got)[-2] == pytest.approx(0.99995, abs=1e-6)


@pytest.mark.parametrize("broadcast", [True, False])
def test_copies_come_in_the_order_of_their_ids(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(2)
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist()) for i in range(3000)]
    use = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = ann.search(use, use.where("vec_id in (0, 150, 9)")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [3, 6, 9, 12, 15, 0, 3, 6, 12, 15, 0, 3, 6, 9, 12]


@pytest.mark.parametrize("name", ["op4_warc", "op7_quality"])
def test_queries_against_duckdb(spark, sf_dir, name):
    import duckdb

    from tidemill.llm.queries import oracle_sql

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries()[name](spark, sf_dir)
    cursor = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(str(tuple(r)) for r in cursor.fetchall())
