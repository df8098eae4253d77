"""Near duplicates, neighbours and mixing against plain versions."""

from __future__ import annotations

import heapq
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import dedup, minhash, mixing, neighbours, queries
from noticelake.llm.queries import QUERIES
from tests import oracle
from tests.llm import helpers as H


def classes(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("large", [dedup.LARGE, 1])
def test_components_match_brute_force(spark, large):
    r = random.Random(3)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.randint(6, 120))] for _ in range(40)]
    common = [f"c{k}" for k in range(50)]
    rows = []
    for k in range(260):
        w = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            w[r.randrange(len(w))] = f"z{r.randint(0, 999)}"
        rows.append((k, " ".join(common + w if k % 2 else w)))
    got = {x.doc_id: x.component_id for x in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), large=large).collect()}
    assert got == classes(rows)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{H.DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {x.doc_id: x.component_id for x in QUERIES["op8_minhash_near_dedup"](spark, H.DATA).collect()}
    assert got == classes(rows)


def test_dedup_edges(spark):
    got = dedup.near_duplicates(H.edge(spark)).collect()
    assert len(got) == len(H.TEXTS)
    by = {x.doc_id: x for x in got}
    assert by[5].component_id == by[6].component_id == 4 and by[10].component_id == 7 and not by[5].kept
    assert by[1].n_shingles == by[3].n_shingles == 0 and by[3].kept and by[None].component_id is None and by[None].kept
    assert dedup.near_duplicates(H.empty(spark)).collect() == []


def test_an_original_is_the_centre_of_its_copies(spark, monkeypatch):
    """60 copies whose ids are smaller than their original's: they are compared with it, not with one another."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    copies = [" ".join("x" + w + str(n) if k in cut else w for k, w in enumerate(words)) for n in range(60) for cut in [set(r.sample(range(400), 11))]]
    rows = [(n, t) for n, t in enumerate(copies)] + [(1000, " ".join(words))]
    compared, verified = [], dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda pairs, sets: compared.append(pairs.count()) or verified(pairs, sets))
    got = {x.doc_id: x.component_id for x in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) and set(got.values()) == {0}
    assert sum(compared) <= 61


def test_chains_and_words_with_a_pattern(spark):
    """A chain of revisions is one class; two long words with nothing in common are two."""
    w, rows = [f"r{k}" for k in range(120)], []
    for k in range(30):
        w[4 * k : 4 * k + 2] = [f"v{k}", f"v{k}x"]
        rows.append(((k * 17) % 30, " ".join(w)))
    thue = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    rows += [(100, thue), (101, thue.translate(str.maketrans("ab", "ba")))]
    got = {x.doc_id: x.component_id for x in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) and got[100] != got[101]


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
    for share in (0.2, 0.8):
        n = int(len(a) * share)
        b = np.unique(np.concatenate([a[:n], r.integers(0, 2**63, len(a) - n).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.sketch(a) == minhash.sketch(b)).mean() - true) < 0.12
    assert (minhash.sketch(a[:1]) > 0).all()


def test_neighbours_by_groups_chunks_and_parts(spark, monkeypatch):
    """Two levels of centroids, lists of several chunks and parts, extra columns; recall against brute force."""
    for name, value in (("DIRECT", 8), ("CHUNK", 40), ("PART", 5), ("LEAST_READ", 12)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(3)
    x = (r.normal(size=(12, 6))[r.integers(0, 12, 3000)] + 0.3 * r.normal(size=(3000, 6))).round(4)
    rows = [(k, v.tolist(), 1, "x", 0) for k, v in enumerate(x)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, v string, q int"), every=30).collect()
    hits = 0
    for q in range(0, 3000, 30):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert len({g.vec_id for g in mine}) == 10 and all(g.score == d[g.vec_id] for g in mine)
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {g.vec_id for g in mine})
    assert hits >= 0.9 * 1000


def test_neighbours(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(700, 8)).round(3)
    x[400:650] = x[400]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [None] + [1.0] * 7), (None, [1.0] * 8)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    hits = total = 0
    for q in range(0, 700, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(700), d))[:10].tolist()
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in mine] == list(range(1, 11))
        assert all(g.score == pytest.approx(d[g.vec_id], abs=0) for g in mine)
        hits, total = hits + len(set(want) & {g.vec_id for g in mine}), total + 10
    assert {g.query_id for g in got} == set(range(0, 700, 100)) and hits / total >= 0.9
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []
    few = neighbours.search(spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(g.query_id, g.vec_id, g.score) for g in few] == [(0, 7, 1.0)]


@pytest.mark.parametrize("kind", ["no clusters", "far from the origin", "all scales"])
def test_neighbours_of_other_rows(spark, monkeypatch, kind):
    """Whatever the rows are like, as many lists are read as recall asks for."""
    for name, value in (("DIRECT", 8), ("LEAST_READ", 4)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 16))
    x = {"no clusters": x, "far from the origin": x + 1e8, "all scales": x * np.exp(2 * r.normal(size=(3000, 1)))}[kind]
    got = neighbours.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), every=30).collect()
    found = {(g.query_id, g.vec_id) for g in got}
    hits = 0
    for q in range(0, 3000, 30):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += sum((q, v) in found for v in np.argsort(d, kind="stable")[:10].tolist())
    assert hits >= 0.9 * 1000


def test_neighbours_at_one_distance_and_of_several_lengths(spark):
    """Ties go to the smallest ids however many there are; vectors of other lengths aren't compared."""
    r = np.random.default_rng(4)
    steps = np.eye(300)[r.permutation(300)] * 5.0
    rows = [(0, np.zeros(300).tolist()[:-1] + [1e-300])] + [(k + 1, v.tolist()) for k, v in enumerate(steps)] + [(1000 + k, [float(k), 1.0]) for k in range(30)] + [(2000, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*x, "x", 0) for x in rows], "vec_id long, embedding array<double>, list string, n int").coalesce(1)
    got = neighbours.search(df).orderBy("query_id", "rank").collect()
    assert [g.vec_id for g in got if g.query_id == 0] == list(range(1, 11)) and {g.score for g in got if g.query_id == 0} == {5.0}
    assert [g.vec_id for g in got if g.query_id == 1000] == list(range(1001, 1011)) and not [g for g in got if g.query_id == 2000]


def test_mix_hits_targets(spark):
    rows = spark.read.parquet(f"{H.DATA}/documents.parquet")
    one, two = mixing.mix(rows).collect(), mixing.mix(rows).collect()
    assert sorted(one) == sorted(two)
    source = {r.doc_id: r.source for r in rows.collect()}
    taken, target, size = {}, {}, {}
    for r in one:
        s = source[r.doc_id]
        taken[s], target[s], size[s] = taken.get(s, 0) + r.taken, r.target, r.source_size
        assert 0 <= r.taken <= 2 * r.size
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in target:
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK_WORDS and target[s] <= 2 * size[s] + 1e-6
    # levels: sources that don't stop share by weight
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(target))}
    level = {round(target[s] / weights[s], 3) for s in target if target[s] < 2 * size[s] - 1e-6}
    assert len(level) <= 1


def seated(votes: list[int], most: list[int], seats: int) -> list[int]:
    """The highest quotients one by one."""
    out = [0] * len(votes)
    heap = [(-v / 1, k) for k, v in enumerate(votes) if v > 0 and most[k] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        out[k] += 1
        if out[k] < most[k]:
            heapq.heappush(heap, (-votes[k] / (2 * out[k] + 1), k))
    return out


def test_seats_go_to_the_highest_quotients(spark):
    r, rows, want = random.Random(7), [], {}
    cases = [([6000] + [4] * 1000, [10**9] * 1001, 1000), ([5, 5, 5], [1, 1, 1], 9), ([0, 0], [3, 3], 4), ([7], [100], 40), ([3, 3, 3, 3], [9] * 4, 6), ([1], [0], 3)]
    for _ in range(40):
        n = r.randint(1, 60)
        votes = [int(r.paretovariate(0.7)) + r.randint(0, 3) if r.random() > 0.1 else 0 for _ in range(n)]
        cases.append((votes, [r.choice([0, 2, 10, 10**6]) if r.random() < 0.4 else 10**6 for _ in range(n)], r.randint(0, 4000)))
    for g, (votes, most, seats) in enumerate(cases):
        rows += [(g, k, v, m, seats) for k, (v, m) in enumerate(zip(votes, most))]
        want[g] = seated(votes, most, seats)
    out = mixing.apportion(spark.createDataFrame(rows, "g int, k int, votes long, most long, seats long"), ["g"], ["k"], "votes", "seats", "most").collect()
    assert want[0][0] == 750
    got = {g: [x.quota for x in sorted((x for x in out if x.g == g), key=lambda x: x.k)] for g in want}
    assert got == want


def test_many_null_ids_and_blank_texts_fill_no_shard(spark):
    rows = [(None, f"word{k % 500} " * (k % 500 % 7 + 1), "a") for k in range(20_000)] + [(k, " ", "b") for k in range(20_000)] + [(1, "x y z", "b"), (1, "other text here", "b"), (2, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines = mixing._lines(docs, 8, 1000, 17)
    assert lines.count() < 25_000 and lines.groupBy("doc_id", "source", "h").count().where("count > 1").count() == 0
    got = mixing.mix(docs, shard_words=1000).groupBy(F.col("doc_id").isNull().alias("none"), "source_size").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert sum(x.n for x in got) == len(rows) and all(x.over <= 0 for x in got)
    assert all(abs(x.taken - x.target) <= 8 * (x.source_size // 1000 + 2) for x in got)
    kept = mixing.mixed(docs)
    assert kept.where("doc_id is null").count() > 15_000 and {r.text for r in kept.where("doc_id = 1").collect()} <= {"x y z", "other text here"}


def test_mix_is_the_sql_on_small_shards(spark, monkeypatch, tmp_path):
    """Several shards and groups a source, repeated rows, null ids and sources, blank texts, sources that stop at twice their size."""
    r = random.Random(9)
    rows = [(k if r.random() < 0.9 else None, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 60))), r.choice("aaaaabc") if k % 9 else None) for k in range(900)]
    rows += rows[:40] * 3
    monkeypatch.setattr(mixing, "FAN", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    c = duckdb.connect()
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    sql = queries.OP7_SQL.replace(f"source_size / {mixing.SHARD_WORDS}", "source_size / 500").replace("shard // 512", "shard // 4")
    got, want = mixing.mix(docs, shard_words=500).toPandas(), c.execute(sql).fetchdf()
    assert len(got) == len(rows) and oracle.rows(got) == oracle.rows(want)


def test_mix_edges(spark):
    got = mixing.mix(H.edge(spark)).collect()
    assert len(got) == len(H.TEXTS) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(H.empty(spark)).collect() == []
    assert mixing.mixed(H.edge(spark)).columns == H.edge(spark).columns
