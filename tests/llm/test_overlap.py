"""The n-gram join against brute force, its merge and probes against plain counts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from noticelake.llm import overlap
from noticelake.llm.queries import QUERIES
from tests.llm import helpers as H


def sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.setdefault(i, []).append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    return out


def classes(rows) -> dict:
    found = sets(rows)
    parent = {i: i for i in found}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(found)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and 100 * len(x & y) >= 90 * len(x | y) for x in found[a] for y in found[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed: int, n: int) -> list[tuple]:
    """Groups of copies with changed words, chains of revisions, passages that unrelated texts share, and sizes around each threshold."""
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 500)}" for _ in range(r.choice([3, 9, 10, 11, 12, 21, 33, 60, 115, 160]))] for _ in range(30)]
    common, rows = [f"c{k}" for k in range(60)], []
    for k in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = [f"z{r.randint(0, 99)}"]
        rows.append((k, " ".join(common + w if k % 3 == 0 else w)))
    w = [f"r{k}" for k in range(200)]
    for k in range(40):  # each revision is close to the one before and far from the first
        w[5 * k : 5 * k + 2] = [f"v{k}", f"v{k}x"]
        rows.append((n + (k * 17) % 40, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_brute_force(spark, seed):
    rows = near_copies(seed, 260)
    got = {x.doc_id: x.component_id for x in overlap.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{H.DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {x.doc_id: x for x in QUERIES["op11_ngram_jaccard_join"](spark, H.DATA).collect()}
    assert {k: x.component_id for k, x in got.items()} == classes(rows)
    assert {k: x.n_shingles for k, x in got.items()} == {k: len(s[0]) for k, s in sets(rows).items()}


def test_join_edges(spark):
    got = overlap.jaccard_join(H.edge(spark)).collect()
    assert len(got) == len(H.TEXTS)
    by = {x.doc_id: x for x in got}
    assert by[5].component_id == by[6].component_id == 4 and by[10].component_id == 7 and by[8].component_id == 8
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[4].n_shingles == 1 and by[3].component_id == 3 and by[None].component_id is None
    assert overlap.jaccard_join(H.empty(spark)).collect() == []
    two = [(1, "a b c d e"), (1, "f g h i j"), (2, "f g h i j"), (3, "A b c d e")]
    assert {x.component_id for x in overlap.jaccard_join(spark.createDataFrame(two, "doc_id long, text string")).collect()} == {1}


def test_divide_skip_counts_like_a_counter():
    r = random.Random(5)
    for _ in range(300):
        lists = [sorted(r.sample(range(60), r.randint(0, 30))) for _ in range(r.randint(1, 8))]
        for times in (1, 2, 3, 5):
            counts = Counter(x for one in lists for x in one)
            assert list(overlap.divide_skip(lists, times)) == sorted((x, n) for x, n in counts.items() if n >= times)


def test_short_parts_of_linked_sets_meet_often_enough():
    """At every size, with the overlap just reached and its shared shingles last in the order."""
    often = np.zeros(1 << overlap.SLOT_BITS, np.int64)
    r = np.random.default_rng(1)
    for n in (*range(1, 40), 99, 100, 101, 112, 300):
        for m in range(overlap.least_overlap(n), n + 1):
            need = -(-90 * (n + m) // 190)
            if need > min(n, m):
                continue
            items = np.unique(r.integers(1 << 40, 1 << 62, 2 * n + 2).astype(np.uint64))[: n + m - need]
            extra, shared = items[: n + m - 2 * need], items[n + m - 2 * need :]
            a, b = np.sort(np.concatenate([extra[: n - need], shared])), np.sort(np.concatenate([extra[n - need :], shared]))
            one, two = (overlap.rarest_first(x, often)[: overlap.n_short(len(x))] for x in (a, b))
            assert len(np.intersect1d(one, two)) >= min(overlap.repeats(n), overlap.repeats(m))
            assert overlap.reaches(overlap.rarest_first(a, often), b, 2)
            apart = int(np.bitwise_count((overlap.parity(a) ^ overlap.parity(b)).view(np.uint64)).sum())
            assert 190 * apart <= 10 * (n + m)
            if need > 1:
                assert not overlap.reaches(overlap.rarest_first(a, often), np.sort(np.concatenate([b[b != shared[0]], np.array([7], np.uint64)])), 2)
