"""The manifest and conversation repair against plain versions and their SQL; components and word hashes."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from noticelake.llm import common, components, manifest, minhash, repair
from noticelake.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle
from tests.llm import helpers as H
from tests.llm import plain

KEY = lambda x: (x[0] is not None, x[0] or 0, x[1], x[4])


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_conversation_repair"])
def test_query_gives_the_sql(spark, name):
    got, want = QUERIES[name](spark, H.DATA).toPandas(), oracle.connection(H.DATA).execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and oracle.rows(got) == oracle.rows(want)


@pytest.mark.parametrize("levels", [1, manifest.LEVELS])
def test_manifest_is_the_plain_tree(spark, levels):
    """Blocks of 16 make three upper forests; null ids, sources and fields, repeated rows, 300 sources."""
    rows = [(i if i % 50 else None, f"T {i % 7} x" if i % 3 else None, None if i % 5 else "en", "s" if i % 3 else None if i % 4 else f"t{i % 600}", i) for i in range(5000)] + [(1, "A", "b", "s", 3)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted([tuple(r) for r in manifest.check_against_tampered(docs, levels).collect()], key=KEY)
    assert got == sorted(plain.manifest(docs.collect()), key=KEY)


def test_manifest_edges(spark):
    docs = H.edge(spark)
    assert sorted([tuple(r) for r in manifest.check_against_tampered(docs).collect()], key=KEY) == sorted(plain.manifest(docs.collect()), key=KEY)
    assert manifest.manifest(H.empty(spark)).collect() == []
    alone = manifest.manifest(docs.where("doc_id = 4")).collect()
    assert alone[0].leaf == alone[0].subroot == alone[0].root and alone[0].verified and alone[0].proof_sha256 == plain.sha()
    assert all(r.verified for r in manifest.manifest(docs).collect())


def test_midstates_fold_like_whole_parents():
    digests = [plain.sha(str(k)) for k in range(300)]
    tree = manifest.Midstates(digests, 3)
    for at in (0, 15, 16, 130, 299):
        other = plain.sha("other")
        assert tree.fold(at, other.encode()) == manifest.Midstates([*digests[:at], other, *digests[at + 1 :]], 3).top()


def conversations(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    return [
        (c, r.choice([None, k, k, k, 0, -3]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]), r.choice(["a.", "b!", None, "", " \n", "c", "d. \t", "e?", "f", "a."]))
        for c in [*range(n), None] for k in range(r.randint(0, 8))
    ]


@pytest.mark.parametrize(("size", "batch"), [(repair.CHUNK, 10_000), (2, 3)])
def test_repair_is_the_exhaustive_search(spark, size, batch):
    """Small chunks of back-pointers and batches of three rows: the state goes on between them."""
    rows = conversations(4, 60)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.conv_id: tuple(r) for r in repair.repair_damaged(turns, size).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == plain.repair(rows)


def test_repaired_turns_alternate_and_hash_to_the_audit(spark):
    rows = [(7, k % 3000, random.Random(k).choice(["user", "assistant", "system"]), random.Random(k + 1).choice(["a.", "b!", f"{k} x", f"{k}.", ""])) for k in range(4000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = repair.repair(turns, 100).collect()[0]
    kept = sorted(repair.repaired_turns(turns, 100).collect(), key=lambda r: r.position)
    assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in kept))
    assert plain.sha("\n".join(f"{r.role}:{r.text}" for r in kept)) == one.repaired_sha256
    assert one.audit.replace("D", "") == "".join(r.edit for r in kept) and one.audit.count("D") + len(kept) - one.audit.count("I") == len(rows)


def test_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string, audit string, cost int, later string, part int, edits string"
    assert repair.repair_damaged(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 3, "user", "x " * 100_000 + ".", "a", 1, "l", 2, "e"), (1, 4, "assistant", "y.", None, None, None, None, None)]
    got = repair.repair(spark.createDataFrame(rows, schema)).collect()
    assert [(r.cost, r.audit, r.illegal) for r in got] == [(0, "KK", 0)]
    dropped = next(k for k in range(1000) if plain.zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = repair.repair_damaged(spark.createDataFrame([(dropped, 0, "user", "a.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", plain.sha())]


def model_rounds(ids: np.ndarray) -> int:
    """The rounds of ``components`` on a path, as a model over arrays."""
    n, links, rounds = len(ids), np.stack([ids[:-1], ids[1:]], 1), 0
    draw = np.random.default_rng(0)
    while len(links):
        both = np.concatenate([links, links[:, ::-1]])
        order = np.argsort(n - np.bincount(both[:, 0], minlength=n) + 0.999 * draw.random(n))
        rank = np.empty(n, int)
        rank[order] = np.arange(n)
        best = rank.copy()
        np.minimum.at(best, both[:, 0], rank[both[:, 1]])
        up = order[best]
        while (up[up] != up).any():
            up = up[up]
        links = up[links]
        links, rounds = np.unique(np.sort(links[links[:, 0] != links[:, 1]], axis=1), axis=0), rounds + 1
    return rounds


def test_components_take_logarithmic_rounds(spark, monkeypatch):
    assert model_rounds(np.random.default_rng(1).permutation(100_000)) <= 25 and model_rounds(np.arange(100_000)) <= 25
    rounds, hooked = [], components._hooked
    monkeypatch.setattr(components, "_hooked", lambda links, turn: rounds.append(turn) or hooked(links, turn))
    ids = np.random.default_rng(2).permutation(400)
    links = [(int(a), int(b)) for a, b in zip(ids, ids[1:])] + [(900, k) for k in range(1000, 1300)] + [(2000, 2000), (None, 5), (2001, 2002), (2002, 2001)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(400), 0), **dict.fromkeys([900, *range(1000, 1300)], 900), 2000: 2000, 2001: 2001, 2002: 2001}
    assert len(rounds) <= 9
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_further_links_extend_components(spark):
    r = random.Random(6)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(90)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    want = {(x.node, x.component) for x in components.components(table(links)).collect()}
    for cut in (0, 30, 90):
        got = components.extended(components.components(table(links[:cut])), table([*links[cut:], (None, 3)])).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_stored_tables_can_be_removed(spark):
    df = common.stored(spark.range(3))
    common.discard(df)
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        spark.read.parquet(df.stored_at).collect()


def test_words_with_a_pattern_hash_apart():
    thue = "".join("ab"[bin(k).count("1") & 1] for k in range(4096))
    one, other = (np.frombuffer(t.encode(), np.uint8) for t in (thue, thue.translate(str.maketrans("ab", "ba"))))
    assert minhash.word_hashes(one)[0][0] != minhash.word_hashes(other)[0][0]
    assert minhash.set_key(minhash.shingles(one)) != minhash.set_key(minhash.shingles(other))
    again = minhash.word_hashes(np.frombuffer(b"one TWO two ONE", np.uint8))[0]
    assert again[0] == again[3] and again[1] == again[2]
