"""Exact and near dedup against plain versions, with odd rows."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugewright.llm import exact_dedup, near_dedup
from gaugewright.llm.components import connected_components
from gaugewright.llm.prefilter import build_filter, passing, without

SCHEMA = "doc_id long, text string, _digest int, _text int, id string"


def frame(spark, rows):
    """Documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)


def plain_exact(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = best(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep))
    return out


ODD = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (None, "z"), (6, "x" * 300_000), (7, "x" * 300_000), (-9, "b")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    got = exact_dedup.exact_duplicates(frame(spark, ODD), keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rank = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.drop("text_sha256").collect()), key=rank) == sorted(plain_exact(ODD, min if keep == "smallest" else max), key=rank)
    assert got.where("text_sha256 = sha2('a', 256)").count() == 3


def test_equal_digests_of_different_texts_are_told_apart(spark):
    weak = lambda text: F.unhex(F.hex(F.pmod(F.length(text), F.lit(2)).cast("string").cast("binary")))
    rows = [(i, f"text {i % 7}" + "y" * (i % 3)) for i in range(60)]
    got = exact_dedup.exact_duplicates(frame(spark, rows), digest=weak, memtables=3, fan_in=2)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept").collect())) == sorted(plain_exact(rows, min))


def test_empty_tables(spark):
    empty = frame(spark, [(1, "a")]).where("false")
    assert exact_dedup.exact_duplicates(empty).count() == 0 and near_dedup.near_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).columns == empty.columns


def test_stages_keep_rows_as_they_are(spark):
    df = frame(spark, [(1, "a"), (2, "a"), (3, None), (4, "c d")])
    left = exact_dedup.drop_exact_duplicates(df, keep="largest")
    assert left.columns == df.columns and sorted(r[0] for r in left.collect()) == [2, 3, 4]
    base = " ".join(f"w{k}" for k in range(60))
    near = near_dedup.drop_near_duplicates(frame(spark, [(5, base), (3, base + " tail"), (9, "other words here and there")]))
    assert sorted(r[0] for r in near.collect()) == [3, 9]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} - {()} if len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def plain_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def near_rows(seed):
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One TWO"), (5, "one two three"), (6, "é ü ß"), (7, "É ü ß")]
    shared = [f"s{k}" for k in range(40)]
    for family in range(6):
        words = [f"f{family}w{r.randint(0, 400)}" for _ in range(r.randint(10, 120))] + shared * (family % 2)
        for _ in range(r.randint(2, 12)):
            copy = list(words)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = f"e{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
            if r.random() < 0.3:
                words = copy  # chains: only neighbours are similar
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 128), (2, 3)])
def test_near_matches_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_rows(seed)
    got = near_dedup.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == plain_near(rows)


def test_near_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(100_000))
    rows = near_dedup.near_duplicates(frame(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (8, long), (7, long + " x"), (9, "  ")])).collect()
    found = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == 6 and found[None, 2] == (None, True) and found[2, 2] == (2, True) and found[9, 0] == (9, True)
    assert found[8, 99_996] == (7, False) and found[7, 99_997] == (7, True)


def test_near_rows_that_share_an_identifier(spark):
    base, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    got = near_dedup.near_duplicates(frame(spark, [(1, other), (1, base), (2, base + " tail"), (3, other + " tail"), (4, "quite different words stand here today"), (1, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_a_text_stays_where_another_of_its_identifier_goes(spark):
    left = exact_dedup.drop_exact_duplicates(frame(spark, [(1, "a"), (2, "a"), (1, "b"), (None, "a"), (None, "c")]), keep="largest")
    assert sorted((r[0] or 0, r[1]) for r in left.collect()) == [(0, "c"), (1, "b"), (2, "a")]


def test_signature_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(1)
    errors = []
    for n in (1, 3, 40, 900):
        for _ in range(20):
            pool = r.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
            a, b = np.unique(pool[: n + n // 2]), np.unique(pool[n // 2 :])
            s = near_dedup.signatures([a, b])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((s[0] == s[1]).mean() - true)
            assert (near_dedup.signatures([a])[0] == s[0]).all()
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.2


@pytest.mark.parametrize("per_task", [200_000, 20])
def test_components(spark, per_task):
    r = random.Random(5)
    links = [(k, k + 1) for k in range(60)] + [(r.randint(100, 140), r.randint(100, 140)) for _ in range(30)] + [(500, 500 + k) for k in range(1, 50)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    parent = {x: x for p in links for x in p}
    for _ in range(len(parent)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["component"] for r in connected_components(df, per_task).collect()}
    assert all(got[x] == parent[x] for x in parent if any(a != b and x in (a, b) for a, b in links))


def test_filter_lets_no_key_through_by_mistake(spark):
    rows = spark.range(2000).withColumnRenamed("id", "k")
    keys = spark.range(0, 2000, 7).withColumnRenamed("id", "key")
    assert passing(rows, build_filter(keys, "key"), "k").join(keys, F.col("k") == F.col("key"), "left_semi").count() == keys.count()
    assert without(rows, keys, "k").count() == 2000 - keys.count()
