"""Whitening, ring sharding and the Merkle manifest: brute force and odd inputs."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import linklens.llm.catalog as catalog
from linklens.llm import op11_whitening, op12_sharding, op13_merkle

SF = "/root/testdata/sf0.001"


def integers(vectors):
    return np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000


def held_against_eigh(rows, x, k):
    """``rows``: (id, component, n, deviation, whitened, explained, identity_error), ids 0, 1, ... in the order of ``x``."""
    n, total = len(x), x.sum(axis=0)
    y = (n * x - total) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = np.full((n, k), np.nan)
    for r in rows:
        got[r[0], r[1] - 1] = r[4]
        assert r[2] == n and r[3] == int(((n * x[r[0]] - total).astype(object) ** 2).sum())
        assert abs(r[5] / (values[r[1] - 1] / values.sum()) - 1) < 1e-9 and r[6] < 1e-9
    want = y @ vectors[:, :k] / np.sqrt(values[:k])
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-8


def test_whitening_query(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    place = {r.vec_id: i for i, r in enumerate(data)}
    rows = [(place[r[0]], *r[1:]) for r in catalog.QUERIES["op11_whitening"](spark, SF).collect()]
    assert len(rows) == 32 * len(data)
    held_against_eigh(rows, integers([r.embedding for r in data]), 32)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(40, 5)).astype(np.float32)
    good[:, 4] = good[:, 0]  # one dimension twice
    good[1] = good[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(good)]
    odd = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("nan")] * 5), (93, [1.0, float("inf"), 1.0, 1.0, 1.0]),
           (94, [1.0]), (95, []), (None, [float(v) for v in good[2]])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").selectExpr(
        "*", "'x' AS x", "'i' AS id", "1 AS v", "2 AS n", "'d' AS deviation", "3 AS at")
    got = op11_whitening.whitened_components(df, components=32).collect()
    assert {r.vec_id for r in got} == {*range(40), None}
    assert {r.component for r in got} == {1, 2, 3, 4} and len(got) == 41 * 4
    full = [(40 if r.vec_id is None else r.vec_id, *r[1:]) for r in got]
    held_against_eigh(full, integers(np.vstack([good, good[2]])), 4)
    for few in (df.limit(0), df.filter("vec_id = 0"), df.filter("vec_id < 2")):  # no row, one row, equal rows
        out = op11_whitening.whitened_components(few)
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == 0


def test_equal_eigenvalues_are_all_found(spark):
    rows = [(2 * i + s, [float((1 - 2 * s) * (i == j)) for j in range(6)]) for i in range(6) for s in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = op11_whitening.whitened_components(df).collect()
    assert {r.component for r in got} == set(range(1, 7))
    assert all(abs(r.explained - 1 / 6) < 1e-9 and r.identity_error < 1e-9 for r in got)


def test_deviation_beyond_64_bits():
    fit = op11_whitening.Fit(2, [2**52, 0], 2**52)
    assert fit.spread(np.array([[2**52, 5]])).tolist() == [[2**52, 10]]
    big = op11_whitening.Fit(2**12, [0], 2**52).spread(np.array([[2**52]]))
    assert big.dtype == object and big[0, 0] == 2**64


def test_shards_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(op12_sharding, "RUN_BITS", 3)
    text = "same text"
    many = spark.createDataFrame([(7, text)] * 300 + [(None, f"t{i}") for i in range(100)] + [(i, f"t{i}") for i in range(100, 150)],
                                 "doc_id bigint, text string").selectExpr("*", "1 AS place", "2 AS rank", "3 AS run", "4 AS shard")
    got = op12_sharding.assign_shards(many, shards=7, virtual=5).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == 450 and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert all(r.crc == zlib.crc32(text.encode()) and r.size == len(text) + 16 for r in got if r.id == 7)
    odd = op12_sharding.assign_shards(odd_docs).collect()
    assert sorted(((r.id, r.size, r.crc is None) for r in odd), key=repr) == sorted(
        ((r.doc_id, len((r.text or "").encode()) + 16, r.text is None) for r in odd_docs.collect()), key=repr)
    assert op12_sharding.assign_shards(no_docs).count() == 0


def test_one_more_shard_moves_little(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    few, more = ({r.id: r for r in op12_sharding.assign_shards(docs, shards=n, slack=0.25).collect()} for n in (10, 11))
    assert max(Counter(r.shard for r in few.values()).values()) <= 500
    assert max(Counter(r.shard for r in more.values()).values()) <= 455
    moved = sum(few[i].shard != more[i].shard for i in few)
    assert moved < 4000 * 0.25  # a tenth goes to the new shard, the rest follows from lower bounds
    stay = [i for i in few if few[i].home != more[i].home]
    assert all(more[i].home == 10 for i in stay)  # arcs only change hands to the new shard


def test_flow_keeps_bounds():
    nodes = op12_sharding.ring(5, 4)
    counts = {0: 100, 3: 1, 7: 0, 9: 50}
    placed = op12_sharding.flow(nodes, counts, op12_sharding.bounds(151, 5))
    used = Counter()
    for arc, runs in placed.items():
        assert sorted(x for lo, hi, _, _ in runs for x in range(lo, hi)) == list(range(counts[arc]))
        for lo, hi, shard, _ in runs:
            used[shard] += hi - lo
    assert sorted(used.values()) == [30, 30, 30, 30, 31]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, altered):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""

    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            start = i - i % 3
            out.append(("".join(level[start:i]), "".join(level[i + 1:start + 3])))
            i //= 3
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    found = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, k)
            node = leaf(altered(r))
            for before, after in steps:
                node = sha(before + node + after)
            found.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(b + a for b, a in steps)), node,
                          node == top[-1][0]))
    return sorted(found, key=repr)


def brute_cut(r):
    tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
    return (*r[:4], r[4].replace("\n", "")) if tampered else r


def manifest_rows(docs):
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                     op13_merkle.leaf([F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f)
                                       for f in op13_merkle.FIELDS]))
    out = op13_merkle.manifest(docs, altered=altered)
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return sorted((tuple(r) for r in out.select("id", "leaf", "subroot", "root", op13_merkle.digest(proof), "folded_root",
                                                "verified").collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_odd_rows(spark, monkeypatch, levels):
    monkeypatch.setattr(op13_merkle, "LEVELS", levels)
    monkeypatch.setattr(op13_merkle, "BLOCK", 3**levels)
    long = "long\n" * 30000
    rows = [(i, "hot", "en", 5, f"a\nb{i}") for i in range(58)]
    rows += [(1, None, None, None, None), (2, None, "é", 0, ""), (None, None, "x", 1, "\n"), (None, None, "x", 1, "\n")]
    rows += [(5, "é", "en", 1, long), (5, "é", "en", 1, long), (5, "é", "en", 2, "other"), (3, "", "en", 1, "x"), (3, "z", "en", 1, "1:x")]
    rows += [(100 + i, f"s{i}", "en", 1, "one\n") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").selectExpr(
        "*", "'n' AS node", "1 AS idx", "2 AS grp", "'g' AS grp_key", "3 AS total", "'l' AS leaf", "4 AS part", "5 AS tag")
    assert manifest_rows(docs) == brute_manifest(rows, brute_cut)


def test_manifest_of_few_rows(spark):
    kind = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    one = [(2, "s", "en", 1, "a\nb")]
    got = manifest_rows(spark.createDataFrame(one, kind))
    assert got == brute_manifest(one, brute_cut) and got[0][4] == sha("")
    assert manifest_rows(spark.createDataFrame([], kind)) == []
