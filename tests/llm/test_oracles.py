"""Every query with SQL against DuckDB on whole tables; every other one against brute force on whole tables."""

import collections
import hashlib
import re
import zlib

import pytest


import linklens.llm.catalog as catalog

SF = "/root/testdata/sf0.001"

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == cols
    assert rows(df, cols) == sorted(rel.select(*[f'"{c}"' for c in cols]).fetchall(), key=repr)


def base_counts(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality(spark, duck):
    got = {r.doc_id: r for r in catalog.QUERIES["op3_quality"](spark, SF).collect()}
    labels = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    right = seen = 0
    for i, t in texts(duck).items():
        counts, r = base_counts(t), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
        if i in labels and not r.base_failed:
            seen, right = seen + 1, right + (r.kept == (labels[i] == 1))
    assert right >= 0.95 * seen > 0


def test_bpe(spark, duck):
    from tokenizers import Tokenizer

    from linklens.llm.op04_bpe import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    tok.no_truncation()
    tok.no_padding()
    got = {r.doc_id: tuple(r)[1:] for r in catalog.QUERIES["op4_bpe"](spark, SF).collect()}
    for i, t in texts(duck).items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(back.encode()).hexdigest())


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_groups(docs):
    """{id: least id reachable} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs.items()}
    least = {i: i for i in docs}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, duck):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in catalog.QUERIES["op6_minhash"](spark, SF).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in near_groups(texts(duck)).items()}


def test_near_duplicates_hot_group(spark):
    """A large group of edited copies, among them many that are linked to nothing, and a passage in many documents."""
    import random

    from linklens.llm.op06_minhash import near_duplicates

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(40)]
    docs = {}
    for i in range(220):
        w = list(base)
        for _ in range(r.randrange(0, 8)):
            w[r.randrange(len(w))] = word()
        docs[i] = " ".join(w)
    for i in range(300, 400):
        docs[i] = " ".join(passage + [word() for _ in range(r.randrange(5, 60))])
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {x.k_id: (x.n_shingles, x.component_id) for x in near_duplicates(df).collect()}
    assert got == near_groups(docs)


def test_near_duplicates_overfull_buckets(spark):
    """Copies that share with a twin only what others have as well: buckets are full of strangers, twins still meet."""
    import random

    from linklens.llm import op06_minhash

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    blocks, docs = [[word() for _ in range(30)] for _ in range(12)], {}
    for i in range(250):
        shared = [w for b in sorted(r.sample(range(12), 7)) for w in blocks[b]]
        for k in (0, 1):
            docs[2 * i + k] = " ".join(shared + [word() for _ in range(32)])
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {x.k_id: (x.n_shingles, x.component_id) for x in op06_minhash.near_duplicates(df).collect()}
    want = near_groups(docs)
    assert len({c for _, c in want.values()}) <= 260  # nearly all twins are linked
    assert got == want


def test_linked_sets_share_an_early_shingle(spark):
    """Every pair at 0.75 or more is among the pairs that meet, whatever its sizes; few others are."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from linklens.llm import op06_minhash as m

    r = random.Random(11)
    sets = {}
    for g in range(25):
        base = r.sample(range(g * 200, g * 200 + 400), r.randrange(1, 90))  # neighbouring groups overlap
        for k in range(8):
            own = set(base[:len(base) - r.randrange(0, len(base) // 3 + 1)])
            for _ in range(r.randrange(0, len(base) // 4 + 1)):
                own.add(r.choice([r.randrange(10**6), g * 200 + r.randrange(400)]))
            sets[g * 8 + k] = own
    rows = [(i, np.array(sorted(x), np.int64).tobytes()) for i, x in sets.items()]
    members = m.member_shingles(spark.createDataFrame(rows, "node bigint, shingles binary"))
    early = m.early_shingles(members).withColumn("comp", F.when(F.col("node") < 8, 0).otherwise(F.col("node")))
    met = {(x.a, x.b) for x in m.similar_pairs(early).collect()}
    linked = {(i, j) for i in sets for j in sets
              if i < j and (j >= 8) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(linked) > 50 and linked <= met
    assert len(met) < 4 * len(linked)
    assert not any(a < 8 and b < 8 for a, b in met)


def test_language(spark, duck):
    langs = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = catalog.QUERIES["op10_language_id"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_tool_calls(spark, duck):
    """Derived messages against a plain walk over each conversation."""
    turns = collections.defaultdict(dict)
    for conv, turn, role, text in duck.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall():
        turns[conv][turn] = (role, text)
    want = {}
    for conv, ts in turns.items():
        calls = {t for t, (role, _) in ts.items() if role == "user"}
        for t in calls:
            depth, at = 0, t
            while at % 4 >= 2 and at - 2 in calls:
                depth, at = depth + 1, at - 2
            bad = t % 4 < 2 and not 1 <= len(ts[t][1]) % 60 <= 50
            done = ts.get(t + 1, ("", ""))[0] == "assistant"
            want[(str(conv), f"c{t}")] = ("invalid_arguments" if bad else "ok" if done else "missing_result", depth)
    got = {(r.conv_id, r.call_id): (r.status, r.level) for r in catalog.QUERIES["op5_tool_calls"](spark, SF).collect()}
    assert got == want


def test_pipeline(spark, duck):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
    benchmark = {i: shingles(t) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()}
    for k, (_, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = p.materialise(stage(spark, docs, SF), "test")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            assert all(base_counts(r.text)[0] >= 50 for r in after.values())
            assert all(after[i] == before[i] for i in after)
        if k == 1:
            gone = set(before) - set(after)
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id].text)
            assert all(any(x.text == before[i].text for j, x in before.items() if j < i) or before[i].text for i in gone)
        if k == 2:
            groups = near_groups({i: r.text for i, r in before.items()})
            assert set(after) == {i for i, (_, c) in groups.items() if c == i}
        if k == 3:
            bad = {i for i, r in before.items() for s in benchmark.values()
                   if s and 100 * len(shingles(r.text) & s) >= 75 * len(s)}
            assert set(after) == set(before) - bad
        if k == 4:
            assert set(after) == set(before) and all(r.n_tokens == len(r.ids) for r in after.values())
    assert start
