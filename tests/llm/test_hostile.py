"""Inputs made to break or to slow down: tool calls that are no JSON, deep needs, and long unbroken runs in the secret scan."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from linklens.llm import op01_secrets, op02_warc, op05_tool_calls, op08_line_dedup, pipeline
from linklens.llm.common import free_prefix, row_key, without_rows
from linklens.llm.op05_tool_calls import canonical, levels, read_calls, read_json


def test_json_that_is_refused():
    bad = ['{"a": NaN}', "[Infinity]", "1e999", '"\\ud800"', "[" * 200000, "[" * 200 + "]" * 200, '{"a":' * 300 + "1" + "}" * 300, "{", ""]
    for text in bad:
        with pytest.raises(ValueError):
            read_json(text)
        assert read_calls(text, {})[0][4] == "malformed"
        call = read_calls(json.dumps([{"id": "x", "name": "search", "arguments": text}]), op05_tool_calls.SCHEMAS)[0]
        assert call[1] == "x" and call[4] == "malformed"
    assert canonical(read_json('{"b": 1.0, "a": -0.0, "c": 1e2, "d": 0.5}')) == '{"a":0,"b":1,"c":100,"d":0.5}'
    assert read_json("[" * 100 + "]" * 100)


def test_hostile_messages(spark):
    raw = ['[{"id":"x","name":"search","arguments":{"query":"\\ud800"}}]', "[" * 200000,
           '[{"id":"x","name":"search","arguments":{"query":"q","limit":NaN}}]',
           '[{"id":"y","name":"search","arguments":{"query":"q","limit":5.0}}]']
    messages = spark.createDataFrame([("a", i, r, None, None) for i, r in enumerate(raw)],
                                     "conv_id string, seq bigint, tool_calls string, tool_call_id string, content string")
    got = {r.seq: (r.status, r.line) for r in op05_tool_calls.link_tool_calls(messages, op05_tool_calls.SCHEMAS).collect()}
    assert [got[i][0] for i in range(4)] == ["malformed"] * 3 + ["missing_result"]
    assert json.loads(got[3][1])["arguments"] == {"query": "q", "limit": 5} and '"limit":5,' in got[3][1]


def plain_levels(needs):
    """Levels by taking, again and again, the calls that wait for nothing."""
    level = {}
    while True:
        new = {c: 1 + max((level[n] for n in ns if n in needs), default=-1) for c, ns in needs.items()
               if c not in level and all(n in level for n in ns if n in needs)}
        if not new:
            return level
        level.update(new)


@pytest.mark.parametrize("seed", [1])
def test_levels_of_chains_branches_and_cycles(spark, seed):
    rnd = random.Random(seed)
    needs = {"c0": [], **{f"c{i}": [f"c{i - 1}"] for i in range(1, 300)}}  # a chain
    needs |= {f"d{i}": rnd.sample([f"d{j}" for j in range(i)], min(i, rnd.choice([0, 1, 1, 2, 3]))) for i in range(24)}
    needs |= {f"e{i}": [f"e{(i + 1) % 5}"] for i in range(5)}  # a cycle, a tail to it, and a call that needs both kinds
    needs |= {"f0": ["e0"], "f1": ["f0", "c7"], "f2": ["f1"], "g0": ["c299", "d23"], "g1": ["g0"], "g2": ["absent", "g1"],
              "s": ["s"], "t": ["s", "c1"]}
    calls = spark.createDataFrame([("a", c, ns) for c, ns in needs.items()], "conv_id string, call_id string, needs array<string>")
    rows = levels(calls).collect()
    assert {r.call_id: r.level for r in rows} == plain_levels(needs) and len(rows) == len(plain_levels(needs))
    assert levels(calls.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["http://" + "a" * 1_000_000, "a" * 1_000_000 + "://u:p@", "eyJ" * 300_000, "a.b" * 300_000,
                                  "-----BEGIN" + " A" * 400_000, "token" + " " * 900_000, "-----BEGIN " * 90_000])
def test_long_unbroken_runs_end(spark, text):
    docs = spark.createDataFrame([(1, text + " password = abcdef123")], "doc_id bigint, text string")
    start = time.time()
    row = op01_secrets.scan_secrets(docs).select(op01_secrets.joined_spans(F.col("spans")).alias("s")).first()
    assert f"assign:{len(text) + 1}:{len(text) + 21}" in row.s
    assert time.time() - start < 60


def test_records_of_other_pages_are_refused():
    raw = op02_warc.render_record(7, "u", "", "d" * 40, "revisit", 9, "2024-01-01T00:00:00Z")
    warc, _, _ = op02_warc.parse_record(raw)
    assert op02_warc.pages_of(warc, "d" * 40) == ("7", "9")
    for field in ("warc-refers-to", "warc-record-id", "x-page-id", "x-refers-to-page-id"):
        with pytest.raises(ValueError):
            op02_warc.pages_of({**warc, field: "8"}, "d" * 40)
    first, _, _ = op02_warc.parse_record(op02_warc.render_record(None, None, "x", "e" * 40, "response", None, "2024-01-01T00:00:00Z"))
    assert op02_warc.pages_of(first, "e" * 40) == (None, None)


def test_clashing_helper_names(spark):
    """Columns named as the helper columns are stay as they are."""
    words = " ".join(f"w{i}" for i in range(60))
    names = ("ll_id", "LL_TEXT", "ll_hash", "ll_gone", "ll_lines", "ll_removed", "ll_g_id", "ll_g_text", "lll_id", "k_id", "k_text")
    docs = spark.createDataFrame([(1, f"{words}\nend"), (2, f"start\n{words}"), (2, f"start\n{words}"), (3, None)],
                                 "doc_id bigint, text string").withColumn("n_chars", F.char_length("text").cast("bigint"))
    docs = docs.withColumns({n: F.lit(n) for n in names})
    assert free_prefix(docs) == "llll_"
    keys = docs.filter("doc_id = 1").select(*row_key("doc_id", "text"))
    left = without_rows(docs, keys)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 2, 3]
    for out in (op08_line_dedup.dedup_lines(docs), pipeline.line_dedup(spark, docs, "")):
        rows = {r.doc_id: r for r in out.collect()}
        assert out.columns == docs.columns and rows[2].text == "start" and rows[1].text == f"{words}\nend"
        assert all(r[n] == n for r in rows.values() for n in names)
    near = pipeline.near_dedup(spark, docs, "")
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == [1, 3]
