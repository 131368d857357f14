"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; single rules of the operators."""

import json

from pyspark.sql import functions as F

from linklens.llm import (op01_secrets, op02_warc, op03_quality, op04_bpe, op05_tool_calls, op06_minhash,
                          op07_decontaminate, op08_line_dedup, op09_url_filter, op10_language_id)
from linklens.llm.common import shared_path


def test_secrets(spark, odd_docs, no_docs):
    out = op01_secrets.scan_secrets(odd_docs).select("doc_id", op01_secrets.joined_spans(F.col("spans")).alias("s"))
    got = sorted(((r.doc_id, r.s) for r in out.collect()), key=repr)
    assert len(got) == 10
    text = "Ünï \U0001F600 token = 'abcdef123' x\nAKIA" + "A1" * 9
    assert dict(got)[8] == f"assign:6:24,access:{text.index('AKIA')}:{len(text)}"
    assert op01_secrets.scan_secrets(no_docs).count() == 0
    # a dropped match still uses up its characters
    docs = spark.createDataFrame([(1, "secret=token: abcdef api-key=abcdef apikey:'x.y=z_-/+' " + "f" * 24)],
                                 "doc_id bigint, text string")
    row = op01_secrets.scan_secrets(docs).select(op01_secrets.joined_spans(F.col("spans")).alias("s")).first()
    assert row.s == "assign:37:54,hex:55:79" or row.s.startswith("assign:")


def test_postings_of_copies_are_short(spark, monkeypatch):
    monkeypatch.setattr(op01_secrets, "BLOCK_ROWS", 16)
    docs = spark.createDataFrame([(i, "secret = abcdef123") for i in range(640)] + [(None, "secret = abcdef123")] * 2,
                                 "doc_id bigint, text string")
    postings = op01_secrets.build_postings(docs, ["sec", "ret"], "doc_id", "text")
    sizes = [r.n for r in postings.filter("trigram = 'sec'").select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 641 and max(sizes) <= 64
    assert {r.s for r in op01_secrets.scan_secrets(docs).select(
        op01_secrets.joined_spans(F.col("spans")).alias("s")).collect()} == {"assign:0:18"}


def test_trigram_queries():
    assert op01_secrets.trigram_query("[0-9a-f]{24,}") == []
    assert op01_secrets.trigram_query("AKIA[A-Z]+") == [{"aki", "kia"}]
    assert {"api", "key"} in [c & {"api", "key"} for c in op01_secrets.trigram_query(op01_secrets.BASE_RULES[0].pattern)]


def test_warc(spark):
    big, small = "<p>" + "é" * 1000, "<p>x"
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://c/\r\n", big), (3, "http://c/", big), (4, "u", small),
            (5, "u", small), (6, "u", None), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("x"))
    root = shared_path(spark, "warc-test")
    index = op02_warc.archive_pages(pages, root)
    got = op02_warc.read_warc(index, root).collect()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr)
    assert kinds == sorted([(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "response", None),
                            (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 3)],
                           key=repr)
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {big, small, ""}
    assert all(r.payload_bytes == 2003 for r in got if r.record_type == "revisit")
    some = op02_warc.read_warc(index.filter("page_id = 4"), root).collect()
    assert [(r.page_id, bytes(r.payload)) for r in some] == [(4, b"<p>x")]
    # page and reference come from the records, whatever the index says
    other = index.withColumns({"page_id": F.lit(99).cast("bigint"), "refers_to": F.lit(98).cast("bigint")})
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in op02_warc.read_warc(other, root).collect()), key=repr) == kinds
    empty = op02_warc.archive_pages(pages.limit(0), root)
    assert op02_warc.read_warc(empty, root).count() == 0


def test_coalesced_reads():
    reads = op02_warc.coalesce_ranges([("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("b", 0, 5)], max_gap=4, max_read=50)
    assert reads == [("a", 0, 15, [0, 1]), ("a", 100, 105, [2]), ("b", 0, 5, [3])]


def test_quality(odd_docs, no_docs):
    got = {(r.k_id, r.n_words, r.base_failed, r.kept) for r in op03_quality.judge_quality(odd_docs).collect()}
    assert (1, 0, True, False) in got and (2, 0, True, False) in got and (4, 3, True, False) in got
    assert op03_quality.judge_quality(no_docs).count() == 0
    assert op03_quality.keep_good(odd_docs).columns == odd_docs.columns


def test_bpe(odd_docs, no_docs):
    out = op04_bpe.encoded_and_decoded(odd_docs)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=repr)
    assert op04_bpe.encoded_and_decoded(no_docs).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = [b"walking", b"talking", b"walks", b"talks", b"walk"]
    built = op04_bpe.Lexicon.build(words, lambda w: list(w))
    (tmp_path / "x").write_bytes(built.dump())
    lexicon = op04_bpe.Lexicon.load(str(tmp_path / "x"))
    place = lexicon.find([*words, b"wal", b"walkings", b"", b"zzz"]).tolist()
    assert [p >= 0 for p in place] == [True] * 5 + [False] * 4
    assert [bytes(lexicon.ids[lexicon.starts[p]:lexicon.starts[p + 1]].tolist()) for p in place[:5]] == words
    # both beginnings lead to the shared ending -alk(s|ing)
    assert len(lexicon.final) < sum(map(len, words)) // 2


def test_tool_calls(spark):
    def call(i, args, name="search"):
        return json.dumps([{"id": i, "name": name, "arguments": args}])

    rows = [("a", 0, call("x", {"query": {"$result": "y"}}), None, None), ("a", 1, call("y", {"query": "q"}), None, None),
            ("a", 2, None, "y", "late"), ("a", 1, None, "y", "soon"), ("a", 3, call("y", {"query": "again"}), None, None),
            ("a", 4, call("p", {"query": {"$result": "q"}}), None, None),
            ("a", 5, call("q", {"query": {"$result": "p"}}), None, None), ("a", 6, "not json", None, None),
            ("a", 7, call("z", {"query": 5}), None, None), ("a", 8, call("u", {}, "nothing"), None, None),
            (None, None, call("y", '{"query":"é"}'), None, None)]
    messages = spark.createDataFrame([(c, s, "r", t, k, i) for c, s, k, i, t in rows],
                                     "conv_id string, seq bigint, role string, content string, tool_calls string, "
                                     "tool_call_id string")
    out = op05_tool_calls.link_tool_calls(messages, op05_tool_calls.SCHEMAS).collect()
    got = {(r.conv_id, r.seq): (r.call_id, r.status, r.level) for r in out}
    assert got == {("a", 0): ("x", "missing_result", 1), ("a", 1): ("y", "ok", 0), ("a", 3): ("y", "duplicate_id", 0),
                   ("a", 4): ("p", "cycle", None), ("a", 5): ("q", "cycle", None), ("a", 6): (None, "malformed", None),
                   ("a", 7): ("z", "invalid_arguments", 0), ("a", 8): ("u", "unknown_tool", 0),
                   ("", -1): ("y", "missing_result", 0)}
    line = next(r.line for r in out if r.seq == 1)
    assert line == '{"arguments":{"query":"q"},"id":"y","name":"search","result":"soon","status":"ok"}'
    assert op05_tool_calls.link_tool_calls(messages.limit(0), op05_tool_calls.SCHEMAS).count() == 0


def test_repeated_messages(spark):
    """Of repeated rows one has the first call, the others duplicates of it."""
    calls = json.dumps([{"id": i, "name": "search", "arguments": {"query": "q"}} for i in ("x", "y")])
    rows = [("a", 0, calls, None, None)] * 3 + [("a", 1, None, "x", "r")] * 2 + [(None, None, calls, None, None)] * 2
    messages = spark.createDataFrame(rows, "conv_id string, seq bigint, tool_calls string, tool_call_id string, "
                                           "content string").repartition(3)
    got = sorted((r.conv_id, r.call_id, r.status) for r in
                 op05_tool_calls.link_tool_calls(messages, op05_tool_calls.SCHEMAS).collect())
    assert got == sorted([("a", "x", "ok"), ("a", "y", "missing_result"), ("", "x", "missing_result"),
                          ("", "y", "missing_result"), *[("a", i, "duplicate_id") for i in "xxyy"],
                          ("", "x", "duplicate_id"), ("", "y", "duplicate_id")])


def test_near_duplicates(odd_docs, no_docs):
    got = {(r.k_id, r.n_shingles, r.component_id, r.kept) for r in op06_minhash.near_duplicates(odd_docs).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True)} <= got
    assert {(g[0], g[2]) for g in got if g[0] in (5, 6, 7)} == {(5, 5), (6, 5), (7, 5)}
    assert op06_minhash.near_duplicates(no_docs).count() == 0


def test_near_dedup_keeps_one_row_a_group(spark):
    """Null ids, one id for several texts, and repeated rows: one row of each group stays; blank texts all stay."""
    import corpus_pipeline

    w = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(None, w("a")), (None, w("a") + " x"), (7, w("b")), (7, w("b") + " x"), (7, w("c")), (8, w("d")), (8, w("d")),
            (9, w("d")), (5, ""), (5, ""), (None, None), (None, w("e")), (4, w("e") + " x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    out = corpus_pipeline.near_dedup(spark, docs, "")
    got = sorted(((r.doc_id, (r.text or "")[:1]) for r in out.collect()), key=repr)
    assert out.columns == docs.columns
    assert got == sorted([(None, "a"), (7, "b"), (7, "c"), (8, "d"), (5, ""), (5, ""), (None, ""), (4, "e")], key=repr)


def test_pipeline_decodes(spark, odd_docs):
    import hashlib

    import corpus_pipeline

    got = sorted(r.decoded_sha256 for r in corpus_pipeline.encode(spark, odd_docs, "").collect())
    assert got == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd_docs.collect())


def test_bayes_floors_rise():
    floors = op06_minhash.least_matches()
    assert floors == sorted(floors) and floors[-1] < 0.75 * op06_minhash.HASHES


def test_decontaminate(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "W1 w2 w3 w4 w5 w6 w7"), (2, None), (3, ""), (4, "one two three"), (4, "one two three"),
                                   (5, "absent words only in this item here")], "item_id bigint, text string")
    got = {(r.k_id, r.item_id, r.n_item, r.n_shared) for r in op07_decontaminate.contaminated(odd_docs, items).collect()}
    assert got == {(5, 1, 3, 3), (6, 1, 3, 3), (7, 1, 3, 3), (4, 4, 1, 1)}
    assert op07_decontaminate.contaminated(no_docs, items).count() == 0
    assert op07_decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0


def test_line_dedup(spark, odd_docs, no_docs):
    w = lambda a, b: " ".join(f"x{i}" for i in range(a, b))
    rows = [(1, f"head\n{w(0, 30)}\n\n{w(30, 60)}\ntail"), (2, f"other\n{w(0, 30)}\n{w(30, 60)}\nrest"),
            (3, f"{w(0, 30)}\nalone"), (4, f"{w(100, 160)}\nmid\n{w(100, 160)}"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in op08_line_dedup.dedup_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "other\nrest", 3: rows[2][1], 4: f"{w(100, 160)}\nmid", 5: None, 6: ""}
    out = op08_line_dedup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 10
    assert {r.doc_id: r.text for r in out.collect()}[6] == ""
    assert op08_line_dedup.dedup_lines(no_docs).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://Example.NET/en/x?y", "http://net/", "http://net", "http://a.example.com/de/1",
            "http://x.org/fr/adult", "http://q.org/adult", "http://q.org/adults", "http://q.org/free", "http://q.org/free-win",
            "http://q.org/free-free", "http://u://v/w"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op09_url_filter.judge_urls(pages).collect()}
    assert [got[i][3] for i in range(len(urls))] == ["allow", "allow", "allow", "allow", "block", "allow", "block", "allow",
                                                     "block", "allow", "allow", "block", "allow", "allow"]
    assert got[3][:3] == ("example.net", "/en/x", "example.net/en/") and got[0][:3] == ("", "", None)
    assert got[13][:2] == ("u:", "//v/w")
    assert op09_url_filter.judge_urls(pages.limit(0)).count() == 0


def test_language(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)], "doc_id bigint, text string, lang string")
    profiles = op10_language_id.learn_profiles(docs)
    texts = spark.createDataFrame([(1, None), (2, "123 !"), (3, "the dog"), (4, "die katze"), (5, "")],
                                  "doc_id bigint, text string")
    got = {r.doc_id: r.lang_pred for r in op10_language_id.predict_languages(texts, profiles, [F.col("doc_id")]).collect()}
    assert got == {1: "und", 2: "und", 3: "en", 4: "de", 5: "und"}
    none = op10_language_id.learn_profiles(no_docs)
    assert none.languages == ()
    assert {r.lang_pred for r in op10_language_id.predict_languages(odd_docs, none, [F.col("doc_id")]).collect()} == {"und"}
