"""Operators on vectors, pages and conversations, and the pipeline."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, entry, topk, warc
from tests.llm import cases
from tests.llm.test_text_operators import removed


# -- top-k ---------------------------------------------------------------------


def brute_topk(rows, k, queries):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = list({(i, tuple(v)) for i, v in good})
    out = []
    for q in sorted({i for i, _ in good if queries(i)}):
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j) for i, v in good if i == q for j, w in good if j != q))[:k]
        out += [(q, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return set(out)


def test_topk_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.99, -1e-9]) for _ in range(6)]) for i in range(90)]
    rows += [(200, None), (220, [None, 1.0]), (240, [float("nan")] * 6), (260, [float("inf")] * 6), (280, [1.0, 2.0]), (300, []), (0, rows[0][1]), (None, [1.0] * 6), (320, [1e30] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, score string")
    usable = topk.usable(df)
    small_rows = [r for r in rows if r[0] != 320]
    for block in (topk.BLOCK, 200):
        got = topk.top_k(usable.filter("vec_id % 20 = 0 and vec_id <> 320"), usable.filter("vec_id <> 320"), 7, block).collect()
        assert {tuple(r) for r in got} == brute_topk(small_rows, 7, lambda i: i % 20 == 0) and len(got) == len(set(got))
    huge = topk.top_k(usable.filter("vec_id = 320"), usable, 3).collect()
    assert len(huge) == 3 and all(abs(r["score"]) <= 2**63 - 1 for r in huge)
    assert topk.top_k(usable.limit(0), usable, 3).collect() == []


def test_floors_beyond_64_bits(spark):
    xs = [1e19, -1e19, 2.0**53, 0.999, -1e-9, 2.0**57 + 2**10]
    got = topk.usable(spark.createDataFrame([(1, xs)], "vec_id long, embedding array<double>")).first()["x"]
    assert [int(x) for x in got] == [math.floor(64 * x) for x in xs]


def test_topk_query(spark):
    got = entry.op2_exact_topk(spark, f"{cases.DATA}/sf0.001").toPandas()
    want = cases.oracle(entry.oracle_sql()["op2_exact_topk"], embeddings=spark.read.parquet(f"{cases.DATA}/sf0.001/embeddings.parquet").toPandas())
    cases.same(got, want)


def test_scatter_of_sparse_lists():
    rng = np.random.default_rng(2)
    q, c = (rng.integers(-9, 9, (5, 12)) * (rng.random((5, 12)) < 0.3) for _ in range(2))
    assert (topk.accumulate(q, c) == q @ c.T).all()
    big = np.array([[1 << 40, 3]]), np.array([[1 << 30, -5], [2, 1 << 50]])
    assert topk.accumulate(*big)[0, 1] == (1 << 41) + 3 * (1 << 50)


# -- pages ---------------------------------------------------------------------


def test_warc_odd_pages(spark):
    html = "<p>é" + "x" * 200 + "\r\n\r\nWARC/1.1\n\n</p>"
    rows = [(5, "http://a/b c d", html), (3, None, html), (-9, "http://x", html), (7, "", None), (8, "http://y", ""), (9, "http://z", "short"), (10, "http://z", "short"), (3, None, html), (None, "http://n", html), (None, "http://m", "z" * 300), (2**62, "http://big", "q" * 100), (-(2**63), "http://least", "q" * 100)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.convert_pages(pages, limit=500)
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, h in raw:
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = sorted((str(i), len(h), hashlib.sha256(h).hexdigest(), "revisit" if first.get(h, i) != i else "response", first[h] if first.get(h, i) != i else None) for i, h in raw)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == want
    assert warc.convert_pages(pages.limit(0)).collect() == []


def test_pages_larger_than_an_archive(spark):
    rows = [(k, f"http://{k}", "é" * n) for k, n in enumerate([40_000, 3, 40_000, 90_000, 0])]
    got = warc.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), limit=1000).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [(0, 80_000, "response", None), (1, 6, "response", None), (2, 80_000, "revisit", 0), (3, 180_000, "response", None), (4, 0, "response", None)]


def test_arc_versions_and_framing():
    raw = (warc.arc_file_header(1, "a") + warc.arc_record(1, "a", 0, 4, "http://x y", "é1\n\n") + warc.arc_file_header(2, "b") + warc.arc_record(2, "b", 0, None, None, "")).encode()
    (one, block), (two, empty) = warc.parse_arc(raw)
    assert one["URL"] == "http://x%20y" and warc.split_http(block)[2].decode() == "é1\n\n" and "Checksum" in two and warc.split_http(empty)[2] == b""
    with pytest.raises(ValueError):
        list(warc.parse_arc(raw[:-9]))
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n"))
    assert warc.iso_date("20240229123456") == "2024-02-29T12:34:56Z" and warc.iso_date("bad") == "1970-01-01T00:00:00Z"
    for n in (0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567):
        assert warc.page_of(warc.record_id(n)) == n


def test_warc_query(spark):
    got = entry.op8_arc_to_warc(spark, f"{cases.DATA}/sf0.01").toPandas()
    want = cases.oracle(entry.oracle_sql()["op8_arc_to_warc"], pages=spark.read.parquet(f"{cases.DATA}/sf0.01/pages.parquet").toPandas())
    cases.same(got, want)


# -- conversations -------------------------------------------------------------


def test_maximal_conversations(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "more")
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [a, c], 6: [("user", None)], 7: [(None, "")], 8: [("use", "rhi")], 9: [c, c]}
    rows = [(i, t, r, x, 0) for i, turns in logs.items() for t, (r, x) in enumerate(turns)] + [(None, 0, "user", "lost", 0), (10, None, "user", "first", 0), (10, 0, "user", "second", 0), (9, 5, "user", "z", 0), (9, 5, "user", "z", 0)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "conv_id long, turn long, role string, text string, prefixes int")
    got = chat.render_maximal(df).toPandas()
    assert sorted(got["conv_id"]) == [3, 5, 6, 7, 8, 9, 10]
    assert got.set_index("conv_id")["rendered"][3] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    want = cases.oracle(chat.ORACLE, conversations=df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    cases.same(got, want)
    assert chat.render_maximal(df.limit(0)).collect() == []


def test_chat_query(spark):
    got = entry.op3_chat_format(spark, f"{cases.DATA}/sf0.01").toPandas()
    cases.same(got, cases.oracle(chat.ORACLE, conversations=spark.read.parquet(f"{cases.DATA}/sf0.01/conversations.parquet").toPandas()))


# -- pipeline ------------------------------------------------------------------


def test_pipeline_stages(spark):
    sf = f"{cases.DATA}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = spark.createDataFrame(stages["quality_classifier"](spark, docs, sf).toPandas(), docs.schema)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.filter("quality = 1").join(docs, "doc_id")
    assert kept.join(good.select("doc_id"), "doc_id").count() >= 0.97 * good.count()
    assert kept.columns == docs.columns
    near = spark.createDataFrame(stages["minhash_near_dedup"](spark, kept, sf).toPandas(), docs.schema)
    assert near.columns == docs.columns and near.count() < kept.count()
    cut = stages["suffix_array_dedup"](spark, near, sf).toPandas()
    want = removed([(r["doc_id"], r["text"]) for r in near.collect()], 200)
    byte_counts = {k[0]: k[1] - k[2] for k in want}
    for doc_id, text in zip(cut["doc_id"], cut["text"], strict=True):
        assert byte_counts[doc_id] - 6 * 3 <= len(text.encode()) <= byte_counts[doc_id]
    out = corpus_pipeline.run(spark, sf)
    assert out.select(F.count_distinct("doc_id")).first()[0] == near.count()


def test_stages_keep_one_row_of_repeated_and_nameless_documents(spark):
    """Stages 2 and 3 on rows that repeat, share a doc_id or have none: one row of each group stays, with its text."""
    stages = dict(corpus_pipeline.STAGES)
    own = {k: " ".join(f"{k}{n}" for n in range(80)) for k in "abcdefgh"}
    rows = [
        (1, own["a"]), (1, own["a"]), (1, own["a"]),  # repeated rows of no other document
        (2, own["b"]), (2, own["c"]), (3, own["c"] + " end"), (1, own["c"] + " tail"),  # one id, two texts, of which one has near-duplicates
        (None, own["d"]), (None, own["d"]),  # repeated, without an id
        (None, own["e"]), (9, own["e"] + " end"),  # an id goes before none
        (4, own["f"]), (4, own["f"] + " end"),  # alike under one id
        (5, own["g"]), (6, own["h"]), (5, None), (5, None), (7, ""), (8, ""), (None, None),
    ]
    docs = cases.documents(spark, rows)
    kept = stages["minhash_near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    alike = [x for x in got if x[0] == 4]
    assert len(alike) == 1 and alike[0] in rows
    assert [x for x in got if x[0] != 4] == sorted([(1, own["a"]), (2, own["b"]), (1, own["c"] + " tail"), (None, own["d"]), (9, own["e"] + " end"), (5, own["g"]), (6, own["h"]), (5, None), (7, ""), (8, ""), (None, None)], key=str)
    after = stages["suffix_array_dedup"](spark, kept, "")
    assert sorted(((r["doc_id"], r["text"]) for r in after.collect()), key=str) == got


def test_odd_cases_lose_no_document_to_their_copies(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = cases.documents(spark)
    kept = stages["minhash_near_dedup"](spark, docs, "")
    texts = [(r["doc_id"], r["text"]) for r in stages["suffix_array_dedup"](spark, kept, "").collect()]
    assert [i for i, t in texts if t and "passage30" in t] == [8]
    alone = cases.documents(spark, [x for x in cases.DOCUMENTS if x[0] == 18])
    kept = stages["suffix_array_dedup"](spark, stages["minhash_near_dedup"](spark, alone, ""), "")
    assert [(r["doc_id"], r["text"]) for r in kept.collect()] == [(18, cases.PASSAGE)]
