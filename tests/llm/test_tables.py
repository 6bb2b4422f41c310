"""Dialogues, pages, the registered queries against SQL, and the pipeline."""

import hashlib

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F
from tests.llm import brute

import corpus_pipeline
from rangelake.llm import chat_rotation, queries, url_filter, warc_store
from rangelake.llm.packs import stored


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered(spark, sf, name):
    rows, problem = compare(spark, connect(sf), name, queries.QUERIES[name], queries.SQL.get(name), sf)
    assert problem is None, problem
    assert rows > 0


TURNS = [(1, 0, "system", "Be kind"), (1, 1, "Ann", "Hi"), (1, 2, "Bob", None), (1, 3, "Ann", "é 😀"), (1, 3, "Ann", "é 😀"), (1, None, "Bob", "first"), (1, 4, None, "who"), (2, 0, "system", "alone"), (None, 0, "Cy", "x"), (None, 700, "Cy", "y"), (3, 5, "A", "b"), (3, 5, "A", "a")]


@pytest.mark.parametrize("stretch", [1, 256])
def test_rotation(spark, stretch):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("own")).withColumn("_size", F.lit(1))
    got = chat_rotation.rotate(turns, stretch).collect()
    by: dict = {}
    for r in got:
        by.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(by) == {(1, "Ann"), (1, "Bob"), (None, "Cy"), (3, "A")}
    whole = {}
    for k, rows in by.items():
        rows.sort(key=lambda r: r["start"])
        text = "".join(r["piece"] for r in rows)
        assert [r["start"] for r in rows] == [sum(len(x["piece"]) for x in rows[:i]) for i in range(len(rows))]
        assert all(r["end"] == r["start"] + len(r["piece"]) for r in rows)
        whole[k] = text, [text[r["mask_start"] : r["mask_end"]] for r in rows if r["mask_start"] is not None]
    assert whole[1, "Ann"] == ("<|user:Bob|>\nfirst<|end|>\n<|system|>\nBe kind<|end|>\n<|assistant|>\nHi<|end|>\n<|user:Bob|>\n<|end|>\n<|assistant|>\né 😀<|end|>\n<|user:|>\nwho<|end|>\n", ["Hi<|end|>", "é 😀<|end|>"])
    assert whole[1, "Bob"][1] == ["first<|end|>", "<|end|>"]
    assert whole[3, "A"][1] == ["a<|end|>", "b<|end|>"]
    assert chat_rotation.rotate(turns.limit(0)).count() == 0


def test_archive(spark):
    big, other = "é" * 600, "b" * 1000
    pages = [(1, "http://a/\r\nx", big), (2, None, big), (5, "u", big), (5, "u", big), (3, "v", other), (4, "w", None), (6, "w", ""), (None, "z", big), (7, "q", "<p>\r\n\r\nWARC/1.1")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("address", F.lit("x"))
    folder = warc_store.write_archive(frame)
    read = warc_store.read_archive(spark, folder)
    got = sorted((tuple(r) for r in warc_store.parse_headers(read).select("page_id", "record_type", "refers_to", "payload_digest", "payload").collect()), key=brute.key)
    want = []
    for p, _, html in pages:
        raw = (html or "").encode()
        revisit = html == big and p != 5
        want.append((p, "revisit" if revisit else "response", 5 if revisit else None, hashlib.sha1(raw).hexdigest(), bytearray(raw)))
    assert got == sorted(want, key=brute.key)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4  # stored once
    records = [bytes(r["record"]) for r in warc_store.record_bytes(read).collect()]
    for record in records:
        head, _, rest = record.partition(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == size + 4 and rest.endswith(b"\r\n\r\n") and (size == 0) == (b"WARC-Type: revisit" in head or rest == b"\r\n\r\n")
    empty = warc_store.write_archive(frame.limit(0))
    assert warc_store.read_archive(spark, empty).count() == 0
    spark.createDataFrame([("0" * 64, bytearray(b"changed"))], "address string, payload binary").write.mode("append").parquet(f"{folder}/payloads")
    spark.createDataFrame([(bytearray(b"h"), "0" * 64)], "header binary, address string").write.mode("append").parquet(f"{folder}/records")
    with pytest.raises(Exception, match="payload differs"):
        warc_store.read_archive(spark, folder).collect()


URLS = [
    (1, "http://www.COM/en/x"), (2, "https://a.example.com/en/77?q"), (3, "http://example.com/en/8"), (4, "http://b.net/de/1#f"), (5, "ftp://x.example.net/de/8/y"), (6, "http://w.org/es/"),
    (7, "http://w.org/esx"), (8, None), (9, "no scheme"), (10, ""), (11, "http://"), (12, "http://notcom/en/"), (None, "http://q.xcom/en/1"), (13, "a://b://c/d"), (13, "a://b://c/d"), (14, "http://ÄB.Example.net?x=/de/8"),
]


def url_parts(url):
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", ""
    ends = [i for i, c in enumerate(rest[1]) if c in "/?#"]
    host, tail = rest[1][: ends[0]] if ends else rest[1], rest[1][ends[0] :] if ends else ""
    cuts = [i for i, c in enumerate(tail) if c in "?#"]
    return host.translate(brute.UPPER), tail[: cuts[0]] if cuts else tail


def test_url_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("rule", F.lit(1))
    weights = url_filter.fit([("a.com", "/en/1", True), ("b.net", "/de/2", False)])
    got = sorted((tuple(r) for r in url_filter.judge(pages, weights).select("page_id", "host", "path", "rule", "score", "verdict").collect()), key=brute.key)
    for (p, url), g in zip(sorted(URLS, key=lambda u: (u[0] is None, str(u[0]))), got):
        host, path = url_parts(url)
        fits = [(len(h + r), h + r, v) for v, h, r in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(r)]
        assert g[:4] == (p, host, path, max(fits)[1] if fits else None)
        assert g[5] == (max(fits)[2] if fits else "block" if g[4] > 0 else "allow")
    assert url_filter.judge(pages.limit(0), weights).count() == 0


def test_url_model_on_held_out_urls(spark):
    sf = "/root/testdata/sf0.01"
    labelled = url_filter.rule_labels(spark.read.parquet(f"{sf}/pages.parquet"))
    part = F.pmod(F.xxhash64("path", "host"), F.lit(2))
    weights = url_filter.train(labelled.where(part == 0))
    held = labelled.where(part == 1).collect()
    row, bucket, value = url_filter._features(*(__import__("pyarrow").array([r[c] for r in held]) for c in ("host", "path")))
    score = __import__("numpy").bincount(row, weights[bucket] * value, len(held)) + weights[-1]
    assert sum((s > 0) == r["blocked"] for s, r in zip(score, held)) >= 0.9 * len(held)
    assert (url_filter.fit([]) == 0).all() and url_filter.fit([("a", "", True)])[-1] > 0


def test_pipeline(spark, sf):
    """Every stage against brute force on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns = docs.dtypes
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stored(stage(spark, docs, sf))
        after = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == columns
            left = {r["doc_id"]: r["text"] for r in after}
        if name == "quality_rules":
            failed = {d for d, t in before if brute.quality(t)[5]}
            assert not failed & set(left)
            assert all(d in left for d, _ in before if labels.get(d) == 1 and d not in failed)
        elif name == "ngram_jaccard_join":
            assert set(left) == {d for d, _, c, _ in brute.jaccard(before, 5, 80) if d == c}
        elif name == "decontamination":
            assert set(left) == {d for d, _, hit, _ in brute.contamination(before, items) if not hit}
        elif name == "secret_scan":
            assert set(left) == {d for d, _ in before}
            for d, t in before:
                assert (left[d] == t) == (not brute.secrets(t)) and not brute.secrets(left[d])
        else:
            assert {r["doc_id"] for r in after} == {d for d, _ in before}
            for d, _ in before:
                own = [r for r in after if r["doc_id"] == d]
                assert sum(r["length"] for r in own) == own[0]["doc_tokens"]
    assert corpus_pipeline.run(spark, sf).count() > 0
