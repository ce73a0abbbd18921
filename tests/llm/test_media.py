import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.media import _SIGNATURE, _chunk, from_png, interleaved, op5_interleaved_media, padded, page_items, resolve, to_png
from tests.llm.conftest import edge_rows


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 9])
def test_stored_form_gives_the_payload_back(data):
    payload = padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[: len(data)] == data and not any(payload[len(data) :])
    assert from_png(to_png(payload)) == payload


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_all_row_filters_are_read(kind):
    rows = np.random.default_rng(kind).integers(0, 256, (5, 64))
    lines = bytearray()
    for y in range(5):
        lines.append(kind)
        for x in range(64):
            a, b, c = (rows[y, x - 1] if x else 0), (rows[y - 1, x] if y else 0), (rows[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines.append(int(rows[y, x] - (a, b, (a + b) // 2, paeth)[kind - 1]) & 255)
    data = _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 5, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(bytes(lines))) + _chunk(b"IEND", b"")
    assert from_png(data) == rows.astype(np.uint8).tobytes()


def test_broken_media_are_refused():
    good = to_png(padded(b"abc"))
    with pytest.raises(ValueError):
        from_png(b"no" + good)
    with pytest.raises(ValueError):
        from_png(good[:40] + bytes([good[40] ^ 1]) + good[41:])


def test_items_keep_order_and_captions():
    html = "<p>one</p><figure><img src='sha256:aa' alt='x'><figcaption>cap &amp; <b>tion</b></figcaption></figure>two<img src=sha256:bb alt=y><img src=http://z/q.png><script>no</script>three"
    got = [(x["position"], x["kind"], x["text"] or x["media"], x["caption"]) for x in page_items(html)]
    assert got == [(0, "text", "one", None), (1, "media", "aa", "cap & tion"), (2, "text", "two", None), (3, "media", "bb", "y"), (4, "text", "three", None)]
    assert page_items(None) == page_items("") == []


def test_unknown_digests_and_pages_without_items(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<img src=sha256:aa>t<img src=sha256:zz>"), (2, None), (1, "<img src=sha256:aa>")], "items long, html string").withColumnRenamed("items", "page")
    spark.createDataFrame([("aa", 5)], "digest string, n int").write.parquet(f"{tmp_path}/m")
    out = resolve(interleaved(pages), spark.read.parquet(f"{tmp_path}/m")).collect()
    got = sorted((r.page, [(x.position, x.media, x.payload and x.payload.n) for x in r["items"] or []]) for r in out)
    assert got == [(1, [(0, "aa", 5)]), (1, [(0, "aa", 5), (1, None, None), (2, "zz", None)]), (2, [])]


def test_exact_round_trip_of_documents(spark, edge_dir, empty_dir):
    rows = op5_interleaved_media(spark, edge_dir).collect()
    want = []
    for i, t, *_ in edge_rows():
        data = (t or "").encode()
        payload = padded(data)
        want.append((str(i), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(to_png(payload)), hashlib.sha256(to_png(payload)).hexdigest()))
    assert sorted(want) == sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows)
    for r in rows:
        assert r.feature.startswith("mean=") and r.position == 2 and r.caption == f"{r.n_bytes} bytes"
        assert (r.absent_position, r.absent_caption, r.absent_unresolved) == (4, "absent", True)
        assert r.texts == "0:A document|1:What is stored:|3:What is not:|5:and the end."
    assert op5_interleaved_media(spark, empty_dir).collect() == []


def test_other_columns_stay(spark, clashing):
    out = interleaved(clashing.withColumn("html", F.lit("<p>x</p>")))
    assert set(out.columns) == {*clashing.columns, "html", "items"} - {"html"}
    assert out.first()["size"] == "own size"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<img src=http://z/q.png alt=q>a<video src=v.mp4></video><img src='data:image/png;base64,AA'>", [("http://z/q.png", "q"), "a", ("v.mp4", None), ("data:image/png;base64,AA", None)]),
        ("<figure><figcaption>first <p>two</p> three</figcaption><img src=sha256:aa alt=x></figure>b", [("aa", "first two three"), "b"]),
        ("<figure><figcaption>alone</figcaption><p>c</figure>d", ["alone", "c", "d"]),
        ("<div><figure><img src=a.png><figcaption>cap</div><p>after", [("a.png", "cap"), "after"]),
        ("<figure><figure><img src=a.png></figure><img src=b.png><figcaption>both</figure>", [("a.png", "both"), ("b.png", "both")]),
        ("<html><head><title>T</title><meta charset=utf-8><body><p>x<img src=a.png>", ["x", ("a.png", None)]),
        ("<head><title>T</title><style>s</style></head><p>x", ["x"]),
        ("<p>x<template><img src=a.png>t</template>y", ["xy"]),
    ],
)
def test_every_reference_and_caption(html, want):
    got = [x["text"] if x["kind"] == "text" else (x["media"], x["caption"]) for x in page_items(html, every=True)]
    assert got == want


def test_operator_keeps_every_reference(spark, tmp_path):
    spark.createDataFrame([("aa", 5)], "digest string, n int").write.parquet(f"{tmp_path}/m")
    pages = spark.createDataFrame([(1, "<img src=http://z/q.png alt=q><img src=sha256:aa>")], "page long, html string")
    (row,) = resolve(interleaved(pages), spark.read.parquet(f"{tmp_path}/m")).collect()
    assert [(x.media, x.caption, x.payload and x.payload.n) for x in row["items"]] == [("http://z/q.png", "q", None), ("aa", None, 5)]


def test_payload_bytes_can_be_resolved_too(spark, tmp_path):
    """Any columns of the store go along, its bytes included; items stay in order."""
    data = to_png(padded(b"some bytes"))
    digest = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(digest, bytearray(data))], "digest string, media binary").write.parquet(f"{tmp_path}/m")
    pages = spark.createDataFrame([(i, f"a{i}<img src=sha256:{digest}>b<img src=sha256:{digest}>c") for i in range(20)], "page long, html string")
    for r in resolve(interleaved(pages), spark.read.parquet(f"{tmp_path}/m")).collect():
        assert [x.text or from_png(bytes(x.payload.media)).rstrip(b"\0").decode() for x in r["items"]] == [f"a{r.page}", "some bytes", "b", "some bytes", "c"]


def test_items_of_given_pages(spark):
    """Texts of whole pages, in order, without scripts and styles."""
    for r in interleaved(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect():
        assert [x.position for x in r["items"]] == list(range(len(r["items"]))) and len(r["items"]) > 5
        assert not any("track(" in x.text or "margin:0" in x.text for x in r["items"] if x.text)


def test_equal_texts_have_equal_values(spark, edge_dir):
    rows = {}
    for r in op5_interleaved_media(spark, edge_dir).collect():
        values = r.asDict()
        del values["doc_id"]
        rows.setdefault(r.payload_sha256, set()).add(tuple(values.items()))
    assert all(len(x) == 1 for x in rows.values()) and len(rows) < 25
