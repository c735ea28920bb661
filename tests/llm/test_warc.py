"""Bundles: exact round trip, seeking, and record kinds against a plain grouping."""

import io

import zstandard

from isopleth.llm import warc


def test_bundle():
    sink = io.BytesIO()
    writer = warc.BundleWriter(sink, frame_bytes=2000)
    payloads = {i: (f"<p>{i} é</p>\r\n\r\n" * (i % 50)).encode() for i in range(200)}
    for i, payload in payloads.items():
        writer.add(i, warc.record(i, f"http://x.org/{i} a", payload, None, False))
    writer.add(500, warc.record(500, None, payloads[7], 7, True))
    writer.close()
    data = sink.getvalue()
    reader = warc.BundleReader(io.BytesIO(data))
    assert len(reader.frames) > 20
    for i in (0, 3, 77, 199):
        (found,) = reader.get(i)
        assert found["payload"] == payloads[i] and found["url"] == f"http://x.org/{i}%20a"
    (revisit,) = reader.get(500)
    assert (revisit["refers_to"], revisit["payload"], revisit["payload_bytes"], revisit["payload_digest"]) == (7, b"", len(payloads[7]), warc.payload_digest(payloads[7]))
    assert reader.get(300) == [] and len(list(reader.scan())) == 201
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1") == 201  # any Zstandard reader takes the bundle for one stream


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"page {i % 7}" if i % 2 else None) for i in range(60)] + [(None, None, "page 3"), (5, "http://h/5", "page 5"), (90, "u", "lone\r\n\r\none é")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, first int, salt int")
    found = warc.warc_round_trip(pages).collect()
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(first.get(html or "", key), key)
    expected = []
    for key, _, html in rows:
        payload, head = (html or "").encode(), first[html or ""]
        expected.append((key, len(payload), warc.payload_digest(payload), "response" if key == head else "revisit", None if key == head else head))
    order = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, found), key=order) == sorted(expected, key=order)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.warc_round_trip(pages, least_bytes=100).collect()} == {"response"}
