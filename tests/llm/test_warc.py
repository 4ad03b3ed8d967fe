import base64
import hashlib
import io
import random

import pytest
import zstandard

from scorelens.llm import warc
from scorelens.llm.common import scratch_dir

LONG = "<p>long</p>" * 400_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, min_bytes=0):
    groups = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        groups.setdefault(payload, []).append(page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        ids = [p for p in groups[payload] if p is not None]
        first = min(ids) if ids else None
        revisit = len(payload) >= min_bytes and first is not None and page != first
        out.append((page, len(payload), digest(payload), "revisit" if revisit else "response", first if revisit else None))
    return out


@pytest.fixture(scope="module")
def odd_pages():
    return [
        (1, "http://a.example/é x\r\nWARC-Type: fake", "<html>one</html>"), (2, None, "<html>one</html>"),
        (2, None, "<html>one</html>"), (3, "u", None), (4, "u", ""), (None, "n", "<html>one</html>"), (None, None, None),
        (None, "only", "no id has this"), (5, "w", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
        (6, "l", LONG), (-7, "l", LONG), (8, "z", "nul \x00 and ñ \U0001F600"), (9, "h", "\r\n\r\n\r\n\r\n"),
    ]


def written(spark, rows, **how):
    folder = scratch_dir(spark, "warc-test")
    wide = [(p, u, h, "clash", 0) for p, u, h in rows]
    pages = spark.createDataFrame(wide, "page_id long, url string, html string, digest string, frame int")
    return folder, warc.write_bundles(pages.repartition(3), folder, **how)


@pytest.mark.parametrize("min_bytes", [0, 17])
def test_odd_pages(spark, odd_pages, min_bytes):
    folder, index = written(spark, odd_pages, min_bytes=min_bytes, frame_bytes=300, bundle_bytes=1500)
    got = [tuple(r) for r in warc.page_summary(warc.read_bundles(spark, folder, span=2)).collect()]
    assert sorted(got, key=repr) == sorted(brute(odd_pages, min_bytes), key=repr)
    assert index.count() == len(odd_pages)


def test_payloads_come_back_whole(spark, odd_pages):
    folder, _ = written(spark, odd_pages)
    rows = warc.read_bundles(spark, folder, payloads=True).collect()
    want = {digest((h or "").encode()): (h or "").encode() for _, _, h in odd_pages}
    assert {r.payload_digest: bytes(r.payload) for r in rows if r.payload is not None} == want


def test_bundles_are_plain_zstandard_and_the_index_points_into_frames(spark, odd_pages):
    folder, index = written(spark, odd_pages, frame_bytes=300, bundle_bytes=1500)
    store, path = warc.open_store(f"{folder}/data")
    by_bundle = {}
    for r in index.collect():
        by_bundle.setdefault(r.bundle, []).append(r)
    for name, rows in by_bundle.items():
        raw = open(f"{path}/{name}", "rb").read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        frames = warc.read_seek_table(io.BytesIO(raw), len(raw))
        parts = [zstandard.ZstdDecompressor().decompress(raw[at:at + packed], max_output_size=plain) for at, packed, plain in frames]
        assert b"".join(parts) == whole and whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        for r in rows:
            record = parts[r.frame][r.offset:r.offset + r.length]
            assert f"WARC-Record-ID: {r.record_id}\r\n".encode() in record and record.endswith(b"\r\n\r\n")


def test_fetch_reads_only_what_is_asked(spark, odd_pages):
    folder, _ = written(spark, odd_pages, frame_bytes=300, bundle_bytes=1500)
    wanted = spark.createDataFrame([("<urn:x-page:6>",), ("<urn:x-page:2>",), ("<urn:x-page:-7>",), ("<urn:x-page:99>",)], "record_id string")
    got = warc.fetch_records(spark, folder, wanted).collect()
    assert sorted(r.record_id for r in got) == ["<urn:x-page:-7>", "<urn:x-page:2>", "<urn:x-page:2>", "<urn:x-page:6>"]
    assert [bytes(r.payload) for r in got if r.record_id == "<urn:x-page:-7>"] == [LONG.encode()]


def test_hot_payload_is_merged_over_salts(spark):
    rng = random.Random(5)
    rows = [(i, f"u{i}", "same" if i % 3 else f"page {rng.random()}") for i in range(600)]
    folder, _ = written(spark, rows, salts=4)
    got = [tuple(r) for r in warc.page_summary(warc.read_bundles(spark, folder)).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_no_pages(spark):
    folder, index = written(spark, [])
    assert index.count() == 0 and warc.read_bundles(spark, folder).count() == 0


def test_a_changed_bundle_raises():
    record = warc.page_record(1, "u", b"payload", 7, warc.base32_sha1(b"payload"), None, False, "1970-01-01T00:00:00Z")
    headers, block, end = warc.split_record(record, 0)
    assert end == len(record) and warc.described(headers, block)[6] == b"payload"
    with pytest.raises(ValueError):
        warc.described(headers, block.replace(b"payload", b"PAYLOAD"))
