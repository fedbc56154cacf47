"""Archives: revisits against brute force, and what is saved from damaged files."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from tidemark.llm.files import new_file, shared_folder
from tidemark.llm.warc import archived, read_warc, record, salvage, write_warc


def packed(raw):
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(raw) + member.flush()


def make(i, body):
    return record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None)


def scan(raw, gz, start=0, to=None):
    return list(salvage(pa.BufferReader(raw), len(raw), start, len(raw) if to is None else to, gz))


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "front", "none"])
def test_salvage_finds_later_records_and_logs_gaps(gz, harm):
    parts = [make(i, b"<p>%d</p>" % i * (50 + 40 * i)) for i in range(6)]
    parts = [packed(p) for p in parts] if gz else parts
    ends = [sum(map(len, parts[:i + 1])) for i in range(6)]
    raw = b"".join(parts)
    if harm == "flip":  # damage inside record 2
        at = ends[1] + len(parts[2]) // 2
        raw = raw[:at] + bytes([raw[at] ^ 0x55]) + raw[at + 1:]
        want, gaps = [0, 1, 3, 4, 5], [(ends[1], ends[2])]
    elif harm == "cut":  # the file ends inside record 5
        raw = raw[:ends[4] + len(parts[5]) // 2]
        want, gaps = [0, 1, 2, 3, 4], [(ends[4], len(raw))]
    elif harm == "junk":  # foreign bytes between records 3 and 4
        raw = raw[:ends[3]] + b"\x1f\x8b\x08WARC/1.1 none" * 9 + raw[ends[3]:]
        want, gaps = [0, 1, 2, 3, 4, 5], [(ends[3], ends[3] + 9 * len(b"\x1f\x8b\x08WARC/1.1 none"))]
    elif harm == "front":
        raw = raw[10:]
        want, gaps = [1, 2, 3, 4, 5], [(0, ends[0] - 10)]
    else:
        want, gaps = list(range(6)), []
    items = scan(raw, gz)
    assert [int(i[3]["x-page-id"]) for i in items if i[0] == "record"] == want
    assert [(i[1], i[2]) for i in items if i[0] == "gap"] == gaps
    assert all(i[3] for i in items if i[0] == "gap")


def test_splits_share_no_record():
    raw = b"".join(packed(make(i, b"body %d " % i * 300)) for i in range(40))
    for size in (100, 333, 1000):
        got = [int(i[3]["x-page-id"]) for at in range(0, len(raw), size) for i in scan(raw, True, at, min(len(raw), at + size)) if i[0] == "record"]
        assert got == list(range(40))


@pytest.mark.parametrize("size", [400, 1500, 5000, 10 ** 9])
@pytest.mark.parametrize("harm", [(0, 700), (300, 340), (1490, 1510), (1400, 6200), (2990, 9000), (9000, None), (0, None), (5, 5)])
def test_records_and_gaps_make_up_the_file(harm, size):
    rng = random.Random(4)
    parts = [packed(make(i, bytes(rng.getrandbits(8) for _ in range(300 + 37 * (i % 9))))) for i in range(24)]
    raw = bytearray(b"".join(parts))
    a, b = harm[0], len(raw) if harm[1] is None else harm[1]
    raw[a:b] = bytes(b - a)
    raw = bytes(raw)
    items = [i for at in range(0, len(raw), size) for i in scan(raw, True, at, min(len(raw), at + size))]
    spans = sorted((i[1], i[2], i[0]) for i in items)
    assert [s[0] for s in spans] == [0] + [s[1] for s in spans[:-1]] and spans[-1][1] == len(raw)
    ends = [sum(map(len, parts[:i + 1])) for i in range(24)]
    whole = [i for i in range(24) if ends[i] <= a or ends[i] - len(parts[i]) >= b or a == b]
    assert [int(i[3]["x-page-id"]) for i in items if i[0] == "record"] == whole
    assert sum(i[0] == "gap" for i in items) == (a < b)


@pytest.mark.parametrize("compress", [True, False])
def test_pages_come_back(spark, compress):
    big, other = "same body " * 20, "another body " * 30
    rows = [(5, "http://a b\r\n/x", big, 1), (2, None, big, 1), (9, "u", other, 1), (None, "u", big, 1), (4, "u", None, 1), (3, "u", "", 1), (7, "u", "short", 1),
            (8, "u", "short", 1), (2, None, big, 1), (11, "u", "é" * 50, 1), (12, "u", "é" * 50, 1), (13, "u", "long " * 200_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    files = write_warc(pages, shared_folder(spark, "warc-test"), compress=compress)
    got = read_warc(files, split_bytes=1000).collect()
    assert {r.kind for r in got} == {"record"}
    want = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        first = min((j for j, _, h, _ in rows if j is not None and (h or "").encode() == body), default=None)
        revisit = i is not None and len(body) >= 100 and first < i
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None,
                     None if revisit else body))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
                   for r in got], key=key) == sorted(want, key=key)


def test_damaged_file_is_reported(spark):
    path, stream = new_file(shared_folder(spark, "warc-damaged"), ".warc.gz")
    parts = [packed(make(i, b"x" * 500)) for i in range(3)]
    raw = parts[0] + parts[1][:-8] + b"\0" * 8 + parts[2]
    stream.write(raw)
    stream.close()
    got = read_warc(spark.createDataFrame([(path, len(raw))], "path string, bytes long")).orderBy("offset").collect()
    assert [(r.kind, r.page_id, r.offset) for r in got] == [
        ("record", 0, 0), ("gap", None, len(parts[0])), ("record", 2, len(parts[0]) + len(parts[1]))]


def test_no_pages(spark):
    assert archived(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
