import gzip
import hashlib
import random

from inkwell.llm import warc
from inkwell.llm.common import scratch


def record(number, payload, kind=b"response"):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = (
        b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha256:%s\r\n"
        b"Content-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n"
    ) % (kind, number, hashlib.sha256(payload).hexdigest().encode(), len(block))
    return head + block + b"\r\n\r\n"


def found(data):
    out = list(warc.salvage(data))
    # every byte belongs to a record or a gap, in order
    end = 0
    for _, a, b, _ in out:
        assert a == end and b > a
        end = b
    assert end == len(data)
    return [x[3]["id"] for x in out if x[0] == "record"], [(x[1], x[2], x[3]) for x in out if x[0] == "gap"]


def test_salvage_of_plain_archives():
    parts = [record(i, b"page %d " % i * 50) for i in range(4)]
    ids = [f"<urn:page:{i}>" for i in range(4)]
    assert found(b"".join(parts)) == (ids, [])
    cut = parts[0] + parts[1][:-40] + parts[2] + parts[3]
    assert found(cut) == (ids[:1] + ids[2:], [(len(parts[0]), len(parts[0]) + len(parts[1]) - 40, "block does not end where its length says")])
    flipped = bytearray(parts[1])
    flipped[-10] ^= 1
    assert found(parts[0] + bytes(flipped) + parts[2])[1][0][2] == "payload digest differs"
    assert found(b"junk" + parts[0] + b"tail") == (ids[:1], [(0, 4, "no version line"), (4 + len(parts[0]), 8 + len(parts[0]), "no version line")])
    assert found(b"") == ([], [])
    inner = record(9, b"about WARC/1.1\r\nrecords")
    assert found(inner + parts[0]) == (["<urn:page:9>", ids[0]], [])


def test_salvage_of_gzip_members():
    members = [gzip.compress(record(i, b"page %d " % i * 50)) for i in range(3)]
    ids = [f"<urn:page:{i}>" for i in range(3)]
    assert found(b"".join(members)) == (ids, [])
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 255
    got, gaps = found(members[0] + bytes(broken) + members[2] + record(7, b"plain"))
    assert got == [ids[0], ids[2], "<urn:page:7>"]
    assert [(a, b) for a, b, _ in gaps] == [(len(members[0]), len(members[0]) + len(broken))]
    assert found(members[0] + members[1][:-9])[0] == ids[:1]


def test_round_trip(spark):
    long = "é" * 80
    rows = [
        (3, "http://a", long, 1), (1, "http://b\r\nx", long, 1), (1, "http://b", long, 1), (2, None, "short", 2), (5, "u", "short", 2),
        (6, "u", None, None), (None, "u", long, 0), (7, "u", "", 0), (8, "u", "a\r\n\r\nWARC/1.1\r\n" * 9, 0),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id long")
    path = scratch(spark, "archives")
    warc.write_warc(warc.mark_revisits(pages), path)
    got = warc.read_warc(spark, path).collect()
    assert {r.kind for r in got} == {"record"}
    seen = sorted((r.id[10:-1], r.type, r.n_bytes, r.refers_to and r.refers_to[10:-1], bytes(r.payload or b"").decode()) for r in got)
    # rows that repeat the smallest id are responses, a null id refers to it
    assert seen == sorted([
        ("3", "revisit", 160, "1", ""), ("1", "response", 160, None, long), ("1", "response", 160, None, long), ("none", "revisit", 160, "1", ""),
        ("2", "response", 5, None, "short"), ("5", "response", 5, None, "short"), ("6", "response", 0, None, ""), ("7", "response", 0, None, ""),
        ("8", "response", len(rows[8][2]), None, rows[8][2]),
    ])
    empty = scratch(spark, "no-archives")
    warc.write_warc(warc.mark_revisits(pages.where("false")), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_salvage_inside_a_member_of_many_records():
    rnd = random.Random(2)
    parts = [record(i, rnd.randbytes(3000)) for i in range(40)]
    ids = [f"<urn:page:{i}>" for i in range(40)]

    def ids_and_gaps(data):
        out = list(warc.salvage(data))
        return [x[3]["id"] for x in out if x[0] == "record"], [x[3] for x in out if x[0] == "gap"]

    bad = parts[5][:-20] + b"?" + parts[5][-19:]
    start = len(b"".join(parts[:5]))
    whole = gzip.compress(b"".join([*parts[:5], bad, *parts[6:]]))
    assert ids_and_gaps(whole) == (ids[:5] + ids[6:], [f"payload digest differs (bytes {start} to {start + len(bad)} of the member)"])
    for level in (0, 6):
        member = gzip.compress(b"".join(parts), level)
        after = gzip.compress(record(99, b"next"))
        for cut in (member[: len(member) // 2], member[:-9]):
            got, gaps = ids_and_gaps(cut)
            assert got == ids[: len(got)] and len(got) >= 18 and gaps
            got, _ = ids_and_gaps(cut + after)
            assert len(got) == len(set(got)) and got[-1] == "<urn:page:99>" and len(got) >= 19
        sums = bytearray(member)
        sums[-6] ^= 1
        got, gaps = ids_and_gaps(bytes(sums) + after)
        assert got[:39] == ids[:39] and got[-1] == "<urn:page:99>" and len(got) == len(set(got)) and "gzip member" in gaps[0]
