import base64
import hashlib
import io
import struct
import zipfile

from vacantis.llm.archive import Package, directory, parsed, read_package, record, round_trip, stored_bytes


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows],
                                 "page_id long, url string, html string, sha string, refers_to string")


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(h or "") if i is not None else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "revisit" if to is not None and to != i else "response", to if to != i else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(k, f"http://a/{k} x", f"<p>é{k % 7}</p>\r\n\r\n" * (k % 5)) for k in range(90)]
    rows += [(200, None, None), (201, "", ""), (None, "http://n", "<p>é1</p>\r\n\r\n"), (90, "u", "w" * 3_000_000), (3, rows[3][1], rows[3][2])]
    got = round_trip(pages_of(spark, rows).repartition(4)).collect()
    assert all(r.intact for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)


def test_least_bytes_and_empty_table(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    got = round_trip(pages_of(spark, rows), least_bytes=3).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: None, 4: 3}
    assert round_trip(pages_of(spark, [])).collect() == []


def test_central_and_zip64_directories():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for k in range(66_000):  # more members than the plain end record can count
            z.writestr(f"m{k}", b"")
        with z.open("big", "w", force_zip64=True) as m:
            m.write(b"hello")
        z.comment = b"a note"
    size = data.getbuffer().nbytes
    members = directory(data, size)
    assert len(members) == 66_001
    begin, n = stored_bytes(data, members["big"])
    assert data.getvalue()[begin:begin + n] == b"hello"


def test_zip64_places_in_the_extra_field():
    """A member whose sizes and place stand in the 64-bit extra field."""
    name, body = b"archive/x", b"payload"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name
    local += struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra),
                                          0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    wide = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(local) + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = local + central + wide + locator + end
    source = io.BytesIO(whole)
    begin, n = stored_bytes(source, directory(source, len(whole))["archive/x"])
    assert whole[begin:begin + n] == body


def test_package_is_a_plain_zip(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "p.wacz")
    p = Package(fs.LocalFileSystem(), path)
    for k in range(300):
        p.add(record(str(k), f"http://x/{k}", b"z" * k, None if k % 3 else "7"))
    p.close()
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and len(z.namelist()) == 2
    data = open(path, "rb")
    got = list(read_package(data, len(open(path, "rb").read())))
    assert [r["warc-record-id"] for r in got] == [f"<urn:page:{k}>" for k in range(300)]
    assert [len(r["payload"]) for r in got] == [k if k % 3 else 0 for k in range(300)]
    assert parsed(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n")["payload"] == b""
