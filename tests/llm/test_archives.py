"""WARC files: members side by side, damage, zero bytes between members, and how much is read."""

import gzip
import io
import zlib

import pytest

from chirplake.llm import warc
from chirplake.llm.warc import member, range_records, read_warc, write_warc


def whole(data):
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def made(k, size=200, head=None):
    body = bytes(f"{k} " * size, "ascii")
    return head or warc.record("response", k, f"http://x/{k}", None, body, "", len(body))


class Counted(io.BytesIO):
    total = 0

    def read(self, *n):
        out = super().read(*n)
        self.total += len(out)
        return out


def test_members_stand_side_by_side(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"<p>{k % 7}</p>" * (k + 1)) for k in range(60)] + [(100, None, "z" * (17 << 20)), (101, "u", "behind the long one")]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), str(tmp_path / "w"))
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert files and not list((tmp_path / "w").glob("*.txt"))
    for f in files:
        raw, at = f.read_bytes(), 0
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        while at < len(raw):
            gz = zlib.decompressobj(31)
            data = gz.decompress(raw[at:])
            assert gz.eof and data.startswith(b"WARC/1.1")
            at = len(raw) - len(gz.unused_data) + (len(data) >= 1 << 24)  # one zero byte behind a long one alone
    got = {r.record_id: bytes(r.payload) for r in read_warc(spark, str(tmp_path / "w"), 1000).where("warc_type <> 'warcinfo'").collect()}
    assert got == {f"urn:page:{k}": t.encode() for k, _, t in rows}


def test_each_byte_is_read_once_and_each_record_owned_once():
    raw = b"".join(whole(made(k)) for k in range(400))
    file = Counted(raw)
    assert len(list(range_records(file, 0, len(raw)))) == 400 and file.total <= len(raw) + 10
    for split in (1, 53, 700, 5000):
        if split == 1:
            found = [r for a in range(0, 3000) for r in range_records(io.BytesIO(raw[:4000]), a, a + 1)]
            assert len({r[0] for r in found}) == len(found)
        else:
            places = [r[0] for a in range(0, len(raw), split) for r in range_records(io.BytesIO(raw), a, min(a + split, len(raw)))]
            assert len(places) == len(set(places)) == 400


@pytest.mark.parametrize("length", ["abc", "-", ""])
def test_damage_gives_a_fault_and_reading_goes_on(spark, tmp_path, length):
    broken = bytearray(whole(made(1)))
    broken[len(broken) // 2] ^= 255
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + length.encode() + b"\r\n\r\nx\r\n\r\n"
    raw = whole(made(0)) + bytes(broken) + b"\0\0\0" + whole(made(2)) + whole(bad) + b"junk \x1f\x8b\x08 junk" + whole(b"not a record") + whole(made(3)) + whole(made(4))[:-9]
    (tmp_path / "a.warc.gz").write_bytes(raw)
    for split in (64, 1 << 20):
        rows = read_warc(spark, str(tmp_path), split).collect()
        fine = sorted(r.record_id for r in rows if r.fault is None)
        assert fine == ["urn:page:0", "urn:page:2", "urn:page:3"] and len([r for r in rows if r.fault]) == 3
        assert sorted(r.offset for r in rows)[0] == 0 and len({r.offset for r in rows}) == len(rows)


def test_member_leaves_a_zero_byte_to_the_separator():
    assert member(b"x" * 1000) + b"\0" == whole(b"x" * 1000)


def inner(k):
    """A record whose payload is an archive: gzipped and plain records as they are, stored without compression."""
    body = whole(made(900 + k)) + b" text " + made(950 + k, 3) + b"\r\n\r\n" + made(970 + k, 3) + whole(made(990 + k))
    data = warc.record("response", k, f"http://x/{k}", None, body, "", len(body))
    gz = zlib.compressobj(0, zlib.DEFLATED, 31)
    return data, gz.compress(data) + gz.flush()


@pytest.mark.parametrize("split", [64, 100, 1000, 32 << 20])
def test_archives_within_payloads_are_no_records_at_any_split(spark, tmp_path, split):
    parts = [inner(k) for k in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(whole(made(10 + k)) + gz for k, (_, gz) in enumerate(parts)))
    (tmp_path / "b.warc").write_bytes(b"".join(made(20 + k) + data for k, (data, _) in enumerate(parts)))
    rows = read_warc(spark, str(tmp_path), split).collect()
    found = sorted((r.path[-6:], r.record_id.removeprefix("urn:page:")) for r in rows)
    assert found == sorted([("arc.gz", str(k)) for k in (0, 1, 2, 10, 11, 12)] + [("b.warc", str(k)) for k in (0, 1, 2, 20, 21, 22)]) and not [r for r in rows if r.fault]


@pytest.mark.parametrize("split", [90, 1 << 20])
def test_several_records_of_a_member(spark, tmp_path, split):
    (tmp_path / "a.warc.gz").write_bytes(whole(made(1) + made(2) + made(3)) + whole(made(4)) + whole(made(5) + b"junk"))
    rows = read_warc(spark, str(tmp_path), split).orderBy("offset", "nth").collect()
    assert [(r.record_id, r.nth, r.fault) for r in rows] == [(f"urn:page:{k}", n, None) for k, n in ((1, 0), (2, 1), (3, 2), (4, 0), (5, 0))] + [(None, 1, "trailing bytes")]


@pytest.mark.parametrize("stated", [b"-5", b"9999", b"", b"3"])
@pytest.mark.parametrize("packed", [True, False])
def test_lengths_are_not_believed(spark, tmp_path, stated, packed):
    wrong = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: " + stated + b"\r\n\r\npayload\r\n\r\n"
    parts = [made(1), wrong, made(2)]
    if packed:
        (tmp_path / "a.warc.gz").write_bytes(b"".join(map(whole, parts)))
    else:
        (tmp_path / "a.warc").write_bytes(b"".join(parts))
    rows = read_warc(spark, str(tmp_path), 1 << 20).collect()
    assert {r.record_id for r in rows if r.fault is None} >= {"urn:page:1"} | ({"urn:page:2"} if packed or stated != b"9999" else set())
    assert all(r.payload is None for r in rows if r.fault in ("length", "truncated")) and any(r.fault for r in rows) and not any(r.record_id == "urn:page:9" and r.fault is None for r in rows)


def test_bytes_of_responses_are_counted(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(whole(warc.record("response", 1, "u", None, b"12345", "", 99)) + whole(warc.record("revisit", 2, "u", 1, None, "", 5)))
    rows = {r.record_id: r for r in read_warc(spark, str(tmp_path)).collect()}
    assert (rows["urn:page:1"].payload_bytes, rows["urn:page:1"].fault) == (5, "http length") and (rows["urn:page:2"].payload_bytes, rows["urn:page:2"].fault) == (5, None)
    assert "payload" not in read_warc(spark, str(tmp_path), payload=False).columns
