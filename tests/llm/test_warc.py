import base64
import hashlib
from pathlib import Path

import pytest
import zstandard

from brightmill.llm import warc

SCHEMA = "page_id bigint, url string, html string, offset int"


def check(rows, folder):
    files = {p.name: p.read_bytes() for p in Path(folder).glob("*.warc.zst")}
    records = {n: warc.read_file(b) for n, b in files.items()}
    assert {r.warc_file for r in rows} == set(files) and sum(map(len, records.values())) == len(rows)
    seen = {}
    for r in rows:
        text = records[r.warc_file][r.record_no]
        head, body = text.split(b"\r\n\r\n", 1)
        body = body[:-4]
        assert len(body) == r.payload_bytes and r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        data = files[r.warc_file]
        size = int.from_bytes(data[4:8], "little")
        alone = data[: 8 + size] + data[r.offset : r.offset + r.length]
        assert warc.read_file(alone) == [text]
        uri = next(x for x in head.split(b"\r\n") if x.startswith(b"WARC-Target-URI"))
        seen.setdefault(r.page_id, []).append((uri.split(b": ", 1)[1].decode(), body))
    return seen, records


def test_round_trip_of_the_table(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = warc.write(pages, f"file://{tmp_path}/w").collect()
    seen, _ = check(rows, tmp_path / "w")
    for p in pages.collect():
        assert any(body.decode() == p.html for _, body in seen[p.page_id])
    assert any(int.from_bytes(f.read_bytes()[4:8], "little") for f in (tmp_path / "w").glob("*.zst"))


def test_awkward_rows_and_many_files(spark, tmp_path):
    page = "<p>some words that come again and again</p>" * 40
    rows = [(i, f"https://e.example/{i}", page + str(i), 1) for i in range(60)] + [(None, None, None, None), (1, "a b\r\nX: y", "", 2), (1, "a b\r\nX: y", "", 2), (2, "https://ü", "ä" * 300_000, 3)]
    got = warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}/w", limit=20_000).collect()
    assert len({r.warc_file for r in got}) > 1
    seen, records = check(got, tmp_path / "w")
    assert seen[None] == [("urn:null", b"")] and ("a%20b%0D%0AX:%20y", b"") in seen[1] and len(got) == 64
    ids = [line for x in records.values() for r in x for line in r.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(ids)) == 64


def test_dictionary_skips_no_positions_or_samples():
    records = [warc.record(f"https://e.example/{i}", f"<p>word{i % 37} of {i * i} and {i % 11}</p>".encode() * (1 + i % 9), str(i))[0] for i in range(400)]
    trained = lambda accel: zstandard.train_dictionary(sum(map(len, records)) // 10, records, k=512, d=8, f=20, accel=accel, level=warc.LEVEL, notifications=0).as_bytes()
    assert warc.dictionary(records) == trained(1) != trained(4)


def frames(data):
    """Frames of a file by the format's own rules: (kind, dictionary id, content size, bytes), without a library."""
    at, out = 0, []
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            out.append(("skippable", None, size, data[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        assert magic == 0xFD2FB528
        begin, flags = at, data[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        id_bytes, size_bytes = (0, 1, 2, 4)[flags & 3], (single, 2, 4, 8)[flags >> 6]
        at += 5 + (not single)
        word = int.from_bytes(data[at : at + id_bytes], "little")
        at += id_bytes
        size = int.from_bytes(data[at : at + size_bytes], "little") + 256 * (size_bytes == 2)
        at += size_bytes
        while True:
            head = int.from_bytes(data[at : at + 3], "little")
            at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
        at += 4 * checksum
        out.append(("frame", word, size, data[begin:at]))
    return out


@pytest.mark.parametrize("n", [1, 3, 400])
def test_frames_by_an_independent_parser(n):
    """One leading skippable frame with the dictionary, then a frame per record that refers to it and needs it."""
    records = [warc.record(f"https://e.example/{i}", f"<p>word{i % 37} of {i * i} and {i % 11}</p>".encode() * (1 + i % 9), str(i))[0] for i in range(n)]
    data, where = warc.file_bytes(records)
    first, *rest = frames(data)
    assert first[0] == "skippable" and int.from_bytes(data[:4], "little") == 0x184D2A5D and first[2] > 0 and len(rest) == n
    trained = first[3][:4] == bytes.fromhex("37a430ec")
    word = int.from_bytes(first[3][4:8], "little") if trained else 0
    assert trained == (n == 400) and {f[1] for f in rest} == {word} and [f[2] for f in rest] == [len(r) for r in records]
    assert [data[a : a + b] for a, b in where] == [f[3] for f in rest]
    alone = zstandard.ZstdCompressor(level=warc.LEVEL, write_checksum=True)
    assert sum(len(f[3]) for f in rest) < sum(len(alone.compress(r)) for r in records)
    assert warc.read_file(data) == records


def test_empty_table(spark, tmp_path):
    assert warc.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w").count() == 0
    with pytest.raises(ValueError):
        warc.read_file(b"12345678")
