from __future__ import annotations

import base64
import hashlib
import io
import random

import pytest

from basketry.llm import queries, warc
from basketry.llm.common import prepare

PAGES = "page_id long, url string, html string, key long, payload string"


def expected(pages):
    largest = {}
    for r in pages:
        text = r.html or ""
        if r.page_id is not None:
            largest[text] = max(r.page_id, largest.get(text, r.page_id))
    for r in pages:
        payload = (r.html or "").encode()
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kept = largest.get(r.html or "")
        revisit = kept != r.page_id
        yield (r.page_id, len(payload), sha, "revisit" if revisit else "response", kept if revisit else None)


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_query(spark, sample_dir):
    pages = spark.read.parquet(f"{sample_dir}/pages.parquet").collect()
    assert ordered(queries.op6_warc(spark, sample_dir).collect()) == ordered(expected(pages))


def test_awkward_pages(spark):
    prepare(spark)
    rows = [
        (1, "http://a/", "same", 7, "x"), (5, None, "same", 7, "x"), (3, "http://b/\r\nX: y", "same", 7, "x"),
        (2, "", None, None, None), (4, "u", "", None, None), (None, "u", "same", None, None),
        (6, "u", "é\x00\r\n\r\nWARC/1.1\r\n" * 2000, 1, ""), (8, "u", "x" * 3_000_000, 1, ""),
    ]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    archives = warc.write_archives(pages, "page_id", "url", "html")
    for size in (997, 1 << 20):
        read = warc.read_archives(archives, range_bytes=size)
        got = read.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert ordered(got) == ordered(expected(pages.collect()))
    payloads = {r.key: bytes(r.payload).decode() for r in read.collect() if r.payload is not None}
    assert payloads[6] == rows[6][2] and payloads[8] == rows[7][2] and payloads[5] == "same"


def test_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    assert warc.read_archives(warc.write_archives(pages, "page_id", "url", "html")).count() == 0


def test_small_payloads_can_be_left_whole(spark):
    pages = spark.createDataFrame([(1, "u", "ab", 0, ""), (2, "u", "ab", 0, "")], PAGES)
    archives = warc.write_archives(pages, "page_id", "url", "html", min_bytes=3)
    assert {r.record_type for r in warc.read_archives(archives).collect()} == {"response"}


class File(io.BytesIO):
    def read_at(self, count, position):
        self.seek(position)
        return self.read(count)


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_each_record_has_one_owner(size):
    inner = warc._member(warc.record(99, "u", b"inside", False, None))
    records = [warc.record(i, "u", b"p%d " % i * i + b"\x1f\x8b\x08" + inner, False, None) for i in range(30)]
    data = b"".join(map(warc._member, records))
    found = [c for start in range(0, len(data), size) for c in warc.members(File(data), start, start + size)]
    assert [c for _, c in found] == records


def test_foreign_bytes_are_skipped_and_damage_is_noticed():
    good = warc.record(1, "u", b"text", False, None)
    data = b"\x1f\x8b\x08junk" + warc._member(b"no record") + warc._member(good) + b"\x1f\x8b\x08\x00"
    assert [c for _, c in warc.members(File(data), 0, len(data))] == [good]
    with pytest.raises(ValueError, match="digest"):
        warc.parse(good.replace(b"text", b"next"))


def test_two_attempts_of_a_task_do_not_mix(spark, tmp_path, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(warc, "new_path", lambda *_: str(tmp_path / "same"))
    rows = [(i, "u", f"page {i} " * (i + 1), 0, "") for i in range(40)]
    tables = []
    for part in (rows, rows[::-1]):  # as two attempts that read their rows in another order
        pages = spark.createDataFrame(part, PAGES).coalesce(1)
        tables.append(warc.write_archives(pages, "page_id", "url", "html", archive_bytes=700))
    for archives in tables:
        assert archives.count() > 3
        assert sorted(r.key for r in warc.read_archives(archives).select("key").collect()) == list(range(40))


def test_long_members_are_not_held_twice():
    payload = random.Random(1).randbytes(6 * warc._BLOCK)
    data = warc._member(warc.record(1, "u", payload, False, None)) + warc._member(warc.record(2, "u", b"x", False, None))
    window = warc._Window(File(data), 0)
    content, length = warc._decode(window)
    assert content.endswith(payload + b"\r\n\r\n")
    assert len(window.data) <= 2 * warc._BLOCK
    assert [c[0] for c in warc.members(File(data), 0, len(data))] == [0, length]
