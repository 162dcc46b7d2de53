import hashlib

import pytest

from stayline.llm import warc
from stayline.session import new_path

LONG = "<p>" + "é WARC/1.1\r\n\r\nWARC-Type: response\r\n" * 5 + "</p>"
DATA = [
    (5, "http://a/\r\nX: y", LONG),
    (3, None, LONG),
    (9, "http://b", LONG),
    (9, "http://b", LONG),
    (1, "http://c", "short"),
    (2, "http://c", "short"),
    (4, "http://d", None),
    (6, "http://d", ""),
    (None, "http://e", LONG),
    (None, "http://e", "x" * 200),
    (8, "u", "y" * 100_000),
    (7, "u", "z" * 99),
    (10, "u", "z" * 99),
    (11, "u", "ü" * 50),
    (12, "u", "ü" * 50),
]


def brute(data):
    first = {}
    for page_id, _, html in data:
        payload = (html or "").encode()
        if len(payload) >= 100 and page_id is not None:
            first[payload] = min(first.get(payload, page_id), page_id)
    rows = []
    for page_id, _, html in data:
        payload = (html or "").encode()
        original = first.get(payload)
        revisit = original is not None and page_id != original
        kind = "revisit" if revisit else "response"
        rows.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), kind, original if revisit else None))
    return sorted(rows, key=str)


def test_round_trip_by_brute_force(spark, rows):
    pages = rows([(*r, "x", 0) for r in DATA], "page_id long, url string, html string, record_type string, payload_bytes int")
    path = new_path(spark, "warc-test")
    warc.write_archives(warc.resolve_revisits(pages), path, records_per_file=4)
    found = warc.read_archives(spark, path).collect()
    digest = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(digest, key=str) == brute(DATA)
    payloads = {r.page_id: bytes(r.payload).decode() for r in found if r.record_type == "response" and r.page_id}
    assert payloads[3] == LONG and payloads[8] == "y" * 100_000 and payloads[4] == ""
    assert all(r.payload is None for r in found if r.record_type == "revisit")


def test_dates_are_utc_in_any_session(spark, rows):
    from datetime import datetime, timedelta, timezone

    pages = warc.resolve_revisits(rows([(1, "u", "x")], "page_id long, url string, html string"))
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            record = warc.records_as_text(pages).first()["record"]
            text = record.split("WARC-Date: ")[1].split("\r\n")[0]
            written = datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
            assert abs(datetime.now(timezone.utc) - written) < timedelta(minutes=5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty_table(spark, rows):
    path = new_path(spark, "warc-test")
    warc.write_archives(warc.resolve_revisits(rows([], "page_id long, url string, html string")), path)
    assert warc.read_archives(spark, path).count() == 0


def test_damage_is_found():
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Length: 1\r\nContent-Length: 5\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(warc._parse((head + "\r\n\r\nx\r\n\r\n").encode()))
    with pytest.raises(ValueError, match="length"):
        list(warc._parse((head + "\r\n\r\nxy\r\n\r\n").encode()))
    with pytest.raises(ValueError, match="no record"):
        list(warc._parse(b"HTTP/1.1 200 OK\r\n\r\n"))
