import base64
import hashlib

import pytest

from checks.compare import compare, connect
from rolecall.llm import warc
from rolecall.llm.warc import OP8_SQL, op8_warc, parse, read_archives, resolve, write_archives


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), sf, op8_warc, OP8_SQL) is None


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, _key string, payload_bytes int")


def test_round_trip(spark, tmp_path):
    odd = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n<é>\x00"
    rows = [(1, "http://a/b c", odd), (2, None, odd), (3, "u", None), (4, "u", ""), (5, "u", "y" * 400_000), (None, "u", odd), (6, "u", "z"), (6, "u", "z")]
    path = str(tmp_path / "warc")
    write_archives(pages(spark, rows), path)
    records = read_archives(spark, path, payloads=True)
    found = records.collect()
    assert len(found) == len(rows)
    kept = {r.page_id: r.payload for r in found if r.record_type == "response"}
    assert kept[2] == odd and kept[5] == "y" * 400_000 and kept[4] == "" and kept[6] == "z"
    got = {(r.page_id, r.record_type): r for r in resolve(records.drop("payload")).collect()}
    assert got[1, "revisit"].refers_to == 2 and got[None, "revisit"].refers_to == 2
    assert got[3, "revisit"].refers_to == 4 and got[6, "revisit"].refers_to == 6
    raw = odd.encode()
    assert got[1, "revisit"].payload_bytes == len(raw)
    assert got[1, "revisit"].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_least_bytes(spark, tmp_path):
    path = str(tmp_path / "warc")
    write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), path, least=3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in resolve(read_archives(spark, path)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "warc")
    write_archives(pages(spark, []), path)
    assert resolve(read_archives(spark, path)).count() == 0


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        list(parse(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n"))


def test_many_pages_share_a_payload(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(pages(spark, [(i, "u", "same" if i % 3 else f"own {i}") for i in range(300)]), path)
    got = resolve(read_archives(spark, path))
    assert got.filter("record_type = 'response'").count() == 101
    assert {r.refers_to for r in got.filter("record_type = 'revisit'").collect()} == {299}
