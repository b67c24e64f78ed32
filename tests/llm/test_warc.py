from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import graph, warc

SCHEMA = "page_id long, url string, html string"


def expected(pages: list[tuple]) -> list[tuple]:
    least: dict[str, int | None] = {}
    for page_id, _, html in pages:
        seen = least.get(html or "")
        least[html or ""] = seen if page_id is None else page_id if seen is None else min(seen, page_id)
    out = []
    for page_id, _, html in pages:
        body, first = (html or "").encode(), least[html or ""]
        new = first is None or page_id == first
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if new else "revisit", None if new else first))
    return sorted(out, key=str)


def odd_pages() -> list[tuple]:
    """Nulls, empty, very long and repeated payloads, repeated rows, urls of one host, without host, with line breaks."""
    rng = random.Random(2)
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "x"), (None, "http://a.net/", "only without id"), (None, "http://a.net/", "hot"), (5, "HTTP://User@A.Net:80/x\r\ny\tz?q#f", "hot"), (5, "http://a.net/", "twice"), (5, "http://a.net/", "twice"), (6, "http://a.net/", "twice")]
    rows += [(7, "http://b.org/Ä ö", "ü" * 200_000), (8, "http://b.org/", "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\n"), (-4, "://", "hot")]
    return rows + [(100 + i, f"https://www.{rng.choice(['one', 'two'])}.example.com/{rng.randint(0, 40)}", rng.choice(["hot", f"page {i}", f"page {i // 2}"])) for i in range(400)]


def write(spark, folder: str, rows: list[tuple]) -> str:
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "sha", "first", "n", "revisit", "payload", "file")}).repartition(4).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("few", [warc.FEW, 0])
def test_odd_pages_come_back(spark, tmp_path, monkeypatch, few):
    """Also if repeated payloads aren't broadcast and one of them is hot."""
    monkeypatch.setattr(warc, "FEW", few)
    if not few:
        monkeypatch.setattr(graph, "FLOOR", 20)
    rows = odd_pages()
    found = warc.op13_two_level_index(spark, write(spark, str(tmp_path), rows))
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows)


def test_given_pages(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op13_two_level_index(spark, small).collect()), key=str) == expected(rows)


def test_archives_are_plain_warc(spark, tmp_path):
    """Each archive, unpacked as a whole, is a sequence of records whose lengths add up; one for each page and archive."""
    rows = odd_pages()
    warc.archived(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_path}/w")
    kinds, files = Counter(), glob.glob(f"{tmp_path}/w/records/*.warc.gz")
    assert len(files) <= 3
    for f in files:
        data = gzip.open(f).read()
        while data:
            top, _, rest = data.partition(b"\r\n\r\n")
            assert top.startswith(b"WARC/1.1\r\nWARC-Type: ")
            head = dict(x.split(b": ", 1) for x in top.split(b"\r\n")[1:])
            n = int(head[b"Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            kinds[head[b"WARC-Type"]] += 1
            data = rest[n + 4 :]
    assert kinds[b"warcinfo"] == len(files) and kinds[b"response"] + kinds[b"revisit"] == len(rows)


def test_search_reads_few_blocks(spark, tmp_path, monkeypatch):
    """A lookup reads one directory and at most two blocks for a key; all captures of a url are found, others aren't."""
    rows = [(i, f"http://h{i % 97}.example.org/{i % 900}", f"p{i}") for i in range(5_000)]
    monkeypatch.setattr(warc, "LINES", 50)
    df = spark.createDataFrame(rows, SCHEMA)
    key = {tuple(r) for r in df.select("page_id", warc.url_key(F.col("url")).alias("key")).collect()}
    records = [(k, i, "f", i, 1, "response", "d") for i, k in key]
    records.sort(key=lambda r: warc._place(r[0], r[1]))
    import pyarrow as pa

    batches = lambda part: [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), warc._RECORDS.types, strict=True)], schema=warc._RECORDS)]
    files = []
    for part in (records[:1700], records[1700:3000], records[3000:]):
        b = next(iter(warc._indexer(f"file://{tmp_path}")(batches(part))))
        files.append((warc._place(b["key"][0].as_py(), b["page_id"][0].as_py()), b["name"][0].as_py()))
    search = warc.Search(warc.Archive("", f"file://{tmp_path}", tuple(files), 0))
    by_key = defaultdict(set)
    for i, k in key:
        by_key[k].add(i)
    for k in [*list(by_key)[:200], "aa", "zz", "org,example,h1)/"]:
        before = list(search.reads)
        assert {int(r[1]) for r in search.between((k.encode(), (0, 0)), (k.encode(), (2, 0)))} == by_key.get(k, set())
        assert search.reads[0] - before[0] <= 2 and search.reads[1] - before[1] <= 3
    i, k = next(iter(key))
    assert [r[1] for r in search.between(warc._place(k, i), warc._place(k, i))] == [str(i)]


def test_captures_of_a_url(spark, tmp_path):
    rows = odd_pages()
    archive = warc.archived(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/w")
    asked = spark.createDataFrame([("http://a.net/",), ("http://A.net/#top",), ("http://nowhere.net/",)], "url string")
    found = warc.looked_up(archive, asked).collect()
    assert sorted((r.page_id for r in found), key=str) == sorted((p for p, u, _ in rows if u == "http://a.net/"), key=str)


def test_damage_is_noticed(spark, tmp_path):
    raw, _ = warc.record(1, "http://a.net/", b"payload", None, False)
    assert warc.parsed(raw)[:2] == (1, 7)
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(raw.replace(b"payload", b"paylord"))
    archive = warc.archived(spark.createDataFrame(odd_pages(), SCHEMA), f"{tmp_path}/w")
    found = warc.looked_up(archive, spark.createDataFrame(odd_pages(), SCHEMA).select("url"))
    for f in glob.glob(f"{tmp_path}/w/records/*.warc.gz"):
        data = open(f, "rb").read()
        open(f, "wb").write(data[:300] + bytes(b ^ 255 for b in data[300:2000]) + data[2000:])
    with pytest.raises(Exception, match="damaged|zlib|Error"):
        warc.read_back(archive, found).collect()


def test_smaller_payloads_are_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    archive = warc.archived(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/w", least=3)
    found = warc.read_back(archive, warc.looked_up(archive, spark.createDataFrame(rows, SCHEMA).select("url"))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op13_two_level_index(spark, str(tmp_path)).count() == 0


def test_members_are_alike():
    assert zlib.decompress(warc._packed(b"x"), 31) == b"x" and warc._packed(b"x") == warc._packed(b"x")
