"""Archives and index: exact round trip, revisits, lookups across blocks and ranges."""
import gzip
import hashlib

from pyarrow import fs

from evisets.llm import warc

SCHEMA = "page_id long, url string, html string, entry string, file string"


def pages(spark):
    same = "<p>" + "x" * 200
    rows = [(5, "http://www.example.org/a?q=1#f", same), (3, "https://user@sub.example.org:8080/b", same), (9, None, same), (1, "http://[bad", "tiny"), (2, "", "tiny"),
            (4, "http://example.org", None), (6, "http://example.org/", "é" * 50 + "中"), (7, "http://example.org/ space\n", "é" * 50 + "中"), (3, "https://user@sub.example.org:8080/b", same),
            (8, "http://a.b/c", "y" * 300_000)]
    return spark.createDataFrame([(*r, "e", "f") for r in rows], SCHEMA)


def test_keys_reverse_hosts():
    assert warc.url_key("http://www.Example.org/a?q=1#f") == "org,example,www)/a?q=1"
    assert warc.url_key("http://example.org") == "org,example)/" and warc.url_key(None) == ")/"
    assert " " not in warc.url_key("http://example.org/a b\tc")


def test_round_trip(spark):
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages(spark)).collect())
    rows, first = pages(spark).collect(), {}
    for r in rows:
        data = (r.html or "").encode()
        if len(data) >= 100:
            first[data] = min(first.get(data, r.page_id), r.page_id)
    want = []
    for r in rows:
        data = (r.html or "").encode()
        of = first.get(data, r.page_id)
        want.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if of == r.page_id else "revisit", None if of == r.page_id else of))
    assert got == sorted(want, key=lambda x: x[:4])
    assert warc.archived(pages(spark).where("false")).count() == 0


def test_records_are_plain_warc_and_payloads_come_back(spark):
    folder = warc.new_folder(spark, "test")
    manifest = warc.write(pages(spark), folder)
    m = next(r for r in manifest.collect() if r.capture == 6)
    where, name = warc.at(m.file)
    text = gzip.decompress(where.open_input_file(name).read_at(m.length, m.offset)).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("é" * 50 + "中\r\n\r\n")
    ranges = warc.index(manifest, folder, block=2)
    back = warc.lookup(pages(spark), ranges).collect()
    assert {(r.capture, r.url): bytes(r.payload).decode() for r in back if r.payload is not None}[8, "http://a.b/c"] == "y" * 300_000
    assert sum(r.capture == 3 for r in back) == 2  # repeated rows are two records
    assert warc.lookup(spark.createDataFrame([(77, "http://example.org/", "", "", "")], SCHEMA), ranges).count() == 0


def test_equal_entries_reach_over_blocks():
    where, path = fs.FileSystem.from_uri("/tmp")
    import json
    import tempfile
    import zlib
    folder = tempfile.mkdtemp()
    lines = [f"k{i // 5} 0\tf\t{i}\t1" for i in range(23)]
    directory, raw = [], b""
    for a in range(0, 23, 3):
        z = zlib.compress("\n".join(lines[a : a + 3]).encode())
        directory.append(json.dumps([lines[a].split("\t")[0], len(raw), len(z)]))
        raw += z
    for name, data in (("x.cdx", raw), ("x.dir", "\n".join(directory).encode())):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    index = warc.Index([("k0 0", "k4 0", f"{folder}/x.cdx", f"{folder}/x.dir")])
    for k in range(5):
        assert [x[1] for x in index.find(f"k{k} 0")] == [i for i in range(23) if i // 5 == k]
    assert list(index.find("k9 0")) == [] == list(index.find("a"))
