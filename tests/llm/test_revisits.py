"""Rows that repeat a page_id with different payloads are records of their own."""

import hashlib

from catena.llm import warc


def test_revisits_by_id_and_payload(spark, tmp_path):
    x, y = "x" * 1200, "y" * 1300
    pages = spark.createDataFrame([(5, "a", x), (5, "b", y), (9, "c", x), (10, "d", y), (11, "e", x + y), (11, "f", "z" * 1200)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    got = [(r["page_id"], r["url"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, folder, warc.write(pages, folder)).collect()]
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(5, "a", sha(x), "revisit", 9), (5, "b", sha(y), "revisit", 10), (9, "c", sha(x), "response", None), (10, "d", sha(y), "response", None), (11, "e", sha(x + y), "response", None), (11, "f", sha("z" * 1200), "response", None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
