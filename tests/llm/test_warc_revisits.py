import gzip
import re

from tidemark.llm import warc


def test_revisits_name_the_url_of_their_response(spark, docs, tmp_path):
    page = "<p>same page</p>" * 100
    pages = spark.createDataFrame([(1, "http://a.example/1", page), (2, "http://b.example/2 x", page), (3, "http://c.example/3", "<p>other</p>" * 100)], "page_id long, url string, html string")
    warc.archive(pages, f"file://{tmp_path}/w").collect()
    text = b"".join(gzip.decompress(f.read_bytes()) for f in tmp_path.rglob("*.warc.gz"))
    assert re.findall(rb"WARC-Refers-To-Target-URI: ([^\r]*)", text) == [b"http://b.example/2%20x"]
