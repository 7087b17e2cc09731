"""Pages and records: the block rules without an article to lean on, broken markup, WARC files in and out, the digest query."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lacuna.llm import html_extract as H
from lacuna.llm import warc

STORY = "The main text of it is long enough to be seen here and now, as it has to be by all who read it."
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Item number {i}</a></li>" for i in range(8)) + "</ul>"
SCHEMA = "page_id long, url string, html string"


def test_block_rules_without_an_article():
    page = f"<div>{LINKS}</div><div><h1>A short head</h1><p>{STORY}</p><p>Short one.</p><p>{STORY}</p></div><div><p>Imprint</p>{LINKS}</div>"
    # The head stands between a bad and a good block, the imprint between a good and a bad one: each takes the one before.
    assert H.main_text(page) == f"{STORY}\n\nShort one.\n\n{STORY}\n\nImprint"
    shop = "<p>Widget 3000 Turbo Gadget Deluxe Maximum Performance Chrome Steel Black White</p>"
    assert H.main_text(f"{shop}<p>{STORY}</p>") == STORY
    assert H.first_pass(STORY, 0.0, False) is True and H.first_pass("Short.", 0.0, False) is None and H.first_pass("Short.", 0.9, False) is False


def test_second_pass_takes_the_nearest_label():
    assert H.second_pass([None, True, None, None, False, None], True) == [True, True, True, False, False, False]
    assert H.second_pass([True, None, False], True) == [True, True, False]  # a tie goes to the one before
    assert H.second_pass([None, None], False) == [False, False] and H.second_pass([], True) == []


def test_linked_paragraphs_stay_in_an_article_and_lists_of_links_do_not():
    linked = f'<article><p>{STORY}</p><p><a href="/x">{STORY}</a></p>{LINKS}</article>'
    assert H.main_text(linked) == f"{STORY}\n\n{STORY}"


@pytest.mark.parametrize("tag", ['<a href="x>', "<a title='x>", '<a href="x" title=">'])
def test_a_quote_without_end_stops_at_the_tag(tag):
    assert H.main_text(f"<article><p>{STORY} {tag}here</a> it ends.</p></article>") == f"{STORY} here it ends."


def test_pages_of_all_kinds(spark):
    long = "<article>" + f"<p>{STORY}</p>" * 20_000 + "</article>"
    rows = [(1, "u", long), (2, "u", f"<p>{STORY}"), (2, "u", f"<p>{STORY}"), (None, None, None), (3, "", "<")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    got = H.extract_pages(df).collect()
    assert len(got) == 5 and sum(r.text == STORY for r in got) == 2 and all(r.n_chars == len(r.text) for r in got)
    assert next(r for r in got if r.page_id == 1).text == "\n\n".join([STORY] * 20_000)
    assert H.extract_pages(df.limit(0)).count() == 0


def responses(n):
    out = []
    for i in range(n):
        payload = f"<html lang=en><title>T{i}</title><article><p>{STORY} {i} é</article><a href='/o{i}'>o</a>".encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Odd: a: b\r\n\r\n" + payload
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Date: 2020-01-0{i + 1}T00:00:00Z\r\nWARC-Target-URI: http://a/{i}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
        out.append(head.encode() + block + b"\r\n\r\n")
    return [b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:w>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", *out]


@pytest.mark.parametrize("members", [True, False])
def test_files_in_and_out(spark, tmp_path, members):
    parts = responses(4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)) if members else gzip.compress(b"".join(parts)))
    (tmp_path / "in" / "b.warc").write_bytes(b"".join(parts[1:2]))
    read = warc.responses_from_records(warc.read_warc(spark, str(tmp_path / "in"), "*.warc*"))
    made = warc.derive(read, "2024-05-06T07:08:09Z")
    assert made.count() == 5
    warc.write_warc(made, out := str(tmp_path / "out"))
    back = warc.read_warc(spark, out).collect()
    assert len(back) == 10 and {r.type for r in back} == {"conversion", "metadata"} and {r.date for r in back} == {"2024-05-06T07:08:09Z"}
    assert all(r.block_digest == warc.sha1(bytes(r.block)) for r in back)
    texts = {r.target_uri: bytes(r.block).decode() for r in back if r.type == "conversion"}
    assert texts == {f"http://a/{i}": f"{STORY} {i} é" for i in range(4)}
    told = {r.target_uri: bytes(r.block).decode() for r in back if r.type == "metadata"}
    assert "source-x-odd: a: b\r\n" in told["http://a/2"] and "outlink: /o2\r\n" in told["http://a/2"] and "language: en" in told["http://a/2"]
    record = made.where("url = 'http://a/1'").first()
    head = record.conversion_record.split("\r\n\r\n")[0]
    assert "WARC-Refers-To-Date: 2020-01-02T00:00:00Z" in head and "WARC-Refers-To: <urn:uuid:1>" in head
    assert f"WARC-Payload-Digest: {warc.sha1(record.text.encode())}" in head and f"WARC-Block-Digest: {record.conversion_digest}" in head


def test_derivative_query(spark):
    rows = [(1, "http://a/", f"<title>T</title><article><p>{STORY}"), (1, "http://a/", f"<title>T</title><article><p>{STORY}"), (2, None, None), (None, "u", "é" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("date", F.lit("clash")).withColumn("payload", F.lit(1))
    got = warc.derivative_query(df).collect()
    assert len(got) == 4 and len({r.response_id for r in got}) == 3
    for r in got:
        html = next(h or "" for i, u, h in rows if (i, u) == (r.page_id, r.url))
        payload = html.encode()
        header = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        text = H.main_text(html).encode()
        assert (r.source_payload_digest, r.source_block_digest) == (warc.sha1(payload), warc.sha1(header + payload))
        assert (r.conversion_digest, r.conversion_length) == (warc.sha1(text), len(text)) and r.refers_to == r.response_id
        whole = warc.derive_row(r.page_id, r.url, r.response_id, None, header.decode(), html)
        assert r.conversion_sha256 == hashlib.sha256(whole[-2].encode()).hexdigest() and "WARC-Date: " in whole[-2] and "WARC-Date: " in whole[-1]
    assert warc.derivative_query(df.limit(0)).count() == 0


def test_article_text_that_looks_like_something_else():
    kept = lambda page: H.main_text(f"<nav>{LINKS}</nav><article><h1>A head</h1>{page}<p>{STORY}</p></article>")
    around = lambda text: f"A head\n\n{text}\n\n{STORY}"
    # a linked block has no say over short ones, and stays if it is a paragraph or a head on its own
    assert H.main_text("<article><p><a href=/r>Read the full report</a></p><p>It rained.</p><p>We left.</p></article>") == "Read the full report\n\nIt rained.\n\nWe left."
    assert H.main_text(f"<article><h1><a href=/me>The head</a></h1><p>It rained.</p>{LINKS}<p>We left.</p></article>") == "The head\n\nIt rained.\n\nWe left."
    assert kept("".join(f"<p><a href=/{i}>Other story {i}</a></p>" for i in range(3))) == f"A head\n\n{STORY}"
    # names that text may have: dropped if full of links, kept if not
    for tag, name in (("p", "teaser"), ("section", "related"), ("p", "search"), ("div", "post-teaser-text")):
        assert kept(f"<{tag} class={name}>It rained.</{tag}>") == around("It rained.")
        assert kept(f"<{tag} class={name}>See also <a href=/x>another long story of this site</a></{tag}>") == f"A head\n\n{STORY}"
    assert kept(f"<section class=related><h2>Related</h2>{LINKS}</section>") == f"A head\n\n{STORY}"
    # adverts, notices, comments and forms are left out by name as before
    for name in ("ad", "cookie-notice", "comments", "newsletter", "related-ads"):
        assert kept(f"<div class={name}>{STORY}</div>") == f"A head\n\n{STORY}"
    # a list of few stop words outside an article
    goods = ["Flour sieved twice, butter unsalted softened, sugar brown, eggs beaten"] * 2
    assert H.main_text(f"<p>{STORY}</p><ul>" + "".join(f"<li>{g}</li>" for g in goods) + f"</ul><p>{STORY}</p>") == "\n\n".join([STORY, *goods, STORY])


def plain_blocks(page):
    """Brute force for well-formed pages: the html library's own parser, a text for each leaf block of the article."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.depth, self.skip = [], 0, 0

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.skip += tag in ("script", "style")
            if tag == "br":
                self.handle_data(" ")
            elif tag in H._BLOCK:
                self.out.append("")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.skip -= tag in ("script", "style")
            if tag in H._BLOCK:
                self.out.append("")

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.out.append(self.out.pop() + data if self.out else data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    texts = [" ".join(t.split()) for t in reader.out]
    return "\n\n".join(t for t in texts if t)


def test_all_pages_against_another_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {(r.page_id, r.url): r.text for r in H.extract_pages(rows).collect()}
    want = {(r.page_id, r.url): plain_blocks(r.html or "") for r in rows.collect()}
    assert got == want and len(want) > 200


def test_records_that_cannot_be_read_are_told_and_skipped():
    good = responses(2)
    odd = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://\xff/\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n"
    lost = b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length\r\n\r\nmore"
    got = warc.parse_records(good[1] + lost + b"\r\n\r\n" + odd + b"junk\r\n\r\n" + good[2] + b"WARC/1.1\r\nContent-Length: 90\r\n\r\ncut")
    assert [f.get("WARC-Type") for f, _ in got] == ["response", warc.MALFORMED, "response", warc.MALFORMED, "response", warc.MALFORMED]
    assert got[1][1] == lost and got[2][1] == b"abc" and "�" in got[2][0]["WARC-Target-URI"] and got[3][1] == b"junk" and got[4] == warc.parse_records(good[2])[0]
    assert warc.parse_records(b"") == [] and len(warc.parse_records(b"".join(good))) == 3 and warc.parse_records(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")[0][1] == b""
