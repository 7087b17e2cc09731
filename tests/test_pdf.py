"""PDF files of both kinds of tables, broken ones and odd fonts, page by page."""

import io
import zlib

from lacuna.sources import pdf


def content(*lines):
    shown = b" ".join(b"(%s) Tj T*" % line.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for line in lines)
    return b"BT /F1 12 Tf 14 TL 72 700 Td " + shown + b" ET"


def stream(data, packed=True, extra=b""):
    data = zlib.compress(data) if packed else data
    return b"<< /Length %d %s%s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if packed else b"", extra, data)


def objects(pages, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"):
    out = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font}
    kids = []
    for i, data in enumerate(pages):
        kids.append(b"%d 0 R" % (10 + 2 * i))
        out[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        out[11 + 2 * i] = stream(data, packed=i % 2 == 0)
    out[2] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), b" ".join(kids))
    return out


def classic(made):
    data, places = b"%PDF-1.4\n", {}
    for n, body in made.items():
        places[n] = len(data)
        data += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at) for n, at in places.items())
    return data + table + b"trailer\n<< /Size 99 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % len(data)


def by_streams(made):
    """Objects without a stream lie in an object stream; the table is a stream with the predictor up."""
    data, places, packed = b"%PDF-1.5\n", {}, [n for n, b in made.items() if b"stream" not in b]
    heads, bodies = [], b""
    for n in packed:
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += made[n] + b" "
    head = b" ".join(heads) + b" "
    loose = {n: b for n, b in made.items() if n not in packed} | {90: stream(head + bodies, extra=b"/Type /ObjStm /N %d /First %d" % (len(packed), len(head)))}
    for n, body in loose.items():
        places[n] = len(data)
        data += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    rows = []
    for n in range(100):
        rows.append(bytes([2]) + (90).to_bytes(4, "big") + bytes([packed.index(n)]) if n in packed else bytes([1]) + places.get(n, 0).to_bytes(4, "big") + b"\0" if n in places else bytes(6))
    up = b"".join(b"\2" + bytes((a - b) & 255 for a, b in zip(r, before, strict=True)) for r, before in zip(rows, [bytes(6), *rows], strict=False))
    table = stream(up, extra=b"/Type /XRef /Size 100 /W [1 4 1] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 6 >>")
    return data + b"99 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (table, len(data))


PAGES = [content("First line (1)", "25 °C – next\\"), content(), content("Third page")]
TEXTS = ["First line (1)\n25 °C – next\\", "", "Third page"]


def test_both_kinds_of_tables():
    for make in (classic, by_streams):
        assert pdf.page_texts(io.BytesIO(make(objects(PAGES)))) == TEXTS
        assert pdf.page_texts(io.BytesIO(make(objects(PAGES))), 2, 1) == TEXTS[2:]


def test_a_broken_table_is_scanned_for():
    whole = classic(objects(PAGES))
    assert pdf.page_texts(io.BytesIO(whole.replace(b"startxref", b"startxxxx"))) == TEXTS
    assert pdf.page_texts(io.BytesIO(whole[: whole.rindex(b"xref\n0 1")])) == TEXTS


def test_fonts_and_moves():
    cmap = stream(b"1 beginbfchar <0001> <00660069> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange")
    made = objects([b"BT /F1 10 Tf [<0001> -300 <0002> 20 <0003>] TJ 0 -12 TD <0003> Tj 30 0 Td <0002> Tj ET"], b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>")
    assert pdf.page_texts(io.BytesIO(classic(made | {4: cmap}))) == ["fi AB\nB A"]
    named = objects([b"BT /F1 10 Tf (a\\001\\002b) ' ET"], b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /fi /uni00B5] >> >>")
    assert pdf.page_texts(io.BytesIO(classic(named))) == ["aﬁµb"]


def test_files_by_page_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pdf, "RANGE", 2)
    for name, make in (("one paper", classic), ("two", by_streams)):
        (tmp_path / f"{name}.pdf").write_bytes(make(objects(PAGES)))
    (tmp_path / "none.pdf").write_bytes(b"not a file of that kind")
    locked = classic(objects(PAGES)).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << >>")
    (tmp_path / "locked.pdf").write_bytes(locked)
    rows = pdf.read_pdf_pages(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.page, r.pages) for r in rows) == [(d, i, 3) for d in ("locked", "one paper", "two") for i in range(3)]
    assert {r.doc_id: r.raw_text for r in pdf.read_pdf(spark, str(tmp_path)).collect()} == {"one paper": "\n".join(TEXTS), "two": "\n".join(TEXTS), "locked": "\n\n"}
    assert {r.raw_text for r in pdf.read_pdf(spark, str(tmp_path), "two.pdf", skip_empty=True).collect()} == {f"{TEXTS[0]}\n{TEXTS[2]}\n"}


def test_no_file_is_read_whole(tmp_path):
    class Watched(io.BytesIO):
        most = 0

        def read(self, size=-1):
            got = super().read(size)
            self.most = max(self.most, len(got))
            return got

    made = objects([content(f"Page {i}", *[f"line {i} {k} {(i * k * 7919) % 100003}" for k in range(400)]) for i in range(300)])
    file = Watched(classic(made))
    assert pdf.page_texts(file, 150, 1)[0].startswith("Page 150\nline 150 0 0")
    assert file.most < len(file.getvalue()) / 10
