"""PDF files built here, read as blocks and lines."""

import zipfile
import zlib

from quern import __main__ as cli
from quern.operators import corpus
from quern.sources import folder
from quern.sources.documents import is_image_only
from quern.sources.pdf import page_lines, pdf_blocks, read_pdf, tables_first, value

CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0643> endbfchar 1 beginbfrange <0002> <0003> <0062> endbfrange"


def pdf(pages, packed=True):
    """A file of one content stream a page, with fonts F1 (plain) and F2 (mapped)."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: b"<</Type/Font/Subtype/Type1>>", 4: b"<</Type/Font/Subtype/Type0/ToUnicode 5 0 R>>"}
    kids, streams = [], {5: CMAP}
    for i, content in enumerate(pages):
        kids.append(f"{10 + 2 * i} 0 R")
        objects[10 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * i)
        streams[11 + 2 * i] = content
    objects[2] = b"<</Type/Pages/Kids[%s]/Count %d/MediaBox[0 0 600 800]/Resources<</Font<</F1 3 0 R/F2 4 0 R>>>>>>" % (" ".join(kids).encode(), len(pages))
    out = b"%PDF-1.4\n"
    for n, x in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    for n, x in streams.items():
        x = zlib.compress(x) if packed else x
        out += b"%d 0 obj\n<</Length %d%s>>\nstream\n%s\nendstream\nendobj\n" % (n, len(x), b"/Filter/FlateDecode" if packed else b"", x)
    return out + b"trailer<</Root 1 0 R>>"


def test_values():
    assert value(rb"<</A#42 [1 -.5 (a\(b\)\101\n(c)) <4a4>] /R 7 0 R /N null>>", 0)[0] == {"AB": [1.0, -0.5, b"a(b)A\n(c)", b"J@"], "R": 7, "N": None}


def test_blocks():
    first = b"BT /F1 10 Tf 50 700 Td (Name) Tj 200 0 Td (Fee) Tj -200 -20 Td [(Ar) -20 (t)] TJ 200 0 Td (5) Tj ET BI /W 1 ID \x00(\x01 EI"
    second = b"q 1 0 0 1 0 100 cm BT /F2 12 Tf 1 0 0 1 10 600 Tm <000100020003> Tj 14 TL T* <0002> Tj ET Q"
    for packed in (True, False):
        got = list(pdf_blocks(pdf([first, second], packed)))
        assert got == [(1, 50.0, 100.0, "Name"), (1, 250.0, 100.0, "Fee"), (1, 50.0, 120.0, "Art"), (1, 250.0, 120.0, "5"), (2, 10.0, 100.0, "كbc"), (2, 10.0, 114.0, "b")]


def test_long_streams_are_whole():
    long = b" " * (65 << 20) + b"BT /F1 10 Tf 50 700 Td (Name) Tj ET"
    assert [x[3] for x in pdf_blocks(pdf([long]))] == ["Name"]


def test_words_of_a_line_are_one_block():
    got = list(pdf_blocks(pdf([b"BT /F1 10 Tf 0 0 Td (one) Tj 18 0 Td (two) Tj [( and) -600 (three)] TJ ET"])))
    assert [x[3] for x in got] == ["one two and three"]


def test_files_become_lines_and_chunks(spark):
    page = b"BT /F1 10 Tf 50 700 Td (The library is open through all of the night.) Tj 0 -40 Td (Readers may stay until the first lesson begins.) Tj ET"
    files = spark.createDataFrame([("a", "pdf", pdf([page, page])), ("b", "pdf", b"junk"), ("c", "pdf", pdf([b""])), ("d", "docx", b"")], "path string, ext string, content binary")
    blocks = read_pdf(files)
    failed = blocks.where("error is not null").collect()
    assert [r.path for r in failed] == ["b"]
    named = blocks.withColumnRenamed("path", "doc")
    assert {r.doc: r.image_only for r in is_image_only(named).collect()} == {"a": False, "b": True, "c": True}
    lines = page_lines(named).orderBy("line_no").collect()
    assert [r.line_no for r in lines] == list(range(6)) and lines[0].body == "[صفحة 1 / Page 1]" and lines[3].body == "[صفحة 2 / Page 2]" and lines[2].body.startswith("Readers")
    chunks = corpus.build_chunks(page_lines(named)).collect()
    assert chunks and all(r.doc == "a" for r in chunks)


def test_a_folder_of_files(spark, tmp_path):
    page = b"BT /F1 10 Tf 50 700 Td (The library is open through all of the night.) Tj 0 -40 Td (Readers may stay until the first lesson begins.) Tj ET"
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    xml = f"<w:document {w}><w:body>{p('Fees of the schools')}<w:tbl>{row('Name', 'Fee')}{row('School of fine art', 'five coins a year')}{row('School of law', '-')}</w:tbl></w:body></w:document>"
    for name, content in {"a.pdf": pdf([page]), "b.pdf": pdf([page]), "c.pdf": pdf([b""]), "d.pdf": b"junk", "e.docx": b"junk", "~$b.docx": b"lock"}.items():
        (tmp_path / name).write_bytes(content)
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    lines, files, skipped = folder.load(spark, str(tmp_path))
    got = {(r.doc, r.kind, r.body) for r in lines.collect()}
    assert ("b", "table", "School of law — Fee: five coins a year") in got and ("b", "prose", "Fees of the schools") in got
    assert {r[0] for r in got} == {"a", "b"} and ("a", "prose", "The library is open through all of the night.") in got
    assert {(r.doc, r.filename, r.extraction_method) for r in files.collect()} == {("a", "a.pdf", "blocks"), ("b", "b.docx", "docx")}
    assert {(r.filename, r.reason.split(":")[0]) for r in skipped.collect()} == {("c.pdf", "image_only"), ("d.pdf", "failed"), ("e.docx", "failed")}
    chunks = corpus.build_chunks(lines).join(files, "doc").collect()
    assert {r.filename for r in chunks} == {"a.pdf", "b.docx"}
    args = ["--rebuild", "-k", "2", str(tmp_path), str(tmp_path / "store"), "How long is the library open?", "zzz"]
    shown = dict(cli.run(spark, cli.arguments(args)))
    assert "The library is open" in shown["How long is the library open?"] and cli.run(spark, cli.arguments(args[3:5])) == []


def test_tables_come_first_where_blocks_give_too_little(spark):
    cells = b"BT /F1 10 Tf 50 700 Td (Name of school) Tj 200 0 Td (Fee  a  year) Tj -200 -20 Td (Law and art) Tj 200 0 Td (50 coins) Tj -200 -40 Td (End of it.) Tj ET"
    files = spark.createDataFrame([("x/t.pdf", "pdf", pdf([cells])), ("x/u.pdf", "pdf", pdf([b"BT /F1 10 Tf 50 700 Td (%s) Tj ET" % (b"word " * 12)]))], "path string, ext string, content binary")
    named = read_pdf(files).withColumnRenamed("path", "doc")
    got = [r.body for r in tables_first(named).where("doc = 'x/t.pdf'").orderBy("line_no").collect()]
    assert got == ["[صفحة 1]", "Name of school | Fee a year", "Law and art | 50 coins", "Name of school Fee a year", "Law and art 50 coins", "End of it."]
    lines, found, skipped = folder.parse(files)
    assert [(r.doc, r.extraction_method) for r in found.collect()] == [("t", "fallback")]
    assert {r.filename: r.reason for r in skipped.collect()} == {"u.pdf": "failed: too little text"}
    assert {r.doc for r in lines.collect()} == {"t"}
