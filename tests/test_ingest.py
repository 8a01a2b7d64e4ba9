"""Files to documents, chunks and embeddings."""

import zipfile

from pyspark.sql import functions as F

from tallywright.operators import ingest, retrieval

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def sheet(path):
    rows = [["Date", " Amount ", None], ["2020-01-01", " 5 ", "x"], [None, None, None], ["", "7", None]]
    body = ""
    for n, row in enumerate(rows, 1):
        cells = "".join(f'<c r="{"ABC"[i]}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(row) if v is not None)
        body += f'<row r="{n}">{cells}</row>'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", SHEET.format(body))


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    sheet(tmp_path / "deep" / "book.xlsx")
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "note.docx", "w") as doc:
        doc.writestr("word/document.xml", word)
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "skipped.txt").write_text("x")
    found = ingest.files(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["book.xlsx", "broken.xlsx", "note.docx"]
    rows = {(r.document_id, r.source_name): r for r in ingest.ingest(found).collect()}
    assert [(f.label, f.value) for f in rows["book-row-0001", "book.xlsx"].fields] == [("Date", "2020-01-01"), ("Amount", "5")]
    assert [(f.label, f.value) for f in rows["book-row-0002", "book.xlsx"].fields] == [("Date", None), ("Amount", "7")]
    assert rows["note", "note.docx"].text == "Hello\na  b" and rows[None, "broken.xlsx"].error.startswith("BadZipFile") and len(rows) == 4


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Name , Amount,\n x ,  ,z\n\"a\nb\",7\n".encode())
    got = ingest.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["Name", "Amount"] and [tuple(r) for r in got.collect()] == [("x", None), ("a\nb", "7")]


def test_chunks(spark):
    # (units, limit, overlap) and the chunks by hand
    cases = [
        (["aaaa", "bbbb", "cccc"], 9, 4, ["aaaa\nbbbb", "bbbb\ncccc"]),
        (["x" * 20, "y"], 9, 4, ["x" * 20, "y"]), ([], 9, 4, []), (None, 9, 4, []), (["", "a", None, "b"], 9, 4, ["a\nb"]),
        (["aa", "bb", "cc", "dd"], 8, 5, ["aa\nbb\ncc", "bb\ncc\ndd"]),  # two units and a break are five
        (["aa", "bb", "cc", "dd"], 8, 4, ["aa\nbb\ncc", "cc\ndd"]),
        (["aaaa", "bbbb", "cccc"], 9, 0, ["aaaa\nbbbb", "cccc"]),
        (["aaaaaaa", "bbb", "ccc", "d"], 7, 2, ["aaaaaaa", "bbb", "ccc\nd"]),  # the break before bbb counts: 1 + 3 + 1 + 3 = 8
        (["aaaaaaa", "bbb", "ccc", "d"], 8, 2, ["aaaaaaa", "bbb\nccc", "d"]),
        (["aaa", "bbbbbbbbbbbb", "c"], 6, 3, ["aaa", "aaa\nbbbbbbbbbbbb", "c"]),  # what a chunk opens with it holds, however long
        (["é" * 4, "日" * 4, "c"], 9, 4, ["é" * 4 + "\n" + "日" * 4, "日" * 4 + "\nc"]),
    ]
    for given, limit, overlap, want in cases:
        one = spark.createDataFrame([("d", given)], "document_id string, units array<string>")
        assert [r.chunk_text for r in retrieval.chunk_documents(one, limit, overlap).orderBy("index").collect()] == want
    rows = spark.createDataFrame([("d", ["aaaa", "bbbb", "cccc"]), ("e", None)], "document_id string, units array<string>")
    got = retrieval.chunk_documents(rows, 9, 4).orderBy("index").collect()
    assert [r.chunk_text for r in got] == ["aaaa\nbbbb", "bbbb\ncccc"] and got[0].chunk_id.startswith("d:chunk-0000-")
    fields = spark.createDataFrame([(1, [("Note", "z"), ("Total", "5"), ("Alpha", "a"), ("x", " ")])], "i int, fields array<struct<label:string,value:string>>")
    assert fields.select(retrieval.field_units(F.col("fields"), ("invoice", "total"))).first()[0] == ["Total: 5", "Alpha: a", "Note: z"]


def test_nested_values(spark):
    cases = {
        '{"b":1,"a_x":{"y_Z":[1,2.5,null,"z"],"e":{}},"t":true,"n":null}': "A x: Y z: 1, 2.5, z; B: 1; T: true", "[]": None, "{}": None, '""': None, "null": None, '"s"': "s", "[[1,[2]],3]": "1, 2, 3", "7": "7", '[{"k":"v"},""]': "K: v",
    }
    rows = spark.createDataFrame([(i, j) for i, j in enumerate(cases)], "i int, j string").orderBy("i")
    assert [r[0] for r in rows.select(retrieval.display_value(F.parse_json("j"))).collect()] == list(cases.values())
    assert rows.where("i = 6").select(retrieval.display_value(F.parse_json("j"), 1)).first()[0] == "[1,[2]], 3"


def test_chunks_of_a_long_document(spark):
    import time

    units = spark.range(1).select(F.lit("d").alias("document_id"), F.transform(F.sequence(F.lit(1), F.lit(32_000)), lambda i: F.concat(F.lit("line "), i)).alias("units"))
    start = time.time()
    got = retrieval.chunk_documents(units).agg(F.count("*").alias("n"), F.max(F.length("chunk_text")).alias("most")).first()
    assert got.n > 250 and got.most <= 1200 and time.time() - start < 20


def test_embed_asks_once_for_a_text(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, None), (5, " ")], "i int, text string")
    got = {r.i: r.embedding for r in retrieval.embed(texts, lambda batch: [[float(len(t))] for t in batch]).collect()}
    assert got == {1: [1.0], 2: [1.0], 3: [2.0], 4: None, 5: None}


def test_csv_and_days_in_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Name , Amount,\n x ,  ,z\n\n\"a\nb\",7\n".encode())
    (tmp_path / "bad.csv").write_bytes(b"\xff\xfe\x00")
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="164" formatCode="dd\\-mmm\\-yyyy"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="22"/></cellXfs></styleSheet>'
    cells = '<row r="1">' + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{c}</t></is></c>' for c in "ABCDE") + "</row>"
    cells += '<row r="2"><c r="A2"><v>43831</v></c><c r="B2" s="1"><v>43831</v></c><c r="C2" s="2"><v>59</v></c><c r="D2" s="3"><v>2.5</v></c><c r="E2" s="4"><v>43831.75</v></c></row>'
    with zipfile.ZipFile(tmp_path / "days.xlsx", "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", SHEET.format(cells))
        book.writestr("xl/styles.xml", styles)
    rows = {r.document_id or r.source_name: r for r in ingest.ingest(ingest.files(spark, str(tmp_path))).collect()}
    assert [(f.label, f.value) for f in rows["a-row-0001"].fields] == [("Name", "x"), ("Amount", None)] and [f.value for f in rows["a-row-0002"].fields] == ["a\nb", "7"]
    assert rows["bad.csv"].error.startswith("UnicodeDecodeError")
    assert [f.value for f in rows["days-row-0001"].fields] == ["43831", "2020-01-01", "1900-02-28", "2.5", "2020-01-01 18:00:00"]


def test_landing_folder(spark, tmp_path):
    from tallywright.operators.versions import Store
    from tallywright.streaming import landing

    folder = tmp_path / "in"
    folder.mkdir()
    tables, progress = Store(spark, f"file://{tmp_path}/tables"), f"{tmp_path}/progress"

    def run():
        query = landing.land(spark, str(folder), tables, "documents", progress, files_a_batch=1)
        query.awaitTermination(60)
        assert query.exception() is None
        return {r.document_id: (r.fields[0].value if r.fields else None, r.error, r.batch) for r in tables.table("documents").collect()}

    (folder / "a.csv").write_text("Total\n1\n2\n")
    (folder / "b.xlsx").write_bytes(b"no zip")
    first = run()
    assert {k: v[0] for k, v in first.items()} == {"a-row-0001": "1", "a-row-0002": "2", "error:b.xlsx": None} and first["error:b.xlsx"][1].startswith("BadZipFile")
    before = tables.versions("documents")
    assert run() == first and tables.versions("documents") == before  # nothing new
    (folder / "c").mkdir()
    (folder / "c" / "a.csv").write_text("Total\n9\n")
    later = run()
    assert later["a-row-0001"][0] == "9" and later["a-row-0002"] == first["a-row-0002"] and later["a-row-0001"][2] > first["a-row-0001"][2]
    again = tables.table("documents").drop("batch")
    assert landing.merge_batch(tables, "documents", again, later["a-row-0001"][2]) is False  # a batch that is run once more
