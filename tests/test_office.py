"""Word documents written and read back, damaged and foreign files among them."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quern.sources import office as O


def test_round_trip(spark, tmp_path):
    rows = [("a.docx", ["One & <two>", "", "  blanks  ", "ไทย é"]), ("b.docx", []), ("c.docx", None), ("d.docx", ["cut off"] * 50)]
    folder = f"file://{tmp_path}/office"
    df = spark.createDataFrame(rows, "name string, paragraphs array<string>").repartition(2)
    assert O.write_documents(df, folder, "name = 'd.docx'").count() == 4
    (tmp_path / "office" / "e.txt").write_bytes("first\nsecond é".encode())
    (tmp_path / "office" / "f.pdf").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "office" / "g.doc").write_bytes(b"\xd0\xcf\x11\xe0rest")
    (tmp_path / "office" / "h.txt").write_bytes(b"\xff\xfe\xff")
    with zipfile.ZipFile(tmp_path / "office" / "i.docx", "w") as z:
        z.writestr("other.xml", "<a/>")
    with zipfile.ZipFile(tmp_path / "office" / "j.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document")
    got = sorted((r.name, r.kind, r.ordinal, r.text, r.error) for r in O.read_documents(spark, folder).collect())
    assert [g for g in got if g[0] == "a.docx"] == [("a.docx", "docx", k, t, None) for k, t in enumerate(rows[0][1])]
    assert {g[0]: (g[1], g[4]) for g in got if g[4]} == {
        "d.docx": ("docx", "BadZipFile"), "f.pdf": ("pdf", "no reader for pdf"), "g.doc": ("doc", "no reader for doc"), "h.txt": ("text", "UnicodeDecodeError"),
        "i.docx": ("docx", "KeyError"), "j.docx": ("docx", "ParseError"),
    }
    assert [g[3] for g in got if g[0] == "e.txt"] == ["first", "second é"] and not any(g[0] in ("b.docx", "c.docx") for g in got)


def test_breaks_and_tabs_are_blanks():
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{O._W}"><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p></w:body></w:document>')
    assert list(O.paragraphs(out.getvalue())) == ["a b c"]


@pytest.mark.parametrize("name", ["office_documents"])
def test_each_document_comes_back(spark, name):
    from quern.plans.registry import QUERIES

    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.where("error is not null").agg(F.count_distinct("doc_id")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("source = 'src13'").count()


def test_the_driver_lists_no_documents(spark):
    from quern.plans.registry import QUERIES

    out = QUERIES["office_documents"](spark, "/root/testdata/sf0.001")
    assert len(out.inputFiles()) < 10 < spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_subfolders(spark, tmp_path):
    rows = [(f"{k}.docx", [f"text {k}", "more"]) for k in range(40)]
    folder = f"file://{tmp_path}/office"
    files = O.write_documents(spark.createDataFrame([*rows, rows[0]], "name string, paragraphs array<string>").repartition(3), folder, folders=7).persist()
    names = {r.name for r in files.collect()}
    assert len(names) == 40 and len({n.partition("/")[0] for n in names}) == 7 and all((tmp_path / "office" / n).is_file() for n in names)
    want = sorted((n, "docx", k, t, None) for n, own in rows for k, t in enumerate(own))
    assert sorted(map(tuple, O.read_documents(spark, folder, files).collect())) == want == sorted(map(tuple, O.read_documents(spark, folder).collect()))
