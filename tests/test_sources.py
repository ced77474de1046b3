"""File formats, parsing, artifacts and state tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import files as src


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p>{"<w:pPr><w:pStyle w:val=%r/></w:pPr>" % style if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'.replace("'", '"')
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('Requirement')}{cell('')}</w:tr><w:tr>{cell('The system shall post')}{cell('x')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Head', 'Heading1')}{p('Some prose of more than thirty characters')}{table}</w:body></w:document>")
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("uploads")
    (d / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (d / "b.docx").write_bytes(docx())
    (d / "c.zip").write_bytes(b"PK\x03\x04broken")
    (d / "d.txt").write_bytes("one paragraph that is long enough to keep\n\n\n  two \n\n".encode())
    (d / "e.txt").write_bytes(b"")
    (d / "f.bin").write_bytes(b"a\x00b")
    return str(d)


def test_formats_and_parsing(spark, folder):
    f = src.validated(src.with_format(src.uploads(spark, folder)), 5000).cache()
    assert {r.path.rpartition("/")[2]: (r.format, r.verdict) for r in f.collect()} == {
        "a.pdf": ("PDF", "OK"), "b.docx": ("DOCX", "OK"), "c.zip": (None, "UNSUPPORTED_FORMAT"), "d.txt": ("TXT", "OK"), "f.bin": (None, "UNSUPPORTED_FORMAT")}
    items = src.parsed(f)
    got = {(r.kind, r.section, r.text) for r in items.collect()}
    assert got == {("error", "", "no reader for PDF"), ("prose", "Head", "Some prose of more than thirty characters"), ("row", "Head", "Requirement: The system shall post | col_1: x"), ("prose", "", "one paragraph that is long enough to keep"), ("prose", "", "two")}
    assert sorted(r.text for r in src.requirement_texts(items).collect()) == ["Requirement: The system shall post | col_1: x", "one paragraph that is long enough to keep"]


def test_artifacts_and_state(spark, tmp_path):
    rows = spark.createDataFrame([("x", "table"), ("x", "table"), ("y", "figure")], "body string, kind string")
    src.store_artifacts(rows, str(tmp_path / "a"), F.col("body"), F.col("kind"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2 and {r.artifact_type for r in src.list_artifacts(spark, str(tmp_path / "a")).collect()} == {"table", "figure"}
    t = spark.createDataFrame([(1, "s", "a", "2024-01-01 00:00:00"), (1, "s", "b", "2024-01-02 00:00:00"), (2, "s", "c", "2023-01-01 00:00:00")], "batch_id long, field string, value string, at string").withColumn("at", F.to_timestamp("at"))
    src.put_state(t, str(tmp_path / "s"))
    assert [(r.batch_id, r.value) for r in src.get_state(spark, str(tmp_path / "s"), F.to_timestamp(F.lit("2024-01-02 12:00:00"))).collect()] == [(1, "b")]


def test_seed(spark, tmp_path):
    kb = src.knowledge_base(spark, [{"id": "1", "module": "m", "feature": "f"}, {"id": "1", "module": "n"}])
    assert src.seed(kb, str(tmp_path / "kb")) == 1
    with pytest.raises(ValueError):
        src.knowledge_base(spark, [])


def test_pdf_by_a_given_reader(spark, folder):
    f = src.with_format(src.uploads(spark, folder)).filter("format = 'PDF'")
    read = src.parsed(f, lambda content: [("row", "S", content.decode(), [("col_0", "v")])]).collect()
    assert [(r.kind, r.section, r.text, r.cells) for r in read] == [("row", "S", "%PDF-1.4 x", {"col_0": "v"})]

    def broken(content):
        raise ValueError("page 3")

    assert [(r.kind, r.text) for r in src.parsed(f, broken).collect()] == [("error", "ValueError: page 3")]
    pages = spark.createDataFrame([("short", b"x"), ("a text of more than twenty characters", b"y"), (None, b"z")], "text string, image binary")
    assert [r.text for r in src.with_ocr(pages, lambda images: images.map(lambda b: "seen " + bytes(b).decode())).collect()] == ["seen x", "a text of more than twenty characters", "seen z"]
    assert [r.text for r in src.with_ocr(pages, lambda images: 1 / 0).collect()] == ["", "a text of more than twenty characters", ""]


def test_yaml_manifests_and_reports(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m" / "one").mkdir(parents=True)
    (tmp_path / "m" / "two").mkdir()
    (tmp_path / "m" / "one" / "manifest.yaml").write_text("product_id: p1\n")
    (tmp_path / "m" / "two" / "manifest.yaml").write_text("- [broken")
    (tmp_path / "syn.yaml").write_text("text: [Need, wish]\ncountry: [land, need]\n")
    assert sorted(map(tuple, src.collections(spark, str(tmp_path / "m")).collect())) == [("p1_capabilities", True), ("p1_docs", False)]
    table, inverse = src.header_synonyms(spark, str(tmp_path / "syn.yaml"))
    assert inverse == {"need": "text", "wish": "text", "land": "country"} and table.count() == 3
    assert src.yaml_entries(spark, str(tmp_path / "none.yaml"), required=False) == []
    with pytest.raises(Exception):
        src.yaml_entries(spark, str(tmp_path / "none.yaml"))
    spark.createDataFrame([("1", "fits"), ("2", "gaps")], "id string, report string").write.partitionBy("report").option("header", True).csv(str(tmp_path / "r"))
    assert src.list_reports(spark, str(tmp_path / "r")).count() == 2 and [r.id for r in src.read_reports(spark, str(tmp_path / "r"), "gaps").collect()] == ["2"]


def test_fetch_artifact(spark, tmp_path):
    rows = spark.createDataFrame([("x", "table"), ("y", "figure")], "body string, kind string")
    src.store_artifacts(rows, str(tmp_path / "a"), F.col("body"), F.col("kind"))
    some = spark.read.parquet(str(tmp_path / "a")).filter("body = 'x'").first().artifact_id
    assert [r.body for r in src.fetch_artifact(spark, str(tmp_path / "a"), some).collect()] == ["x"] and src.fetch_artifact(spark, str(tmp_path / "a"), "none").count() == 0


def test_files_to_gated_atoms(spark, folder):
    from sparkloom.operators import pipelines as pipe

    got = {(r.ref.rpartition("/")[2], r.gate) for r in pipe.ingested_files(src.uploads(spark, folder), F.lit("Budgeting")).collect()}
    assert ("f.bin", "UNSUPPORTED_FORMAT") in got and ("c.zip", "UNSUPPORTED_FORMAT") in got and any(x.startswith("b.docx#") for x, _ in got) and any(x.startswith("d.txt#") for x, _ in got)


def test_conversion_falls_back(spark):
    files = spark.createDataFrame([("good", b"x" * 700), ("thin", b"x"), ("bad", b"!"), ("worse", b"?")], "path string, content binary")

    def first(content):
        if content in (b"!", b"?"):
            raise ValueError("no text")
        return [bytes(content).decode()]

    def second(content):
        if content == b"?":
            raise ValueError("no image")
        return ["seen"]

    got = {r.path: (r.pages, r.way, r.error) for r in src.converted(files, first, second).collect()}
    assert got == {"good": (["x" * 700], "first", None), "thin": (["seen"], "second", None), "bad": (["seen"], "second", None), "worse": (None, "failed", "ValueError: no image")}


def test_bootstrap_is_idempotent(spark):
    tables = {"boot_a": "id long, name string", "boot_b": "id long"}
    assert src.bootstrap(spark, tables) == ["boot_a", "boot_b"] and src.bootstrap(spark, tables) == []
    for name in tables:
        spark.sql(f"DROP TABLE {name}")
