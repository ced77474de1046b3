"""Files read and written through Spark's data source API."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import artifacts, elements


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="x"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(text, style=None, more=""):
    said = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{said}<w:r><w:t>{text}</w:t>{more}</w:r></w:p>"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# One\n\ntext a\n\n## Two\ntext b\n\n| h |\n|---|\n| 1 |\n\f### Deep\n\n![a picture](x.png)\n\n## Three\n\ntext c\n\n# Four\ntext d")
    (tmp_path / "b.txt").write_bytes(b"first\n\n\n\n  second \n\f\fthird \xff")
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('H1')}{cell('H2')}</w:tr><w:tr>{cell('x')}{cell('')}</w:tr></w:tbl>"
    (tmp_path / "sub" / "c.docx").write_bytes(docx(p("Top", "Heading1") + p("prose") + table + p("", None, '<w:br w:type="page"/>') + p("Sub", "Heading2") + p("", None, '<wp:docPr descr="chart"/>') + p("more")))
    (tmp_path / "broken.docx").write_bytes(b"PK\x03\x04 no zip")
    (tmp_path / "ignored.bin").write_bytes(b"x")
    (tmp_path / "_hidden.txt").write_text("x")
    (tmp_path / "empty.txt").write_text("")
    return str(tmp_path)


def test_elements_of_all_formats_with_a_broken_file_among_them(spark, folder):
    elements.register(spark)
    df = spark.read.format("sparkloom_elements").load(folder)
    rows = [(os.path.basename(r.path), r.page, r.position, r.kind, r.section_path, r.text) for r in df.filter("kind <> 'ERROR'").orderBy("path", "page", "position").collect()]
    assert rows == [
        ("a.md", 1, 0, "TEXT", ["One"], "text a"), ("a.md", 1, 1, "TEXT", ["One", "Two"], "text b"), ("a.md", 1, 2, "TABLE", ["One", "Two"], "| h |\n|---|\n| 1 |"),
        ("a.md", 2, 0, "IMAGE", ["One", "Two", "Deep"], "a picture"), ("a.md", 2, 1, "TEXT", ["One", "Three"], "text c"), ("a.md", 2, 2, "TEXT", ["Four"], "text d"),
        ("b.txt", 1, 0, "TEXT", [], "first"), ("b.txt", 1, 1, "TEXT", [], "second"), ("b.txt", 3, 0, "TEXT", [], "third �"),
        ("c.docx", 1, 0, "TEXT", ["Top"], "prose"), ("c.docx", 1, 1, "TABLE", ["Top"], "| H1 | H2 |\n|---|---|\n| x |  |"), ("c.docx", 2, 0, "IMAGE", ["Top", "Sub"], "chart"), ("c.docx", 2, 1, "TEXT", ["Top", "Sub"], "more"),
    ]
    assert [(os.path.basename(r.path), r.error.split(":")[0], r.page) for r in df.filter("kind = 'ERROR'").collect()] == [("broken.docx", "BadZipFile", None)]


def test_windows_split_files_columns_and_filters(spark, tmp_path):
    elements.register(spark)
    (tmp_path / "long.txt").write_text("\f".join(f"page {n} one\n\npage {n} two" for n in range(1, 24)))
    read = lambda: spark.read.format("sparkloom_elements").option("split_bytes", 100)
    df = read().load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 3
    assert {(r.window, r.lo, r.hi, r.n) for r in df.groupBy("window").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.count("*").alias("n")).collect()} == {(1, 1, 5, 10), (2, 6, 10, 10), (3, 11, 15, 10), (4, 16, 20, 10), (5, 21, 23, 6)}
    few = read().schema("text string, page int").load(str(tmp_path))
    assert few.columns == ["text", "page"] and few.filter("page = 7").count() == 2
    assert read().load(str(tmp_path)).filter("kind = 'TABLE'").count() == 0
    assert read().load(str(tmp_path)).filter(F.col("path") == f"{tmp_path}/long.txt").count() == 46
    assert read().load(str(tmp_path)).filter(F.col("path") == "no such").count() == 0
    empty = tmp_path / "none"
    empty.mkdir()
    assert read().load(str(empty)).count() == 0


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs}


def test_artifacts_are_written_once_and_fetched_one_by_one(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("b1", "TABLE_IMAGE", b"one", 1), ("b1", "TABLE_IMAGE", b"one", 2), ("b1", "FIGURE_IMAGE", b"one", 3), ("b2", "OTHER", b"", 4), ("b2", "OTHER", None, 5)], "batch_id string, artifact_type string, content binary, extra int").repartition(3)
    artifacts.store(rows, root)
    one = artifacts.artifact_id(b"one")
    before = files(root)
    assert set(before) == {f"b1/TABLE_IMAGE/{one}.png", f"b1/FIGURE_IMAGE/{one}.png", f"b2/OTHER/{artifacts.artifact_id(b'')}"}
    artifacts.store(rows, root)
    assert files(root) == before  # not one is written again
    got = artifacts.listing(spark, root)
    assert sorted(map(tuple, got.collect())) == sorted([("b1", "TABLE_IMAGE", one, 3), ("b1", "FIGURE_IMAGE", one, 3), ("b2", "OTHER", artifacts.artifact_id(b""), 0)])
    assert {bytes(r.content) for r in artifacts.fetch(spark, root, "b1", one).collect()} == {b"one"}
    assert artifacts.fetch(spark, root, "b9", one).isEmpty() and artifacts.fetch(spark, root, "b2", one).isEmpty()
    reader = artifacts.ArtifactReader({"path": root, "batch_id": "b1", "artifact_type": "TABLE_IMAGE", "artifact_id": one}, got.schema)
    assert [len(x.files) for x in reader.partitions()] == [1]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.range(100, numPartitions=4).selectExpr("'b' batch_id", "'T' artifact_type", "CASE WHEN id = 99 THEN raise_error('lost') ELSE CAST(CAST(id AS string) AS binary) END content")
    with pytest.raises(Exception, match="lost"):
        artifacts.store(rows, root)
    assert files(root) == {}
    good = spark.range(50).selectExpr("'b' batch_id", "'T' artifact_type", "CAST(CAST(id AS string) AS binary) content")
    artifacts.store(good, root)
    assert len(files(root)) == 50
    with pytest.raises(Exception, match="only added"):
        artifacts.register(spark)
        good.write.format("sparkloom_artifacts").mode("overwrite").save(root)


def test_the_driver_learns_of_folders_and_lists_and_not_of_files(spark, tmp_path):
    import pickle

    root = str(tmp_path / "many")
    artifacts.store(spark.range(600).selectExpr("'b' batch_id", "'T' artifact_type", "cast(cast(id % 500 as string) as binary) content").repartition(3), root)
    got = artifacts.listing(spark, root)
    assert got.count() == got.distinct().count() == 500 and not [x for x in os.listdir(root) if x != "b" and os.listdir(f"{root}/{x}")]
    parts = artifacts.ArtifactReader({"path": root}, got.schema).partitions()
    assert len(pickle.dumps(parts)) < 4000
    writer = artifacts.ArtifactWriter({"path": root}, spark.createDataFrame([], "batch_id string, artifact_type string, content binary").schema)
    told = writer.write(iter([{"batch_id": "c", "artifact_type": "T", "content": b"%d" % i} for i in range(300)]))
    assert len(pickle.dumps(told)) < 1000
    writer.commit([told, None])
    assert artifacts.listing(spark, root, batch_id="c").count() == 300
