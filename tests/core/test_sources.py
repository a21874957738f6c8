"""Files in and out, extractors, streams."""

import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from lexmill.sources import extractors, files, sinks
from lexmill.streaming import streams


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _write(folder):
    (folder / "sub").mkdir()
    (folder / "a.txt").write_bytes("Grüße\r\nzeile two that makes it long enough to be kept by the loader".encode())
    (folder / "sub/b.TXT").write_bytes("latin é text ".encode("latin-1") * 10)
    (folder / "c.html").write_text("<html><title>T</title><script>x='</p>'</script><!-- no --><p>one <b>two</b> &amp;lt; three</p></html>")
    (folder / "d.md").write_text("# Head\n**bold** and `code`\n- item\n![alt](u) [link](v)\n")
    (folder / "e.docx").write_bytes(_zip({"word/document.xml": '<w:document xmlns:w="w"><w:p><w:t>first </w:t><w:t>part</w:t></w:p><w:p/><w:p><w:t>second</w:t></w:p></w:document>'}))
    (folder / "f.pptx").write_bytes(_zip({f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:t>slide {i}</a:t></a:p></p:sp></p:sld>' for i in (10, 2)}))
    opf = '<package xmlns="o"><manifest><item href="x%2.xhtml" media-type="text/css"/><item href="t/one.xhtml" media-type="application/xhtml+xml"/></manifest></package>'
    container = '<container xmlns="c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'
    (folder / "g.epub").write_bytes(_zip({"META-INF/container.xml": container, "O/p.opf": opf, "O/t/one.xhtml": "<p>chapter &eacute;</p>"}))
    (folder / "broken.docx").write_bytes(b"no zip")
    (folder / "h.bin").write_bytes(b"\x00")
    (folder / "empty.txt").write_text(" \n")


def test_extract_every_format(spark, tmp_path):
    _write(tmp_path)
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in files.extracted(files.scan(spark, str(tmp_path))).collect()}
    assert got["c.html"][0] == "T\none\ntwo\n&lt; three" and got["d.md"][0] == "Head\nbold and code\nitem\n!alt link"
    assert got["e.docx"][0] == "first part\n\nsecond" and got["f.pptx"][0] == "slide 2\n\nslide 10" and got["g.epub"][0] == "chapter é"
    assert got["a.txt"][0].startswith("Grüße\nzeile") and got["b.TXT"][0].startswith("latin é")
    assert got["broken.docx"][0] is None and "BadZipFile" in got["broken.docx"][1] and got["h.bin"][1] == "unsupported format" and got["empty.txt"][1] == "no text content"


def test_scan_filters_and_loader(spark, tmp_path):
    _write(tmp_path)
    names = lambda df: sorted(r.path.rpartition("/")[2] for r in df.select("path").collect())
    assert names(files.scan(spark, str(tmp_path), extensions=(".txt",))) == ["a.txt", "b.TXT", "empty.txt"]
    assert names(files.scan(spark, str(tmp_path), recursive=False, extensions=(".txt",))) == ["a.txt", "empty.txt"]
    assert names(files.scan(spark, str(tmp_path), name_pattern="^[ab]")) == ["a.txt", "b.TXT", "broken.docx"]
    loaded = {r.filename: r for r in files.load_documents(files.scan(spark, str(tmp_path)), max_length=60).collect()}
    assert sorted(loaded) == ["a.txt", "b.TXT", "d.md"] and loaded["d.md"].text.startswith("# Head") and loaded["a.txt"].char_count == 60 and loaded["b.TXT"].file_type == ".txt"
    done = {r.output: r.status for r in files.ingest(files.scan(spark, str(tmp_path))).collect()}
    assert done == {"c_html.txt": "processed", "d_md.txt": "processed", "g_epub.txt": "processed"}
    decoded = files.scan(spark, str(tmp_path), extensions=(".txt",)).select("path", files.decoded(F.col("content")).alias("t")).collect()
    assert {r.path.rpartition("/")[2]: r.t for r in decoded}["a.txt"].startswith("Grüße\nzeile")


def test_extractor_registry():
    @extractors.register(".xyz")
    def shout(content):
        return content.decode().upper()

    assert extractors.extract(".XYZ", b"a") == ("A", None) and extractors.extract(".rtf", b"")[1] == "unsupported format"
    del extractors.EXTRACTORS[".xyz"]


def test_records_tokens_and_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, 'a "b"\nc', "x_txt.txt"), (2, "d", "y_txt.txt")], "doc_id int, text string, output string")
    sinks.write_json(docs, str(tmp_path / "j"))
    assert sorted(r.text for r in files.records(spark, str(tmp_path / "j"), "json").collect()) == ['a "b"\nc', "d"]
    docs.write.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted(r.text for r in files.records(spark, str(tmp_path / "c"), "csv").collect()) == ['a "b"\nc', "d"]
    sinks.write_named(docs, str(tmp_path / "n"))
    assert {p.name for p in (tmp_path / "n").iterdir()} >= {"output=x_txt.txt", "output=y_txt.txt"}
    sinks.write_corpus(docs, str(tmp_path / "t"))
    assert sorted(r.line for r in files.line_records(spark, str(tmp_path / "t"), "*.txt").collect()) == ['a "b"', "c", "d"]
    (tmp_path / "npy").mkdir()
    np.save(tmp_path / "npy/a.npy", np.arange(5, dtype=np.int32))
    assert files.token_files(files.scan(spark, str(tmp_path / "npy"))).first().tokens == [0, 1, 2, 3, 4]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nB\n\na"), (2, "b\nc")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.unique_lines(streams.file_stream(spark, str(tmp_path / "in"), rows.schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.line.lower() for r in out.collect()) == ["a", "b", "c"]
    more = spark.createDataFrame([(3, "A\nd")], "doc_id long, text string")
    more.write.mode("append").parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.unique_lines(streams.file_stream(spark, str(tmp_path / "in"), rows.schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.line.lower() for r in out.collect()) == ["a", "b", "c", "d"]
