"""PDF files, token files, text sinks, settings files, logs and the command line."""

import io
import json
import logging
import pickle
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import __main__ as cli
from lexmill import config, logs
from lexmill.operators import dedup, reports, sequences
from lexmill.sources import extractors, files, pdf, sinks


def pdf_file(pages, info=b"", encrypt=False, packed=False, image=False):
    """A small PDF with one content stream a page."""
    table = b"/CIDInit begincmap 1 beginbfchar <0041> <00E90021> endbfchar 1 beginbfrange <0042> <0044> <0061> <0050> <0051> [<0078> <0079>] endbfrange endcmap"
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 4: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", 5: b"<</Type/Font/Subtype/Type0/ToUnicode 6 0 R>>"}
    things = b"/XObject<</I 7 0 R>>" if image else b""
    objects[2] = b"<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))) + b"]/Resources<</Font<</F1 4 0 R/F2 5 0 R>>" + things + b">>/Count %d>>" % len(pages)
    streams = {6: (b"", table), 7: (b"/Subtype/Image", b"x")}
    for i, content in enumerate(pages):
        objects[10 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * i)
        streams[11 + 2 * i] = (b"", content)
    if info:
        objects[8] = info
    out = b"%PDF-1.5\n"
    if packed:
        bodies, heads = b"", b""
        for k, v in objects.items():
            heads += b"%d %d " % (k, len(bodies))
            bodies += v + b" "
        streams[90] = (b"/Type/ObjStm/N %d/First %d" % (len(objects), len(heads)), heads + bodies)
        objects = {}
    for k, v in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    for k, (head, data) in streams.items():
        data = zlib.compress(data)
        out += b"%d 0 obj\n<<%s/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (k, head, len(data), data)
    return out + b"trailer\n<</Root 1 0 R/Info 8 0 R" + (b"/Encrypt 9 0 R" if encrypt else b"") + b">>\n%%EOF"


PAGES = [
    rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ T* (caf\351) Tj ET",
    b"",
    b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <0041> Tj 1 0 0 1 90 700 Tm <00420043> Tj 1 0 0 1 72 600 Tm <00500051> Tj ET",
]


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_pages(packed):
    content = pdf_file(PAGES, b"<</Title(A \\(b\\))/Author<FEFF00E9>>>", packed=packed, image=True)
    texts = ["Hello (big) world\nsecond line\ncafé", "", "é!ab\nxy"]
    assert pdf.page_texts(content) == texts
    assert pdf.page_texts(content, [2, 7, -1, 0]) == [texts[2], texts[0]]
    assert extractors.extract(".PDF", content) == (f"{texts[0]}\n\n{texts[2]}", None)
    info = pdf.info(content)
    assert (info["page_count"], info["metadata"], info["encrypted"], info["has_images"], info["file_size"]) == (3, {"Title": "A (b)", "Author": "é"}, False, True, len(content))


def test_pdf_odd_files():
    assert extractors.extract(".pdf", b"no pdf")[1].startswith("ValueError")
    assert extractors.extract(".pdf", pdf_file([b""])) == (None, "no text content")
    assert pdf.info(pdf_file(PAGES, encrypt=True))["encrypted"] and not "".join(pdf.page_texts(pdf_file(PAGES, encrypt=True)))
    cut = pdf_file(PAGES)[:-200]
    assert isinstance(extractors.extract(".pdf", cut), tuple)


def test_pdf_frames(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_file(PAGES))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    found = files.scan(spark, str(tmp_path))
    rows = {(r.path.rsplit("/", 1)[1], r.page): (r.text, r.error) for r in files.pdf_pages(found, [2, 9]).collect()}
    assert rows == {("a.pdf", 2): ("é!ab\nxy", None), ("b.pdf", None): (None, "not a PDF file")}
    text = files.pdf_texts(found).collect()
    assert len(text) == 1 and text[0].text == "Hello (big) world\nsecond line\ncafé\n\né!ab\nxy" and 0 < text[0].score < 1
    info = {r.path.rsplit("/", 1)[1]: (r.page_count, r.error) for r in files.pdf_info(found).collect()}
    assert info == {"a.pdf": (3, None), "b.pdf": (None, "not a PDF file")}


def saved_tensor(values):
    """What a tensor library's archive of one tensor of integers looks like."""

    class Storage:
        def __init__(self, key, n):
            self.key = ("storage", Kind("torch", "LongStorage"), key, "cpu", n)

    class Kind:
        def __init__(self, module, name):
            self.module, self.name = module, name

    out = io.BytesIO()

    class Pickler(pickle._Pickler):
        def persistent_id(self, x):
            return x.key if isinstance(x, Storage) else None

        def save(self, x, *a, **b):
            if isinstance(x, Kind):
                self.write(b"c" + f"{x.module}\n{x.name}\n".encode())
            elif isinstance(x, Tensor):
                self.save(Kind("torch._utils", "_rebuild_tensor_v2"))
                self.save((Storage("0", len(values)), 1, (len(values) - 1,), (1,), False, {}))
                self.write(b"R")
            else:
                super().save(x, *a, **b)

    class Tensor:
        pass

    Pickler(out, 2).dump(Tensor())
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("t/data.pkl", out.getvalue())
        z.writestr("t/data/0", np.array(values, "<i8").tobytes())
    return archive.getvalue()


def test_token_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1, 2], [3, 4]], np.int32))
    (tmp_path / "b.pt").write_bytes(saved_tensor([9, 8, 7]))
    got = {r.path.rsplit("/", 1)[1]: r.tokens for r in files.token_files(files.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.npy": [1, 2, 3, 4], "b.pt": [8, 7]}
    with pytest.raises(pickle.UnpicklingError):
        evil = io.BytesIO()
        with zipfile.ZipFile(evil, "w") as z:
            z.writestr("t/data.pkl", b"cos\nsystem\n(S'true'\ntR.")
        files._saved_tensor(evil.getvalue())


def test_marks_of_encodings():
    assert extractors.extract(".html", b"\xef\xbb\xbf<p>x</p>")[0] == "x" and extractors.extract(".txt", b"\xef\xbb\xbfx")[0] == "\ufeffx"
    assert extractors.processor_name(".HTM") == "html" and extractors.processor_name(".zip") is None


def test_named_texts(spark, tmp_path):
    docs = spark.createDataFrame([("a.txt", "x"), ("b.txt", None), ("a.txt", "z"), ("../c", "no"), (None, "no")], "output string, text string")
    place = str(tmp_path / "out")
    assert sorted((r.name, r.bytes) for r in sinks.write_texts(docs, place).collect()) == [("a.txt", 1), ("b.txt", 0)]
    assert (tmp_path / "out/a.txt").read_text() == "z" and not (tmp_path / "c").exists()
    with pytest.raises(FileExistsError):
        sinks.write_texts(docs, place)


def test_load_inputs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.md").write_text("# Head *bold*  text\n")
    (tmp_path / "bad.docx").write_bytes(b"no")
    (tmp_path / "plain.txt").write_bytes(b"without a mark")
    got = {r.filename: r.text for r in files.load_inputs(spark, str(tmp_path), min_length=1).collect()}
    assert got == {"a.md": "# Head *bold* text", "plain.txt": "without a mark"}
    assert files.load_inputs(spark, str(tmp_path / "sub/a.md"), min_length=1).count() == 1
    with pytest.raises(ValueError, match="bad.docx"):
        files.load_inputs(spark, str(tmp_path / "bad.docx"))


def test_yaml_settings(tmp_path):
    c = config.build({"dedup": {"similarity": 0.7}}, "small")
    for name in ("a.json", "b.yaml"):
        config.save(c, str(tmp_path / name))
        assert config.load(str(tmp_path / name)) == c
    (tmp_path / "c.yml").write_text("- 1\n")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "c.yml"))


def test_json_logs(tmp_path):
    log = logs.log_to(str(tmp_path / "log"), name="lexmill.test")
    log.info("one %s", 1, extra={"path": "p"})
    try:
        raise KeyError("k")
    except KeyError:
        log.exception("two")
    for h in log.handlers:
        h.close()
    one, two = map(json.loads, (tmp_path / "log").read_text().splitlines())
    assert (one["message"], one["path"], one["level"]) == ("one 1", "p", "INFO") and "KeyError" in two["error"]
    logging.getLogger("lexmill.test").handlers.clear()


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("The same long line here\nA line of its own, too\nthe same  long line here\n")
    (tmp_path / "in/b.txt").write_text("The same long line here\n")
    for command in (["clean"], ["dedup"], ["dedup", "--semantic"], ["load", "--min-length", "5"], ["ingest"]):
        out = tmp_path / "-".join(command)
        assert cli.main([command[0], str(tmp_path / "in"), str(out), *command[1:]]) == 0 and out.exists()
    assert (tmp_path / "dedup/a.txt").read_text() == "The same long line here\nA line of its own, too\n"
    assert (tmp_path / "dedup/b.txt").read_text() == ""
    assert cli.main(["dedup", str(tmp_path / "none"), str(tmp_path / "x")]) == 1


def test_similar_chunks_of_texts(spark):
    same = " ".join(f"w{i % 5}" for i in range(10))
    docs = spark.createDataFrame([(1, f"{same} {same} " + " ".join(f"v{i}" for i in range(10))), (2, "short"), (3, None), (4, " ")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_chunks, r.n_similar) for r in dedup.dedup_texts(docs, 0.99, 10).collect()}
    assert got[1] == (same + " " + " ".join(f"v{i}" for i in range(10)), 3, 1)
    assert got[2] == ("short", 1, 0) and got[3][1] == 0 and got[4][1:] == (0, 0)


def test_near_pairs_find_the_exact_ones(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 24))
    v = np.concatenate([base, base[:100] + rng.normal(size=(100, 24)) * 0.35, base[:1] * np.arange(1, 60)[:, None]])
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    exact = {(r.i, r.j) for r in dedup.similar_pairs(rows, 0.85).collect()}
    for block in (16, 1024):
        found = [(r.i, r.j) for r in dedup.near_pairs(rows, 0.85, block=block).collect()]
        assert len(found) == len(set(found)) and set(found) <= exact
        assert len(found) >= 0.9 * len(exact)


def test_numbered_equals_the_sorted_place(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101) for i in range(300)], "id long, v long").repartition(7)
    got = sorted((r.v, r.id, r.number) for r in sequences.numbered(rows, [F.col("v"), F.col("id")]).collect())
    assert [x[2] for x in got] == list(range(300))
    assert sequences.numbered(rows.limit(0), ["v"]).count() == 0
    last = sequences.batches(rows, ["v", "id"], 64, drop_last=True)
    assert last.count() == 256 and sequences.batches(rows, sequences.shuffled("id", 1), 64).select("batch_id").distinct().count() == 5


def test_locate_samples_over_uneven_files(spark):
    sizes = [0, 1, 500, 0, 3, 40, 0]
    files_ = spark.createDataFrame([(f"f{i}", n * 16 + 16 if n else 0) for i, n in enumerate(sizes)], "file string, n_tokens long")
    counted = sequences.sample_counts(files_, 16, 16)
    total = counted.agg(F.sum("n_samples")).first()[0]
    idx = spark.range(-3, total + 3).withColumnRenamed("id", "idx")
    got = sorted((r.idx, r.file, r.local_idx) for r in sequences.locate_samples(idx, counted).collect())
    want, at = [], 0
    for r in sorted(counted.collect(), key=lambda r: r.file):
        for k in range(r.n_samples):
            want.append((at, r.file, k))
            at += 1
    assert got == want
    assert sequences.locate_samples(idx, counted.limit(0)).count() == 0


def test_reports_on_odd_rows(spark):
    rows = spark.createDataFrame([("a", None, 5), ("b", "bad", 7)], "path string, error string, size int")
    r = reports.processing_summary(rows.limit(0), F.col("error"), F.col("size")).first()
    assert (r.total_files, r.success_rate, r.error_types) == (0, 0.0, 0)
    v = spark.createDataFrame([(1, [3.0, None, -4.0]), (2, None), (3, [])], "g int, v array<double>")
    assert {x.g: (x.norm, x.n) for x in reports.vector_norms(v, ["g"], "v").collect()} == {1: (5.0, 2)}
    assert reports.vector_norms(v, ["g"], "v", float("inf")).first().norm == 4.0
