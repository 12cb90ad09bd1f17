import io
import struct
import wave
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parchment.functions import audio as A
from parchment.sources import epub, paged, plain, services


def test_plain_chapters(spark):
    rows = [("m", "intro line\n# One #\nfirst\n12\nsecond\n## 2. TWO\nthird"), ("h", "CHAPTER I\nalpha.\nCHAPTER II\nbeta."), ("s", "just one line.")]
    got = {(r.path, r.chapter): (r.title, r.paragraphs) for r in plain.chapters(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got[("m", 0)] == (None, ["intro line"]) and got[("m", 1)] == ("One", ["first", "second"]) and got[("m", 2)] == ("Two", ["third"])
    assert got[("h", 0)][1] == ["CHAPTER I", "alpha."] and got[("h", 1)] == ("Chapter ii", ["beta."])
    assert got[("s", 0)] == (None, ["just one line."])


def test_kinds(spark):
    rows = [("a.epub", 0, False, "epub"), ("b.TXT", 0, False, "plain"), ("c.pdf", 10, False, "image"), ("d.pdf", 900, True, "ocr"), ("e.pdf", 900, False, "text"), ("f.doc", 0, False, None)]
    df = spark.createDataFrame(rows, "p string, c int, o boolean, want string")
    assert all(r.k == r.want for r in df.withColumn("k", plain.kind_of(F.col("p"), F.col("c"), F.col("o"))).collect())


def book(tmp_path):
    long = "<p>" + "word " * 60 + "</p>"
    files = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>',
        "OEBPS/c.opf": '<package><metadata><title>My Book</title><creator>Doe, Jane</creator><language>en-GB</language><date>1999-05</date><meta name="cover" content="img"/></metadata><manifest>'
        '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="img" href="i/c.jpg" media-type="image/jpeg"/>'
        '<item id="a" href="cover.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/one.xhtml" media-type="application/xhtml+xml"/><item id="c" href="t/short.xhtml" media-type="application/xhtml+xml"/></manifest>'
        '<spine><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/></spine></package>',
        "OEBPS/toc.ncx": '<ncx><navPoint><navLabel><text> First  one </text></navLabel><content src="t/one.xhtml#x"/></navPoint></ncx>',
        "OEBPS/cover.xhtml": long, "OEBPS/t/one.xhtml": "<h1>First</h1>" + long, "OEBPS/t/short.xhtml": "<p>tiny</p>",
    }
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    (tmp_path / "broken.epub").write_bytes(b"no archive")


def test_epub(spark, tmp_path):
    book(tmp_path)
    archives = epub.read_archives(spark, str(tmp_path))
    meta = epub.metadata(archives).collect()
    assert len(meta) == 1 and (meta[0].title, meta[0].creator, meta[0].language, meta[0].year, meta[0].cover) == ("My Book", "Jane Doe", "en", "1999", "i/c.jpg")
    chapters = epub.chapters(archives).collect()
    assert [(c.pos, c.title, c.paragraphs[0]) for c in chapters] == [(1, "First one", "First")]


def test_archives_go_on_in_pieces(spark):
    """A batch's documents aren't held at once, and chapters are read where their archive is opened, by one function."""
    books = [epub.packed(f"B{i}", "Ann", "fr", "1900", [(f"c{i}.xhtml", "T", f"<p>{'x' * 300_000}</p>")]) for i in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array([*map(str, range(12)), "none", "bad"]), pa.array([*books, None, b"bad"])], names=["path", "content"])
    for made, columns in ((lambda s, _: s, epub.SPINE), (lambda _, m: [m], epub.META)):
        pieces = list(epub._each(made, columns)(iter([batch, batch.slice(12)])))
        assert [p for b in pieces for p in b.column("path").to_pylist()] == [*map(str, range(12))] and max(b.num_rows for b in pieces) <= 4
    archives = spark.createDataFrame([("a", bytes(books[0])), ("b", b"bad")], "path string, content binary")
    chapters = epub.chapters(archives)
    assert "EvalPython" not in chapters._jdf.queryExecution().executedPlan().toString()
    assert [(c.path, c.pos, c.title, c.paragraphs) for c in chapters.collect()] == [("a", 0, "T", ["x" * 300_000])]


def test_segments_and_timing(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"idx": 0, "text": "a", "pause_after_ms": 5}\n{"idx": 1, "text": "b", "role": "x"}\n')
    assert [r.role for r in plain.read_segments(spark, str(tmp_path / "s.jsonl")).orderBy("idx").collect()] == ["narrateur", "x"]
    (tmp_path / "t.json").write_text('[{"idx": 0, "start": 0.6, "end": 1.2, "text": "a"}, {"idx": 1, "start": 1.2, "end": 2, "clean": false}]')
    assert [r.clean for r in plain.read_timing(spark, str(tmp_path / "t.json")).orderBy("idx").collect()] == [True, False]
    df = spark.createDataFrame([(1, "a")], "idx int, text string")
    assert plain.write_if_changed(df, str(tmp_path / "out"), ["idx"]) and not plain.write_if_changed(df, str(tmp_path / "out"), ["idx"])
    assert plain.write_if_changed(df.withColumn("text", F.lit("b")), str(tmp_path / "out"), ["idx"])


def test_wav(spark):
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<6h", 0, 32767, -32768, -32768, 16384, 0))
    got = spark.createDataFrame([(1, bytearray(raw.getvalue())), (2, bytearray(b"x")), (3, None)], "i int, b binary").select("i", A.decode_wav("b").alias("a")).orderBy("i").collect()
    assert np.allclose(got[0].a, [32767 / 65536, -1, 0.25]) and got[1].a is None and got[2].a is None


def test_paged_source(spark):
    rows = [(i, f"v{i}") for i in range(250)]
    spark.dataSource.register(paged.paged_source("voices", "id int, name string", lambda o, n: rows[o : o + n], lambda: len(rows)))
    df = spark.read.format("voices").load()
    assert df.count() == 250 and df.rdd.getNumPartitions() == 3


def test_services(spark):
    items = spark.createDataFrame([("mot", "le mot"), ("vie", "la vie")], "word string, context string")
    assert {(r.word, r.proposal) for r in services.asked(items, services.Echo, 1).collect()} == {("mot", "mot"), ("vie", "vie")}

    class Down:
        def ask(self, _):
            return "sorry"

    assert [r.proposal for r in services.asked(items, Down).collect()] == [None, None]
