"""Odd letters, blanks, places and sizes: what the queries' SQL says of them."""

import json
import re
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from parchment.functions import audio as A
from parchment.functions import misc as M
from parchment.functions import text as T
from parchment.operators import library, pages, proofreading, review, sheets
from parchment.plans import ORACLE_SQL, QUERIES, registry
from parchment.sources import services
from parchment.sources import pages as web


class Hum:
    def say(self, text):
        return np.zeros(len(text), np.float32)


def test_audio_goes_on_in_pieces(spark, monkeypatch):
    """A batch's audio isn't held at once; texts, and their order, stay."""
    monkeypatch.setattr(services, "SAID_BYTES", 40)

    class Frame:
        schema = spark.createDataFrame([("a",)], "text string").schema

        def mapInPandas(self, run, schema):
            return list(run(iter([pd.DataFrame({"text": ["abcd", "abcdefgh", None, "abcdefghijkl", "a"]}), pd.DataFrame({"text": []})])))

    pieces = services.synthesised(Frame(), Hum)
    assert [list(p["text"]) for p in pieces] == [["abcd", "abcdefgh"], [None, "abcdefghijkl"], ["a"]]
    assert [len(a) for p in pieces for a in p["audio"]] == [4, 8, 0, 12, 1]


def test_batches_are_bounded_by_bytes(spark):
    """Tables of the queries come with bounds; a worker gets long texts in several batches."""
    registry.table(spark, "/root/testdata/sf0.001", "documents")
    long = spark.range(0, 12, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = long.mapInPandas(lambda bs: (pd.DataFrame({"n": [len(b)]}) for b in bs), "n long").collect()
    assert sum(r.n for r in sizes) == 12 and max(r.n for r in sizes) <= 5


def test_lines_of_odd_letters(spark):
    """Capitals with accents are vowels, ß has no two capitals, wide blanks are blanks, a vertical tab is none."""
    rows = [("CAPÍTULO x", True), ("CHAPITREé du soir ou non", True), ("ÉTÉS Île", False), ("Ît Ôt Ât", False), ("Ît Ôt xx", False), ("Ît xx vv", True), ("straß", False), ("STRAﬁ", True), ("　abc xyz 　", False), ("abc\x0bxyz", True), ("abc ", True)]
    df = spark.createDataFrame(rows, "t string, want boolean").withColumn("got", M.garbage(F.col("t"), F.lit(9), F.lit(5), F.lit(24)))
    assert [(r.t, r.got) for r in df.collect() if r.got != r.want] == []


def test_small_negative_samples_keep_their_sign(spark):
    df = spark.createDataFrame([(-1e-7,), (1e-7,), (-0.0,), (0.0,), (-0.0078125,), (None,)], "x double").select(A.rounded(F.col("x"), 6).alias("r"))
    assert [repr(r.r) for r in df.collect()] == ["-0.0", "0.0", "-0.0", "0.0", "-0.007813", "None"]


def test_references_are_read_once(spark):
    said = {"&#38;lt;": "&lt;", "&amp;#233;&#233;": "&#233;é", "a&nbsp;b&": "a\u00a0b&", "&quo;&#xD800;&#99999999;": "&quo;\ufffd&#99999999;", "&amp;quot;": "&quot;"}
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert {r.s: r.got for r in df.withColumn("got", sheets.unescaped(F.col("s"))).collect()} == said


def test_short_and_wide_lines_of_pages(spark, tmp_path):
    """Of two fonts with as many characters the line's own counts; what the page escapes twice stays escaped; wide blanks go."""
    html = "<p>to </p><p>a &amp;lt; b &lt;</p><p>\u3000wide\u3000</p>"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["page_geometry"](spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.text, r.font) for r in got] == [("a &lt; b &lt;", "fonts/a.ttf"), ("to", "fonts/a.ttf"), ("wide", "fonts/a.ttf")]


def test_places_before_a_text(spark):
    """A place before the text isn't one from its end."""
    r = spark.range(1).select(library.relocated(F.lit("abc to xyz to"), F.lit("to"), F.lit(-3)).alias("a"), library.relocated(F.lit("abc to xyz to"), F.lit("to"), F.lit(11)).alias("b")).first()
    assert (r.a, r.b) == (4, 11)


def test_heads_are_read_letter_by_letter(spark):
    """ß stays one sign that no head has; dotless and long letters have capitals."""
    heads = {"Straße": "STRA E", "straße ſı": "STRA E SI", "ÿ é÷ß": "É", "ﬁn": "N", "×": "×"}
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    assert {r.h: r.got for r in df.withColumn("got", T.head_letters(F.col("h"))).collect()} == heads
    lines = spark.createDataFrame([("b", "STRAßE IST", 5.0, 12.0), ("b", "STRAﬁ IST", 5.0, 12.0)], "k string, text string, y double, h double")
    assert [r.running for r in pages.classify(lines, ["k"], F.lit(10.0), F.lit(100.0), F.lit(False)).orderBy("text").collect()] == [False, True]


def test_a_model_is_asked_once(spark, tmp_path):
    """What proofreading steps share is computed once: every word in doubt goes to the model a single time."""
    said = str(tmp_path / "said")

    class Listener:
        def ask(self, prompt):
            words = [e["word"] for e in json.loads(prompt)]
            with open(said, "a") as f:
                f.write("".join(w + "\n" for w in words))
            return json.dumps([{"id": i, "correction": w} for i, w in enumerate(words)])

    texts = spark.createDataFrame([(1, "alpha zzqq beta"), (2, "alpha wwkk beta")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("alpha",), ("beta",)], "form string")
    got = proofreading.proofread(texts, lexicon, Listener).select("doc_id", "word", "offset", "proposal").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "zzqq", 6, "zzqq"), (2, "wwkk", 6, "wwkk")]
    with open(said) as f:
        assert sorted(f.read().split()) == ["wwkk", "zzqq"]


def test_places_hold_few_python_objects():
    """Places of words are Arrow arrays: a batch of texts takes a small multiple of its bytes, and nulls, blanks and odd letters keep their places."""
    texts = pa.array(["Élan  vital", None, "", "…", *["une phrase de mots"] * 20_000])
    tracemalloc.start()
    got = review.placed(texts, re.compile(T.WORD))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.slice(0, 4).to_pylist() == [[{"offset": 0, "word": "Élan"}, {"offset": 6, "word": "vital"}], [], [], []]
    assert len(got) == 20_004 and peak < 2_000_000
    assert review.placed(pa.array([], pa.string()), re.compile(T.WORD)).to_pylist() == []


ODD_PAGES = [
    "<p>token = &quot", "<p>cut &cop", "<p>cut <p cla", "<p>cut<footer", "<p>cut</p><nav", "<title>cut<head", "<p>&copy &COPY; &lt;&eacute;&#233;&nbsp;&amp;quot;", "<nav>a<nav>b</nav>c</nav>d", "<script>x<p>y", "<!-- a <p>b", "<!-->c-->d<ſcript>e</SCRIPT>f",
    "\u3000wide\u00a0 in\u00a0side\x0b<p>\u2028\x85", "<lı>i<BLOCKQUOTE\n>q<header>h<head>gone", "a\x01b<br>c<1>d< p>e<é>", "", None,
]


def test_odd_pages_read_as_in_the_sql(spark, tmp_path):
    """Pages that end within a reference or a tag, nested silent elements, odd blanks and letters."""
    rows = [(i, "u", h) for i, h in enumerate(ODD_PAGES)] + [(100 + i, "u", h and h + "<p>" + "word " * 50) for i, h in enumerate(ODD_PAGES)] + [(200 + i, "u", "word &quot;" * 30 + (h or "")) for i, h in enumerate(ODD_PAGES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as c:
        c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        for name in ("html_blocks", "epub_chapters"):
            got = QUERIES[name](spark, str(tmp_path))
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, c.sql(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall())), name


def test_blocks_take_linear_time():
    """What is never closed is looked for once; without the queries' list every reference is read."""
    assert web.blocks_of("<script>" * 100_000 + "<a" * 100_000 + "x") == ["<a" * 100_000 + "x"]
    assert web.blocks_of("<p>&eacute;&#233;&quot") == ['éé"'] and web.blocks_of("<p>&eacute;&quot", web.named) == ["&eacute;&quot"]


def test_aligned_texts_move_once(spark, tmp_path, monkeypatch):
    """Texts of large heads are dealt out with the first one; only they and the heads' digests are exchanged, no words."""
    monkeypatch.setattr(review, "HEAD_TEXTS", 3)
    rng = np.random.default_rng(5)
    words = "un Un deux trois quatre l’âne ÉTÉ été x1 «".split()
    rows = [(i, (f"tête {i % 4 if i < 40 else i}" + "\n" * (i % 7 > 0) + " ".join(rng.choice(words, rng.integers(0, 25)))) if i % 11 else None) for i in rng.permutation(60).tolist()] + [(-1, "tête 1\n"), (61, ""), (62, ""), (None, "tête 1\nun")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["alignment_truth"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(f"select {', '.join(got.columns)} from ({ORACLE_SQL['alignment_truth']})".replace("id, offset", 'id, "offset"')).fetchall()
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == sorted(want)
