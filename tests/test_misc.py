import random

from pyspark.sql import functions as F

from parchment import cli
from parchment.functions import audio as A
from parchment.functions import misc as M
from parchment.operators import pages, versions


def test_settings_and_names(spark):
    r = spark.range(1).select(
        M.merged_settings(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit(""), F.lit("c"), F.lit("3"), F.lit("x"), F.lit("9")), ["a", "b", "c"]).alias("m"),
        M.setting(F.lit(None).cast("string"), F.lit("e"), F.lit("d")).alias("s"), M.masked(F.lit("secret99")).alias("k"), M.chosen(F.lit("b, a b")).alias("c"), M.chosen(F.lit(" ")).alias("none"),
        M.inverted_author(F.lit("Doe, Jane")).alias("author"), M.short_title(F.lit("Night - a tale")).alias("short"), M.year_of(F.lit("D:19990101")).alias("year"),
        M.spoken_minutes(F.lit(3840)).alias("t"), M.decoded(F.lit("a?b"), F.create_map(F.lit("?"), F.lit("fi"))).alias("glyph"), M.dehyphenated(F.array(F.lit("hyphen-"), F.lit("ated"), F.lit("line"))).alias("line"),
        M.header_words(F.lit("12 LA MER x, Ab *** IX")).alias("head"), M.clamp(F.lit(None).cast("double"), 0, 1).alias("null"),
    ).first()
    assert r.m == {"a": "1", "c": "3"} and tuple(r.s) == ("e", "environment") and r.k == "****et99" and r.c == ["b", "a"] and r.none is None
    assert (r.author, r.short, r.year, r.t, r.glyph, r.line, r.head, r.null) == ("Jane Doe", "Night", "1999", "1 h 04", "afib", "hyphenated line", "12 LA MER IX", None)


def test_baselines_are_folded_in_order(spark):
    rows = [(1, 10.0, 500.0, 10.0, "Il", False), (1, 40.0, 499.0, 11.0, "était", False), (1, 90.0, 498.5, 10.0, "une", True), (1, 10.0, 480.0, 10.0, "fois", False), (2, 0.0, 9.0, 10.0, "seul", False)]
    got = pages.merged_baselines(spark.createDataFrame(rows, "page int, x double, y double, h double, text string, rare boolean")).orderBy("page", "pos").collect()
    assert [(r.page, r.text, r.h) for r in got] == [(1, "Il était", 11.0), (1, "une", 10.0), (1, "fois", 10.0), (2, "seul", 10.0)]


def test_fixed_paragraphs(spark):
    lines = [(1, "L", 10.0, 100.0, 30.0), (1, "e ciel est bleu et la mar-", 30.0, 98.0, 10.0), (1, "quise dort.", 10.0, 86.0, 10.0), (1, "Demain", 15.0, 74.0, 10.0), (1, "il pleut.", 10.0, 62.0, 10.0), (2, "Loin.", 10.0, 100.0, 10.0)]
    df = spark.createDataFrame([(1, *x) for x in lines], "chapter int, page int, text string, x double, y double, h double")
    packed = df.groupBy("chapter").agg(F.collect_list(F.struct("page", "text", "x", "y", "h")).alias("lines"))
    got = packed.mapInPandas(pages.fixed_paragraphs(10.0), "chapter int, pos int, text string").orderBy("pos").collect()
    assert [r.text for r in got][:2] == ["Le ciel est bleu et la marquise dort.", "Demain il pleut. Loin."]


def test_chapters_of_pages(spark):
    heads = ["", "CHAPITRE 1", "LA MER", "LA MER", "LE PORT", "CHAPITRE 2", "LE PORT", "LE PORT"]
    df = spark.createDataFrame([("b", i, h) for i, h in enumerate(heads)], "book string, page int, header string")
    n = F.regexp_extract("header", r"CHAPITRE (\d+)", 1).try_cast("int")
    got = pages.chapter_of_pages(df, ["book"], "page", n).orderBy("page").collect()
    assert [r.chapter for r in got] == [1, 1, 1, 1, 2, 2, 2, 2]


def test_versions(spark):
    c = spark.createDataFrame([("b", i, f"t{i}", [f"p{i}"], (i, i)) for i in (1, 2, 3)], "book_id string, chapter int, title string, paragraphs array<string>, pages struct<first:int,last:int>")
    m = {r.chapter: r for r in versions.merge_into_previous(c, 2).collect()}
    assert m[1].paragraphs == ["p1", "p2"] and tuple(m[1].pages) == (1, 2) and m[1].title == "t1" and m[2].title == "t3"
    assert [r.title for r in versions.delete(c, 2).orderBy("chapter").collect()] == ["t1", "t3"]
    assert versions.rename(c, 2, "new").where("title = 'new'").count() == 1 and versions.stale_after(c, 2).count() == 2


def test_audio(spark):
    rng = random.Random(4)
    samples = [0.0] * 2400 + [0.5 * rng.choice((-1, 1)) for _ in range(4800)] + [0.0] * 7200 + [0.4] * 480 + [0.0] * 960
    df = spark.createDataFrame([(samples,)], "a array<float>").withColumn("l", A.loud_frames(F.col("a"), 240))
    r = df.select("l", F.size(A.trim_edges(F.col("a"), F.col("l"), 240)).alias("n"), A.last_run(F.col("a"), F.col("l"), 240, 24000.0, 20).alias("run"), A.trailing_artifact(F.col("l"), 10.0, 20, 400.0).alias("x"), F.size(A.joined(F.array(F.struct(F.col("a").alias("audio"), F.lit(100).alias("pause_ms"))))).alias("j"),
                  F.size(A.spliced(F.col("a"), F.lit(10), F.lit(20), F.array(F.lit(1.0).cast("float")))).alias("s"), A.quantised(F.array(F.lit(2.0), F.lit(-0.5))).alias("q")).first()
    assert r.l[0] == 10 and r.l[-1] == 61 and len(r.l) == 22
    assert r.n == (min(66, 62 + 4) - 6) * 240
    assert abs(r.run - 2 * 240 / 24000) < 1e-9 and r.x and r.j == 14400 + len(samples) + 2400 and r.s == len(samples) - 9 and r.q == [32767, -16383]


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master=None: spark)
    (tmp_path / "book.txt").write_text("# One\nIl y a 3 chats. Ils dorment dans la grande maison bleue.\n# Two\n— Oui ! dit-elle en riant de tout son cœur...\n")
    cli.main(["ingest", str(tmp_path / "book.txt"), str(tmp_path / "md")])
    texts = [r.value for r in spark.read.text(str(tmp_path / "md"), wholetext=True).collect()]
    assert sorted("title" in t for t in texts) == [True, True] and any("Il y a 3 chats" in t for t in texts)
    (tmp_path / "in").mkdir()
    for i, t in enumerate(texts):
        (tmp_path / "in" / f"ch{i}.md").write_text(t)
    cli.main(["segment", str(tmp_path / "in"), str(tmp_path / "seg")])
    rows = spark.read.json(str(tmp_path / "seg")).collect()
    assert any("trois chats" in r.text for r in rows) and any(r.role == "dialogue" and r.pause_after_ms == 1250 for r in rows)


def test_violations_at_any_depth(spark):
    import json

    from parchment.functions.misc import violations

    deep = {"hate": {"violated": True}}
    for k in range(30):
        deep = {f"n{k}": [1, deep]}
    rows = [(json.dumps(deep),), ('{"a": {"violated": true, "b": {"violated": true}}, "c": {"violated": false}}',), ("{broken",), (None,), ('[{"x": {"violated": 1}}]',)]
    got = [r.v for r in spark.createDataFrame(rows, "j string").select(violations("j").alias("v")).collect()]
    assert got == [["hate"], ["a"], [], [], ["x"]]


def test_a_service_gets_three_tries():
    import pytest

    from parchment.sources.services import Unavailable, retried

    calls = []

    def failing(n):
        calls.append(n)
        if len(calls) < n:
            raise Unavailable
        return len(calls)

    assert retried(failing, 3, wait=0.0) == 3
    calls.clear()
    with pytest.raises(Unavailable):
        retried(failing, 4, wait=0.0)
    assert len(calls) == 3
