import random
import re
import time

import pytest
from pyspark.sql import functions as F

from parchment.functions import numbers
from parchment.functions import text as T


def one(spark, column, *values):
    """column over a one-row frame whose columns are a, b, ..."""
    names = "abcdef"[: len(values)]
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(names, values)])
    return row.select(column.alias("x")).first().x


def plain_pieces(sentence, patterns=(r"(?<=[;:])\s+", r"(?<=,)\s+")):
    if len(sentence) <= 250:
        return [sentence]
    for k, p in enumerate(patterns):
        parts = re.split(p, sentence)
        if len(parts) > 1:
            return [x for part in parts for x in plain_pieces(part.strip(), patterns[k + 1 :])]
    out = [""]
    for w in sentence.split():
        if out[-1] and len(out[-1]) + 1 + len(w) > 250:
            out.append(w)
        else:
            out[-1] = f"{out[-1]} {w}".strip()
    return out


def plain_segments(paragraph):
    out, cur = [], ""
    for s in (x.strip() for x in re.split('(?<=[.!?…])\\s+(?=[«"A-ZÀ-ÝŒ—])', paragraph)):
        if not s:
            continue
        pieces = plain_pieces(s)
        for i, p in enumerate(pieces):
            if cur and len(cur) + 1 + len(p) > 250:
                out.append((cur, False))
                cur = p
            else:
                cur = f"{cur} {p}".strip()
            if i == len(pieces) - 1 and len(cur) >= 30:
                out.append((cur, True))
                cur = ""
    return out + ([(cur, True)] if cur else [])


def test_segments_against_a_plain_fold(spark):
    rng = random.Random(1)
    words = ["la", "mer,", "Non.", "vie;", "Étoile", "x" * 40, "fin!", "et", "or:", "Oui?", "puis"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 160))) for _ in range(120)]
    texts.append("y" * 600 + " " + "z" * 30)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.segments(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [(x.text, x.ends) for x in r.s] == plain_segments(texts[r.i])


@pytest.mark.parametrize(
    "n, words",
    [(0, "zéro"), (16, "seize"), (17, "dix-sept"), (21, "vingt et un"), (71, "soixante et onze"), (80, "quatre-vingts"), (81, "quatre-vingt-un"), (91, "quatre-vingt-onze"), (99, "quatre-vingt-dix-neuf"),
     (100, "cent"), (200, "deux cents"), (201, "deux cent un"), (1000, "mille"), (1650, "mille six cent cinquante"), (80000, "quatre-vingt mille"), (200000, "deux cent mille"), (1000000, "un million"), (2000001, "deux millions un")],
)
def test_french_numbers(n, words):
    assert numbers.spell(n) == words


def test_normalisation(spark):
    full = T.tidy(T.capitalise_acronyms(numbers.spelled_numbers(T.unify(F.col("a")))))
    assert one(spark, full, "— Il y a (environ) 1 650 pas, dit l’ONU !") == "Il y a, environ, mille six cent cinquante pas, dit l'Onu!"
    assert one(spark, full, "« Quoi » ; , fin…") == "Quoi; fin…"
    assert numbers.spell_all(None) is None


def test_small_functions(spark):
    a = F.col("a")
    assert one(spark, T.role_of(a), "— Bonjour") == "dialogue" and one(spark, T.role_of(a), "-12") == "narrateur"
    assert [one(spark, T.persona_of(a), t) for t in ("@ Anna ", "@", "@narrateur", "mail@x")] == ["Anna", "", "", None]
    assert one(spark, T.clean_title(a), "  4. COMMENT  DRESSER * ") == "Comment dresser"
    assert one(spark, T.candidates(a), "l’Œuf-né") == ["oeuf", "né"] and one(spark, T.candidates(a), "l'") == ["l"]
    assert [one(spark, T.roman(a), t) for t in ("XIV", "MCMXC", "III")] == [14, 1990, 3]
    assert one(spark, T.clock(a), 3723) == "1:02:03" and one(spark, T.clock(a), 754) == "12:34"
    text, extra = T.defuse_ellipsis(a)
    assert one(spark, text, "... Ah.. oui...") == "Ah, oui" and one(spark, extra, "fin..") == 450 and one(spark, extra, "fin.") == 0
    edits = F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(w).alias("word"), F.lit(r).alias("replacement")) for o, w, r in ((0, "ab", "X"), (3, "cd", "LONG"), (6, "zz", "no"))])
    assert one(spark, T.apply_substitutions(a, edits), "ab cd ef") == "X LONG ef"
    assert one(spark, T.typewriter(a), "œuf… “a”") == 'oeuf... "a"'
    assert one(spark, T.paragraphs_of(a), "a\r\n\r\nb\nc\n\n \n\nd") == ["a", "b\nc", "d"]
    assert one(spark, T.word_count(a), "  a  b c ") == 3


def test_many_substitutions_copy_a_text_once(spark):
    """Edits meet what stands there by now; a text with many takes time in proportion, not a copy for each."""
    edits = [(0, "ab", "X"), (1, "bc", "cb"), (3, "é", ""), (3, "", "+"), (9, "", "end"), (4, "zz", "no")]
    assert T.substituted("abcé f", edits) == "acb+ fend"
    text, every = "le mot " * 50_000, [(7 * i, "le", "LE") for i in range(50_000)]
    began = time.perf_counter()
    assert T.substituted(text, every) == "LE mot " * 50_000 and time.perf_counter() - began < 5
    kind = "doc_id long, text string, edits array<struct<offset:int,word:string,replacement:string>>"
    rows = [(1, None, [(0, "a", "b")]), (2, "a", []), (3, "aa", None), (4, "aa", [(1, "a", "é"), (0, None, "x"), (None, "a", "x"), (0, "a", None), (-1, "a", "x")]), (5, text, every)]
    got = spark.createDataFrame(rows, kind).select("doc_id", T.apply_substitutions(F.col("text"), F.col("edits")).alias("t"))
    assert {r.doc_id: r.t for r in got.collect()} == {1: None, 2: "a", 3: "aa", 4: "aé", 5: "LE mot " * 50_000}


def test_numbers_of_any_length():
    from parchment.functions.numbers import spell_all

    assert spell_all("10 000 000 000 000") == "dix billions" and spell_all(str(10**12)) == "un billion"
    assert spell_all("a 1,5 b") == "a quinze b" and spell_all("80 000 000") == "quatre-vingts millions"
    for n in (19, 25, 66, 67, 5000):
        said = spell_all("x" + "9" * n + "y")
        assert not any(c.isdigit() for c in said) and said[0] == "x" and said[-1] == "y"


def test_alignment_tells_words_from_punctuation(spark):
    from parchment.operators.review import alignment_truth

    pairs = [(1, "« Le chien, noir. »", "« Le chat, noir. »"), (2, "un deux trois", "un DEUX et trois"), (3, "l'ane, (vieux)", "l’âne, (vieux)"), (4, "a b", "a"), (5, None, "x"), (6, "même texte", "même texte")]
    got = sorted(tuple(r) for r in alignment_truth(spark.createDataFrame(pairs, "id long, raw string, clean string")).collect())
    assert got == [(1, 5, "chien", "chat"), (2, 3, "deux", "DEUX"), (3, 0, "l'ane", "l’âne"), (4, 2, "b", "")]


def test_silences_of_a_chapter(spark):
    from pyspark.sql import functions as F

    from parchment.operators.segmentation import spoken_segments

    books = [
        ("a", 3, "", ["Il faisait beau.", "@Ann", "« Non » dit-elle ici...", "@", "— Oui, bien entendu."]),
        ("a", 0, "Avant", ["Un deux. Trois quatre cinq six sept huit neuf dix. Onze."]),
        ("b", 1, "Le départ", ["Texte."]),
        ("c", 1, "Chapitre 7", []),
    ]
    df = spark.createDataFrame(books, "book string, chapter int, title string, paragraphs array<string>")
    rows = {(r.book, r.chapter, r.idx): (r.role, r.text, r.pause_after_ms) for r in spoken_segments(df).collect()}
    assert rows == {
        ("a", 3, 0): ("narrateur", "Chapitre trois.", 2000), ("a", 3, 1): ("narrateur", "Il faisait beau.", 800), ("a", 3, 2): ("Ann", "Non dit-elle ici", 1250),
        ("a", 3, 3): ("dialogue", "Oui, bien entendu.", 800), ("a", 0, 0): ("narrateur", "Un deux. Trois quatre cinq six sept huit neuf dix.", 380), ("a", 0, 1): ("narrateur", "Onze.", 800),
        ("b", 1, 0): ("narrateur", "Le départ.", 2000), ("b", 1, 1): ("narrateur", "Texte.", 800),
    }
    stretched = spoken_segments(df, scale=1.5, announce=False).where(F.col("book") == "b").collect()
    assert [(r.text, r.pause_after_ms) for r in stretched] == [("Texte.", 1200)]


def test_segments_are_worked_out_once(spark):
    """A question of the optimizer's whether there are any, put before they are exploded, would cut every paragraph again."""
    from pyspark.sql import functions as F

    from parchment.operators.segmentation import spoken_segments
    from parchment.plans.text_queries import doc_segments

    books = spark.range(4).select(F.col("id").alias("book"), F.lit(1).alias("chapter"), F.lit("x").alias("title"), F.array(F.concat(F.lit("Un "), F.col("id").cast("string")), F.lit(None)).alias("paragraphs"))
    spoken = spoken_segments(books)
    for df in (spoken, doc_segments(spark, "/root/testdata/sf0.001")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(flatten(") == 1
    assert sorted(r.text for r in spoken.where("idx = 1").collect()) == ["Un deux", "Un trois", "Un un", "Un zéro"]


def test_only_texts_with_runs_are_rewritten(spark):
    rows = [("..",), ("a.b",), ("Un.. ,deux",), (None,), ("É, ;x ",), ("AÉ ab",), ("Ab C",), ("",)]
    df = spark.createDataFrame(rows, "a string")
    text, extra = T.defuse_ellipsis(F.col("a"))
    got = [tuple(r) for r in df.select(T.capitalise_acronyms(F.col("a")), text, extra).collect()]
    assert got == [("..", "", 0), ("a.b", "a.b", 0), ("Un.. ,deux", "Un,deux", 0), (None, None, 0), ("É, ;x ", "É,x", 0), ("Aé ab", "AÉ ab", 0), ("Ab C", "Ab C", 0), ("", "", 0)]
