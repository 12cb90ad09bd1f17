"""Commands from texts to tracks, on files."""

import io
import json
import wave

import pytest

from parchment import cli
from parchment.sources.services import Cutter  # noqa: F401  (named below)

BOOK = """# First light

The ship left the harbour at dawn. Nobody waved, and nobody had been asked to.

— And the mail? said the mate.

# Second light

The ship came back without its mate. The xharbour was empty.
"""


@pytest.fixture(autouse=True)
def _one_session(spark, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master=None: spark)


def rows(spark, path):
    return [r.asDict() for r in spark.read.json(str(path)).collect()]


def test_from_text_to_tracks(spark, tmp_path, capsys):
    (tmp_path / "book.txt").write_text(BOOK)
    out = f"file://{tmp_path}"
    cli.main(["run", f"{out}/book.txt", f"{out}/made"])
    segments = sorted(rows(spark, tmp_path / "made/segments"), key=lambda r: (r["chapter"], r["idx"]))
    assert any("First light" in r["title"] for r in segments) and all(r["pause_after_ms"] >= 250 for r in segments)
    assert {r["role"] for r in segments} == {"narrateur", "dialogue"} and {r["chapter"] for r in segments} == {1, 2}
    manifest = rows(spark, tmp_path / "made/sound/manifest")
    assert len(manifest) == len(segments) and all(r["end"] > r["start"] >= 0.6 for r in manifest)
    for r in spark.read.parquet(f"{out}/made/tracks").collect():
        with wave.open(io.BytesIO(bytes(r.wav))) as w:
            last = max((m["end"] for m in manifest if m["chapter"] == r.chapter), default=0)
            assert w.getframerate() == 24_000 and w.getnframes() / 24_000 >= last - 0.01
    capsys.readouterr()
    cli.main(["status", f"{out}/made/chapters"])
    assert json.loads(capsys.readouterr().out)["chapters"] == len({r["chapter"] for r in segments})


def test_chapters_and_proofreading(spark, tmp_path, capsys):
    out = f"file://{tmp_path}"
    (tmp_path / "book.txt").write_text(BOOK)
    (tmp_path / "clean.txt").write_text(BOOK.replace("xharbour", "harbour"))
    (tmp_path / "words.txt").write_text("\n".join(sorted(set(BOOK.lower().replace("xharbour", "harbour").replace(".", " ").replace(",", " ").replace("?", " ").split()))))
    for name in ("book", "clean"):
        cli.main(["ingest", f"{out}/{name}.txt", f"{out}/{name}"])
    numbers = sorted(r.chapter for r in cli._chapters(spark, f"{out}/book").collect())
    cli.main(["merge-chapter", f"{out}/book", f"{out}/merged", str(numbers[-1])])
    cli.main(["drop-chapter", f"{out}/book", f"{out}/dropped", str(numbers[-1])])
    assert [r.chapter for r in cli._chapters(spark, f"{out}/merged").collect()] == numbers[:-1] == [r.chapter for r in cli._chapters(spark, f"{out}/dropped").collect()]
    cli.main(["review", f"{out}/book", f"{out}/found", "--lexicon", f"{out}/words.txt"])
    assert [r["word"] for r in rows(spark, tmp_path / "found")] == ["xharbour"]
    cli.main(["proofread", f"{out}/book", f"{out}/report", "--lexicon", f"{out}/words.txt", "--model", "parchment.sources.services:Cutter", "--apply", f"{out}/fixed"])
    report = json.loads(rows(spark, tmp_path / "report")[0]["report"])
    assert (report["suspects"], report["asked"], report["suggestions"]) == (1, 1, []) and report["rejected"][0]["proposal"] == "xharbou"
    cli.main(["bench-proofread", f"{out}/book", f"{out}/clean", f"{out}/bench", "--lexicon", f"{out}/words.txt"])
    result = rows(spark, tmp_path / "bench")[0]
    assert (result["missed_flagged"], result["corrections"], result["fixed"]) == (1, 1, 0)
    capsys.readouterr()
    cli.main(["llm-check"])
    cli.main(["voices"])
    assert capsys.readouterr().out.splitlines() == ['[{"id": 0, "correction": "word"}]', '["tone"]']
