"""Every command once, on small files."""

import pytest

from runeloom.cli import main
from runeloom.plans.reports import sound_report
from tests.compare import SF

TABLES = ["--lexicon", f"{SF}/lexicon.parquet", "--functions", f"{SF}/function_words.parquet"]


@pytest.fixture
def run(spark, capsys):
    def go(*args):
        code = main([*TABLES, *map(str, args)])
        return code, capsys.readouterr().out

    return go


def test_texts(run):
    assert run("translate", "The", "stone", "hall.")[1].strip().endswith(".")
    assert run("gloss", "Sman thald.")[1].split() == ["Sman", "thald", "the", "stone"]
    assert run("validate", "Sman thald.")[0] == 0
    assert run("validate", "the blueberry")[0] == 1


def test_lexicon(run, tmp_path):
    assert len(run("lexicon", "fingerprint")[1].strip()) == 12
    assert "error" in run("lexicon", "check")[1]


def test_words(run):
    assert len(run("wordgen", "--n", 3, "--syllables", 2)[1].split()) == 6
    assert "thald" in run("wordgen", "--score", "thald")[1]


def test_corpus(run, tmp_path):
    (tmp_path / "in.txt").write_text("\n<|endoftext|>\n".join(f"The stone hall of the mountain was old, and {w} carved the axe. " * 3 for w in ("Lily", "Tom", "Anna")))
    assert run("corpus", "translate", tmp_path / "in.txt", "--out", tmp_path / "o", "--shard-size", 2)[0] == 0
    assert "'stories': 3" in run("corpus", "report", tmp_path / "o")[1]
    assert run("corpus", "pack", tmp_path / "o", "--out", tmp_path / "p", "--max-loan-rate", 0.9)[0] == 0
    assert run("coverage", tmp_path / "in.txt", "--out", tmp_path / "c")[0] == 0
    assert "## Entries needed" in (tmp_path / "c" / "coverage_stories.md").read_text()
    lemmas = tmp_path / "c" / "stories_lemmas"
    assert "without entries" in run("lexicon", "status", "--worklist", lemmas)[1]
    assert run("merge", lemmas, lemmas, "--out", tmp_path / "m")[0] == 0
    assert run("review", "propose", lemmas, "--n", 3, "--out", tmp_path / "r")[0] == 0
    run("review", "apply", tmp_path / "r", "--dry-run")


def test_sound_report(spark, tmp_path):
    words = spark.createDataFrame([("a", "gromdal"), ("b", "skreka")], "source string, word string")
    assert "## Medial clusters" in sound_report(f"{tmp_path}/s.md", words, ["a", "b"]).read_text()
