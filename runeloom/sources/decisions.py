"""Small files of decisions and word lists: phrases, corrections of the parser, seeds of reviews, frequencies, words to avoid."""

from __future__ import annotations

from pathlib import Path

from runeloom.operators.review import Seeds


def _yaml(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return found


def _sense(text: str) -> tuple[str, str]:
    lemma, slash, pos = text.rpartition("/")
    if not (lemma and slash and pos):
        raise ValueError(f"{text!r} is no sense (lemma/POS)")
    return lemma, pos


def read_phrases(path: str) -> dict[str, str]:
    """English words -> target, of the key ``phrases``; slots {lemma/POS+TAG} are filled when a language is made."""
    return {str(k): str(v) for k, v in (_yaml(path).get("phrases") or {}).items()}


def read_corrections(path: str) -> tuple[dict[tuple[str, str], tuple[str, str]], list[tuple[str, str]], list[tuple[str, str]]]:
    """(alias, skip, function) of the keys of these names: senses that the parser gets wrong and what they are, senses that aren't counted, senses that are function words."""
    x = _yaml(path)
    alias = {_sense(a): _sense(b) for a, b in (x.get("alias") or {}).items()}
    return alias, [_sense(s) for s in x.get("skip") or []], [_sense(s) for s in x.get("function") or []]


def read_seeds(path: str) -> Seeds:
    """Seeds of a review: ``senses``, ``extra`` and ``homonyms``. A sense's value is one of {kz, origin, from}, {base} and {same}."""
    x = _yaml(path)
    senses = {str(k): dict(v) for k, v in (x.get("senses") or {}).items()}
    for s, v in senses.items():
        _sense(s)
        if len(v.keys() & {"kz", "base", "same"}) != 1:
            raise ValueError(f"{s}: one of kz, base and same is expected")
    return Seeds(senses, [str(s) for s in x.get("extra") or []], [str(s) for s in x.get("homonyms") or []])


def read_frequencies(path: str) -> dict[str, float]:
    """word -> zipf, of lines "word<tab or comma>zipf"; a heading and lines without a number are passed over. A list of some hundred thousand words at most."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        word, _, zipf = line.replace("\t", ",").rpartition(",")
        try:
            out[word.split(",")[0].strip().lower()] = float(zipf)
        except ValueError:
            continue
    return out


def read_words(path: str) -> frozenset[str]:
    """One word a line, in lower case; what follows # is a remark."""
    words = (line.split("#")[0].strip().lower() for line in Path(path).read_text(encoding="utf-8").splitlines())
    return frozenset(w for w in words if w)
