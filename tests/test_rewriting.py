"""Translation of annotated sentences, apart from any parser, and of plain text with the parser by rule."""

import pytest

from runeloom.functions.parsing import Token, parse, tokenize
from runeloom.functions.rewriting import Language, Sentence, Stats, Translator, number_words

CONTENT = [{"kz": k, "en": e.split()} for k, e in [
    ("gawi", "dwarf/NOUN"), ("drash", "forge/VERB"), ("krang", "strong/ADJ quick/ADJ"), ("az", "axe/NOUN"), ("dhal", "old/ADJ"), ("truk", "go/VERB walk/VERB"), ("karak", "hall/NOUN"), ("rik", "king/NOUN"),
    ("glunk", "help/VERB"), ("skom", "dark/ADJ"), ("kur", "stone/NOUN"), ("zak", "give/VERB"), ("thun", "say/VERB"), ("mek", "do/VERB"), ("lurk", "scare/VERB"), ("grol", "big/ADJ"), ("nul", "play/VERB"),
]]
FUNCTIONS = [{"kz": k, "en": e.split(","), "cat": c} for k, e, c in [
    ("ta", "the", "article"), ("un", "a,an", "article"), ("bin", "in,at", "preposition"), ("drur", "many,much", "quantifier"), ("a", "of", "preposition"), ("gez", "before", "preposition"), ("ai", "yes", "interjection"), ("hag", "have,want", "verb"),
]]
LANG = Language(CONTENT, FUNCTIONS, {"a lot of": "drur", "all of a sudden": "{quick/ADJ+ADV}", "once upon a time": "gez drur zengi"}, {("mum", "NOUN"): ("mom", "NOUN")})


def sentence(spec):
    """Tokens from lines "text lemma pos tag dep head"."""
    rows = [r.split() for r in spec.strip().split("\n")]
    return [Token(i, t, lem, pos, tag, dep, int(head), pos == "PUNCT", False, i == 0) for i, (t, lem, pos, tag, dep, head) in enumerate(rows)]


def rewrite(spec):
    stats = Stats()
    return Translator(LANG).sentences([sentence(spec)], stats), stats


CASES = {
    "adjectives follow": ("""The the DET DT det 2
old old ADJ JJ amod 2
dwarf dwarf NOUN NN nsubj 3
forged forge VERB VBD ROOT 3
a a DET DT det 6
strong strong ADJ JJ amod 6
axe axe NOUN NN dobj 3
. . PUNCT . punct 3""", "Ta gawi dhal drashad un az krang."),
    "negation and do": ("""The the DET DT det 1
dwarf dwarf NOUN NN nsubj 4
did do AUX VBD aux 4
n't not PART RB neg 4
go go VERB VB ROOT 4
. . PUNCT . punct 4""", "Ta gawi nai trukad."),
    "future": ("""I I PRON PRP nsubj 2
will will AUX MD aux 2
help help VERB VB ROOT 2
. . PUNCT . punct 2""", "Or an glunk."),
    "should": ("""We we PRON PRP nsubj 2
should should AUX MD aux 2
go go VERB VB ROOT 2
. . PUNCT . punct 2""", "Ut sar dret truk."),
    "going to": ("""He he PRON PRP nsubj 2
was be AUX VBD aux 2
going go VERB VBG ROOT 2
to to PART TO aux 4
help help VERB VB xcomp 2
. . PUNCT . punct 2""", "Ek sar glunk."),
    "passive": ("""The the DET DT det 1
axe axe NOUN NN nsubjpass 3
was be AUX VBD auxpass 3
forged forge VERB VBN ROOT 3
. . PUNCT . punct 3""", "Ta az zad drashad."),
    "progressive": ("""She she PRON PRP nsubj 2
is be AUX VBZ aux 2
walking walk VERB VBG ROOT 2
. . PUNCT . punct 2""", "Ek truken."),
    "could": ("""They they PRON PRP nsubj 2
could could AUX MD aux 2
walk walk VERB VB ROOT 2
. . PUNCT . punct 2""", "Um throkad truk."),
    "copula question": ("""Is be AUX VBZ ROOT 0
the the DET DT det 2
axe axe NOUN NN nsubj 0
strong strong ADJ JJ acomp 0
? ? PUNCT . punct 0""", "Wan ta az zu krang?"),
    "inverted subject": ("""Can can AUX MD aux 2
we we PRON PRP nsubj 2
play play VERB VB ROOT 2
? ? PUNCT . punct 2""", "Wan ut throk nul?"),
    "wh question": ("""Where where SCONJ WRB advmod 3
did do AUX VBD aux 3
he he PRON PRP nsubj 3
go go VERB VB ROOT 3
? ? PUNCT . punct 3""", "Woraz ek trukad?"),
    "dummy it": ("""It it PRON PRP nsubj 1
is be AUX VBZ ROOT 1
dark dark ADJ JJ acomp 1
. . PUNCT . punct 1""", "Zu skom."),
    "possessor": ("""Borin Borin PROPN NNP poss 2
's 's PART POS case 0
axe axe NOUN NN nsubj 3
is be AUX VBZ ROOT 3
strong strong ADJ JJ acomp 3
. . PUNCT . punct 3""", "Ta az a Borin zu krang."),
    "compound": ("""A a DET DT det 2
stone stone NOUN NN compound 2
hall hall NOUN NN ROOT 2
. . PUNCT . punct 2""", "Un karak a kur."),
    "comparative": ("""more more ADV RBR advmod 1
strong strong ADJ JJ ROOT 1""", "krangar"),
    "indirect object": ("""He he PRON PRP nsubj 1
gave give VERB VBD ROOT 1
me I PRON PRP dative 1
the the DET DT det 4
axe axe NOUN NN dobj 1
. . PUNCT . punct 1""", "Ek zakad ta az dra or."),
    "clause link": ("""He he PRON PRP nsubj 1
said say VERB VBD ROOT 1
the the DET DT det 3
king king NOUN NN nsubj 4
walked walk VERB VBD ccomp 1
. . PUNCT . punct 1""", "Ek thunad zo ta rik trukad."),
    "let us": ("""Let let VERB VB ROOT 0
's 's PRON PRP nsubj 2
go go VERB VB ccomp 0
. . PUNCT . punct 0""", "Ut truk."),
    "let me": ("""Let let VERB VB ROOT 0
me I PRON PRP nsubj 2
help help VERB VB ccomp 0
. . PUNCT . punct 0""", "Or an glunk."),
    "short answer": ("""Yes yes INTJ UH intj 3
, , PUNCT , punct 3
I I PRON PRP nsubj 3
can can AUX MD ROOT 3
. . PUNCT . punct 3""", "Ai, or throk."),
    "formal you": ("""You you PRON PRP nsubj 1
walk walk VERB VBP ROOT 1
, , PUNCT , punct 1
king king NOUN NN npadvmod 1
. . PUNCT . punct 1""", "Uzar truk, rik."),
    "formal self": ("""King King PROPN NNP ROOT 0
, , PUNCT , punct 0
please please INTJ UH intj 3
help help VERB VB conj 0
yourself yourself PRON PRP dobj 3
. . PUNCT . punct 0""", "Rik, uzar glunk uzara keb."),
    "relative clause": ("""the the DET DT det 1
dwarf dwarf NOUN NN ROOT 1
I I PRON PRP nsubj 3
helped help VERB VBD relcl 1""", "ta gawi zo or glunkad"),
    "adverb and participle": ("""The the DET DT det 2
scared scared ADJ JJ amod 2
dwarf dwarf NOUN NN nsubj 3
walked walk VERB VBD ROOT 3
strongly strongly ADV RB advmod 3
. . PUNCT . punct 3""", "Ta gawi lurkad trukad krangul."),
    "quantifier stays": ("""many many ADJ JJ amod 1
dwarves dwarf NOUN NNS ROOT 1""", "drur gawin"),
    "loan and name": ("""Lily Lily PROPN NNP nsubj 1
walked walk VERB VBD ROOT 1
bananas banana NOUN NNS dobj 1
. . PUNCT . punct 1""", "Lily trukad bananuzi."),
}


@pytest.mark.parametrize("name", CASES)
def test_annotated(name):
    spec, want = CASES[name]
    assert rewrite(spec)[0] == want


def test_stats():
    _, s = rewrite(CASES["loan and name"][0])
    assert (s.tokens, s.loans, s.names, s.unknown, dict(s.loan_words)) == (3, 1, 1, 0, {"bananuzi": 1})


def test_numbers():
    assert number_words("twelve") == ["zer", "tuf"] and number_words("sixty") == ["sib-zer"] and number_words("nineteen") == ["zer", "nund"] and number_words("dwarf") is None
    spec = "Three three NUM CD nummod 1\nhundred hundred NUM CD nummod 2\ndwarves dwarf NOUN NNS ROOT 2"
    assert rewrite(spec)[0] == "Thra-kunk gawin"
    assert rewrite("twenty twenty NUM CD nummod 2\n- - PUNCT HYPH punct 2\nthree three NUM CD ROOT 2")[0] == "tuf-zer thra"


def test_phrases():
    s = Sentence(LANG, sentence("A a DET DT det 3\nlot lot NOUN NN det 3\nof of ADP IN prep 3\ndwarves dwarf NOUN NNS ROOT 3"), set())
    assert s.match_phrases() == {0, 1, 2}
    assert Translator(LANG).translate("Once upon a time")[0] == "Gez drur zengi"


def test_plain_text():
    t = Translator(LANG)
    assert t.translate("The old dwarf forged an axe.\n\nThou art old.")[0] == "Ta gawi dhal drashad un az.\n\nUz zu dhal."
    assert t.translate('"Can we play?" said the king.')[0].startswith('"Wan ut throk nul?"')
    for odd in ("", " ", "\n", "...", "?!", "—", "a" * 5000, "x " * 3000, '"', "123", "'s", "n't", "日本語 text"):
        out, stats = t.translate(odd)
        assert isinstance(out, str) and stats.tokens >= 0


def test_trees_have_no_circles():
    for text in ("He walked and the dwarf, who was old, forged axes in the hall.", "Not!", "To the big old stone hall of the king's dwarf they went.", "If it was dark while we played, they said that it could be an axe."):
        for s in parse(text, LANG.by_lemma):
            roots = [t for t in s if t.head == t.i]
            assert len(roots) == 1
            for t in s:
                seen = 0
                while t.head != t.i:
                    t, seen = s[t.head], seen + 1
                    assert seen <= len(s)


def test_tokens():
    assert tokenize("He didn't see the king's iron-axe, twenty-three times...") == ["He", "did", "n't", "see", "the", "king", "'s", "iron-axe", ",", "twenty", "-", "three", "times", "..."]
