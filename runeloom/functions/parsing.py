"""Sentences as annotated tokens: the schema of the parse stage, and a small parser by rule.

Any parser may fill the schema (universal parts of speech, Penn tags, ClearNLP dependencies). The one here knows closed
classes, the lexicon's lemmas and endings, and attaches by position. It is a fallback, far from a trained model.
"""

from __future__ import annotations

import re
from collections.abc import Container, Mapping
from dataclasses import dataclass, replace

TOKEN_SCHEMA = "array<struct<i:int,text:string,lemma:string,pos:string,tag:string,dep:string,head:int,is_punct:boolean,is_space:boolean,sent_start:boolean,like_num:boolean>>"


@dataclass(frozen=True)
class Token:
    i: int
    text: str
    lemma: str
    pos: str
    tag: str = ""
    dep: str = "dep"
    head: int = -1
    is_punct: bool = False
    is_space: bool = False
    sent_start: bool = False
    like_num: bool = False

    @property
    def low(self) -> str:
        return self.text.lower()


# Closed classes, each word with its tag (the class is the part of speech).
CLOSED = {
    "DET": {"DT": "the a an this that these those every each some any no all both either neither another", "WDT": "which"},
    "PRON": {"PRP": "i me you he him she it we us they them myself yourself himself herself itself ourselves yourselves themselves", "PRP$": "my your his her its our their", "WP": "who whom what", "WP$": "whose", "NN": "nobody somebody everybody anybody nothing something everything anything someone everyone anyone"},
    "ADP": {"IN": "of in on at by for with from into over under after before behind near through between against around across along above below inside outside without within upon beside during until"},
    "CCONJ": {"CC": "and but or nor yet"},
    "SCONJ": {"IN": "because while when if although though since as unless once", "WRB": "where why how"},
    "PART": {"TO": "to", "RB": "not n't n’t"},
    "ADV": {"RB": "there here then now never always often very too so again still not together"},
    "NUM": {"CD": "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand"},
    "INTJ": {"UH": "yes oh hello hi please okay"},
}
AUXILIARIES = {
    "be": "be:VB am:VBP is:VBZ are:VBP was:VBD were:VBD been:VBN being:VBG 'm:VBP 're:VBP", "have": "have:VBP has:VBZ had:VBD having:VBG 've:VBP",
    "do": "do:VBP does:VBZ did:VBD done:VBN", "can": "can:MD ca:MD", "could": "could:MD", "will": "will:MD wo:MD 'll:MD", "would": "would:MD 'd:MD", "may": "may:MD",
    "might": "might:MD", "must": "must:MD", "shall": "shall:MD sha:MD", "should": "should:MD",
}
IRREGULAR = (
    "awoke:awake beat:beat became:become began:begin bent:bend bit:bite blew:blow broke:break brought:bring built:build burned:burn bought:buy caught:catch chose:choose came:come cut:cut dealt:deal "
    "dug:dig drew:draw drank:drink drove:drive ate:eat fell:fall fed:feed felt:feel fought:fight found:find flew:fly forgot:forget froze:freeze gave:give went:go grew:grow hung:hang heard:hear hid:hide "
    "hit:hit held:hold kept:keep knew:know laid:lay led:lead left:leave lent:lend let:let lay:lie lit:light lost:lose made:make met:meet paid:pay put:put read:read rode:ride rang:ring rose:rise ran:run "
    "said:say saw:see sold:sell sent:send shook:shake shone:shine shot:shoot shut:shut sang:sing sank:sink sat:sit slept:sleep spoke:speak spent:spend stood:stand stole:steal stuck:stick swam:swim "
    "swung:swing took:take taught:teach tore:tear told:tell thought:think threw:throw woke:wake wore:wear won:win wrote:write strove:strive dreamed:dream tied:tie"
)

_CLOSED = {w: (pos, tag) for pos, tags in reversed(CLOSED.items()) for tag, ws in tags.items() for w in ws.split()}
_AUX = {f.split(":")[0]: (lemma, f.split(":")[1]) for lemma, fs in AUXILIARIES.items() for f in fs.split()}
_PAST = dict(x.split(":") for x in IRREGULAR.split())
_PIECES = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:-[^\W\d_]+)*|['’](?:s|re|ve|ll|d|m|t)\b|\.{3}|\s+|[^\w\s]|_+|\w", re.I)
_SPLIT = re.compile(r"(?i)^(.+)(n['’]t)$")
OPEN_POS = ("NOUN", "VERB", "ADJ", "ADV", "INTJ")


def tokenize(text: str) -> list[str]:
    out: list[str] = []
    text = re.sub(r"(?i)\b(\w+?)(n)['’]t\b", "\\1 \\2\u0001t", text)
    for m in _PIECES.finditer(text):
        t = m.group()
        if t == "\u0001" or (out and out[-1].endswith("\u0001")):
            out[-1] += t
        elif "-" in t and all(p in CLOSED["NUM"]["CD"].split() for p in t.lower().split("-")):
            out += re.split("(-)", t)
        elif not t.isspace():
            out.append(t)
    return [re.sub("\u0001", "'", t) for t in out]


def lemma_candidates(word: str) -> list[tuple[str, str]]:
    """(lemma, tag) that a lower-case word may be, likeliest first; tag tells the ending."""
    out = [(word, "")]
    if word in _PAST:
        out.insert(0, (_PAST[word], "VBD"))
    for end, new, tag in (("ies", "y", "S"), ("es", "", "S"), ("s", "", "S"), ("ied", "y", "VBD"), ("ed", "", "VBD"), ("ed", "e", "VBD"), ("ing", "", "VBG"), ("ing", "e", "VBG"), ("ier", "y", "JJR"), ("er", "", "JJR"), ("er", "e", "JJR"), ("iest", "y", "JJS"), ("est", "", "JJS")):
        if word.endswith(end) and len(word) > len(end) + 2:
            stem = word[: -len(end)]
            out.append((stem + new, tag))
            if not new and stem[-1] == stem[-2] and tag != "S":
                out.append((stem[:-1], tag))
    return out


def _guess(word: str, before: str, senses: Mapping[str, Container[str]], verb_due: bool) -> tuple[str, str, str]:
    """(lemma, pos, tag) of an open-class word: the lexicon's readings, told apart by the word before."""
    nominal = before in ("DET", "ADJ", "NUM", "PRP$", "ADP")
    order = ("NOUN", "ADJ", "VERB", "ADV", "INTJ") if nominal and before == "ADJ" else ("ADJ", "NOUN", "VERB", "ADV", "INTJ") if nominal else ("VERB", "ADV", "ADJ", "NOUN", "INTJ") if verb_due else ("NOUN", "ADJ", "ADV", "VERB", "INTJ")
    readings = []
    for k, (lemma, ending) in enumerate(lemma_candidates(word)):
        for pos in senses.get(lemma, ()):
            if ending in ("VBD", "VBG") and pos != "VERB" or ending in ("JJR", "JJS") and pos not in ("ADJ", "ADV") or ending == "S" and pos not in ("NOUN", "VERB"):
                continue
            readings.append((order.index(pos), k, lemma, pos, ending))
    if readings:
        _, _, lemma, pos, ending = min(readings)
    elif word.endswith("ly") and len(word) > 4:
        lemma, pos, ending = word, "ADV", ""
    elif word in _PAST or (word.endswith("ed") and not nominal):
        lemma, ending = next((c for c in lemma_candidates(word) if c[1] == "VBD"), (word, "VBD"))
        pos = "VERB"
    elif nominal and before != "ADJ" and word.endswith(("ed", "y", "ful", "ous", "less")):
        lemma, pos, ending = word, "ADJ", ""
    elif verb_due and before in ("PRON", "PART", "AUX"):
        lemma, pos, ending = word, "VERB", ""
    else:
        plural = word.endswith("s") and not word.endswith(("ss", "us"))
        lemma, pos, ending = (word[:-1] if plural else word), "NOUN", "S" if plural else ""
    tags = {"NOUN": "NNS" if ending == "S" else "NN", "VERB": {"S": "VBZ", "VBD": "VBD", "VBG": "VBG"}.get(ending, "VBP"), "ADJ": ending if ending in ("JJR", "JJS") else "JJ", "ADV": {"JJR": "RBR", "JJS": "RBS"}.get(ending, "RB"), "INTJ": "UH"}
    return lemma, pos, tags[pos]


def tag(words: list[str], senses: Mapping[str, Container[str]]) -> list[Token]:
    """Tokens of one sentence with lemma and part of speech, not yet attached. ``senses``: lemma -> its parts of speech."""
    out: list[Token] = []
    for i, w in enumerate(words):
        low = w.lower().replace("’", "'")
        before = out[-1] if out else None
        kind = "PRP$" if before and before.tag == "PRP$" else before.pos if before else ""
        verb_due = not any(t.pos == "VERB" for t in out) and any(t.pos in ("NOUN", "PROPN", "PRON") for t in out)
        base = {"i": i, "text": w, "sent_start": i == 0}
        if not re.match(r"\w", w) and low not in _AUX and low not in ("'s", "'t"):
            opening = w in ("“", "`") or (w == '"' and sum(t.text == '"' for t in out) % 2 == 0)
            out.append(Token(**base, lemma=w, pos="PUNCT", tag="``" if opening else "''" if w in ('"', "”") else "HYPH" if w == "-" else w, is_punct=True))
        elif re.match(r"\d", w):
            out.append(Token(**base, lemma=w, pos="NUM", tag="CD", like_num=True))
        elif low == "'s":
            has_noun = before is not None and before.pos in ("NOUN", "PROPN")
            out.append(Token(**base, lemma="'s", pos="PART" if has_noun else "AUX", tag="POS" if has_noun else "VBZ") if has_noun else Token(**base, lemma="us" if before and before.low == "let" else "be", pos="PRON" if before and before.low == "let" else "AUX", tag="PRP" if before and before.low == "let" else "VBZ"))
        elif low in _AUX:
            out.append(Token(**base, lemma=_AUX[low][0], pos="AUX", tag=_AUX[low][1]))
        elif low in _CLOSED:
            pos, t = _CLOSED[low]
            if low == "to" and (after := words[i + 1] if i + 1 < len(words) else "") and (_CLOSED.get(after.lower(), ("",))[0] in ("DET", "NUM", "PRON") or not after.islower()):
                pos, t = "ADP", "IN"
            lemma = "not" if low == "n't" else low
            out.append(Token(**base, lemma=lemma, pos=pos, tag="PRP$" if low == "her" and i + 1 < len(words) and words[i + 1][:1].isalpha() and words[i + 1].lower() not in _CLOSED else t, like_num=pos == "NUM"))
        elif w[:1].isupper() and (i or not any(lem in senses for lem, _ in lemma_candidates(low))):
            out.append(Token(**base, lemma=w, pos="PROPN", tag="NNP"))
        else:
            lemma, pos, t = _guess(low, kind, senses, verb_due)
            out.append(Token(**base, lemma=lemma, pos=pos, tag=t))
    return out


def attach(tokens: list[Token]) -> list[Token]:
    """Heads and dependencies by position: noun chunks around their last noun, auxiliaries before their verb, subjects left and objects right of it, prepositions after what they follow."""
    n = len(tokens)
    head, dep = list(range(n)), ["dep"] * n
    nominal = lambda t: t.pos in ("NOUN", "PROPN", "PRON", "NUM") and t.tag != "PRP$"
    toks = list(tokens)
    verbs = [t.i for t in toks if t.pos == "VERB"]
    for t in toks:  # an auxiliary without a verb behind it is the predicate
        if t.pos == "AUX":
            ahead = next((u for u in toks[t.i + 1 :] if u.pos not in ("ADV", "PART", "PRON", "NOUN", "DET", "ADJ", "PROPN") or u.pos == "VERB"), None)
            if ahead is not None and (ahead.pos == "VERB" or (ahead.pos == "AUX" and t.lemma not in ("be",))):
                head[t.i], dep[t.i] = ahead.i, "auxpass" if t.lemma == "be" and ahead.tag in ("VBN", "VBD") else "aux"
    predicates = [t.i for t in toks if t.i in verbs or (t.pos == "AUX" and dep[t.i] == "dep")]
    root = predicates[0] if predicates else next((t.i for t in toks if nominal(t)), 0)
    heads: list[int] = []  # heads of noun chunks
    i = 0
    while i < n:
        j = i
        while j < n and (toks[j].pos in ("DET", "ADJ", "NUM", "NOUN", "PROPN") or toks[j].tag in ("PRP$", "POS")):
            if j > i and toks[j - 1].pos in ("NOUN", "PROPN") and (toks[j].pos in ("DET", "NUM") or toks[j].tag == "PRP$"):
                break  # a new phrase begins
            j += 1
        chunk = [k for k in range(i, j) if toks[k].pos in ("NOUN", "PROPN")]
        if chunk:
            h = chunk[-1]
            heads.append(h)
            for k in range(i, h):
                t = toks[k]
                own = next((q for q in range(k + 1, h + 1) if toks[q].pos in ("NOUN", "PROPN") and q + 1 < j and toks[q + 1].tag == "POS"), h)
                to = own if own != k else h
                head[k] = to
                dep[k] = "det" if t.pos == "DET" else "nummod" if t.pos == "NUM" else "amod" if t.pos == "ADJ" else "poss" if t.tag == "PRP$" or (k + 1 < n and toks[k + 1].tag == "POS") else "case" if t.tag == "POS" else "compound"
                if t.tag == "POS" and k:
                    head[k] = k - 1
            i = h + 1
            continue
        if toks[i].pos == "PRON" and toks[i].tag != "PRP$":
            heads.append(i)
        i += 1
    for h in heads:
        before = next((t for t in reversed(toks[:h]) if head[t.i] != h and not (t.pos in ("DET", "ADJ", "NUM"))), None)
        pred = max((p for p in predicates if p < h), default=None)
        nxt = min((p for p in predicates if p > h), default=None)
        if before is not None and before.pos in ("ADP", "SCONJ") and before.tag == "IN" and before.i not in predicates and dep[before.i] == "dep" and (nxt is None or before.pos == "ADP"):
            head[h], dep[h] = before.i, "pobj"
            dep[before.i] = "prep"
            head[before.i] = before.i - 1 if before.i and before.i - 1 in heads else pred if pred is not None else root
        elif before is not None and before.pos == "CCONJ" and (nxt is None or pred is None) and any(x < before.i for x in heads):
            head[h], dep[h] = max(x for x in heads if x < before.i), "conj"
        elif nxt is not None and (pred is None or any(t.pos in ("CCONJ", "SCONJ") or t.is_punct or t.low == "that" for t in toks[pred:h])):
            head[h], dep[h] = nxt, "nsubj"
        elif pred is not None:
            head[h], dep[h] = pred, "attr" if toks[pred].lemma == "be" else "dobj"
        else:
            head[h], dep[h] = root, "dep"
    last = root
    for p in predicates:
        if p != root:
            marks = [t for t in toks[last:p] if t.pos == "SCONJ" or t.low == "that"]
            head[p] = root
            dep[p] = "advcl" if marks and marks[0].pos == "SCONJ" else "ccomp" if marks else "conj"
            last = p
    for t in toks:
        if t.i == root:
            head[t.i], dep[t.i] = t.i, "ROOT"
        elif dep[t.i] == "dep":
            nxt = min((p for p in predicates if p > t.i), default=None)
            pred = max((p for p in predicates if p < t.i), default=root)
            if t.is_punct:
                head[t.i], dep[t.i] = root, "punct"
            elif t.low in ("not", "n't"):
                near = min(predicates or [root], key=lambda p: (abs(p - t.i), -p))
                head[t.i], dep[t.i] = (nxt if nxt is not None and toks[nxt].pos == "VERB" and nxt - t.i < 3 else near), "neg"
            elif t.pos == "SCONJ" or (t.low == "that" and nxt is not None):
                head[t.i], dep[t.i] = (nxt if nxt is not None else pred), "mark"
            elif t.tag == "TO" and nxt is not None:
                head[t.i], dep[t.i] = nxt, "aux"
                toks[nxt] = replace(toks[nxt], tag="VB") if toks[nxt].tag == "VBP" else toks[nxt]
            elif t.pos == "ADJ" and pred < t.i and toks[pred].lemma == "be":
                head[t.i], dep[t.i] = pred, "acomp"
            elif t.pos == "ADV":
                right = toks[t.i + 1] if t.i + 1 < n else None
                head[t.i], dep[t.i] = (right.i if right is not None and right.pos in ("ADJ", "ADV") and head[right.i] != t.i else nxt if nxt == t.i + 1 else pred), "advmod"
            elif t.pos == "ADP":
                head[t.i], dep[t.i] = pred, "prep"
            elif t.pos == "CCONJ":
                head[t.i], dep[t.i] = pred, "cc"
            else:
                head[t.i] = pred
    return _tree([replace(t, head=head[t.i], dep=dep[t.i]) for t in toks], root)


def _tree(toks: list[Token], root: int) -> list[Token]:
    """Heads that would close a circle go to the root instead."""
    head = [t.head for t in toks]
    for i in range(len(toks)):
        seen, k = set(), i
        while k != root and k not in seen:
            seen.add(k)
            k = head[k]
        if k != root:
            head[i] = root
    return [replace(t, head=h) for t, h in zip(toks, head)]


_SENTENCE = re.compile(r".+?(?:[.!?…]+[\"'”’)\]]*(?=\s)|$)", re.S)


def parse(text: str, senses: Mapping[str, Container[str]]) -> list[list[Token]]:
    """The sentences of a paragraph as attached tokens."""
    return [attach(tag(words, senses)) for m in _SENTENCE.finditer(text.strip()) if (words := tokenize(m.group()))]
