"""The English stemmer of the Snowball project (Porter2), from its published description, and stop-word removal."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words in common use.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain
aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

#: Contractions written as one word that tokenizers take apart.
MERGED = {"cannot": ("can", "not"), "gonna": ("gon", "na"), "gotta": ("got", "ta"), "gimme": ("gim", "me"), "lemme": ("lem", "me"), "wanna": ("wan", "na")}

#: Fixed values of the algorithm: irregular words, words that stop after step 1a, and the suffixes of steps 2 to 4.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
DOUBLES, LI_BEFORE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"

_VOWEL = "[aeiouy]"
_REGION = re.compile(f"{_VOWEL}[^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _regions(w: str) -> tuple[int, int]:
    for head in ("gener", "commun", "arsen"):
        if w.startswith(head):
            r1 = len(head)
            break
    else:
        m = _REGION.search(w)
        r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if len(word) <= 2:
        return word
    w = word.lstrip("'") if word.startswith("'") else word
    if w in IRREGULAR:
        return IRREGULAR[w]
    if w in INVARIANT:
        return w
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)

    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break

    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()

    # step 1b
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if end in ("eedly", "eed"):
                if len(base) >= r1:
                    w = base + "ee"
            elif re.search(_VOWEL, base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif len(w) <= r1 and _SHORT_END.search(w):
                    w += "e"
            break

    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    # step 2
    for end, put in STEP2:
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= r1 and (end != "ogi" or base.endswith("l")) and (end != "li" or base[-1:] in tuple(LI_BEFORE)):
                w = base + put
            break

    # step 3
    for end, put in STEP3:
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= r1 and (end != "ative" or len(base) >= r2):
                w = base + put
            break

    # step 4
    for end in STEP4:
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= r2 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break

    # step 5
    if w.endswith("e"):
        base = w[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _SHORT_END.search(base)):
            w = base
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


class _Stems(dict):
    """What stands for each word that was met: its stem, or None for a stop word. Forgets all beyond MET words."""

    MET = 200_000

    def __init__(self, stop: frozenset[str]):
        self.stop = stop

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.MET:
            self.clear()
        parts = [stem(w) for w in MERGED.get(word, (word,)) if w not in self.stop]
        self[word] = found = " ".join(parts) if parts else None
        return found


_STEMS: dict[frozenset[str], _Stems] = {}


def stem_text(text: str | None, stop: frozenset[str] = frozenset(STOP_WORDS)) -> str | None:
    """Stems of the words that are no stop words, joined by a space; null stays null. A process stems a word once."""
    if text is None:
        return None
    known = _STEMS.get(stop) or _STEMS.setdefault(stop, _Stems(stop))
    return " ".join([s for s in map(known.__getitem__, text.split()) if s is not None])


def stemmed(c: Column) -> Column:
    """stem_text on Arrow batches: the one step that Spark has no expression for."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(stem_text, na_action="ignore")

    return F.pandas_udf(run, "string")(c)
