"""Stemmers from their published descriptions: Porter (1980), English Snowball (Porter2), Lancaster (Paice, 1990)."""

from __future__ import annotations

import re
from collections.abc import Callable

VOWELS = "aeiou"


def _is_consonant(word: str, i: int) -> bool:
    if word[i] in VOWELS:
        return False
    return word[i] != "y" or i == 0 or not _is_consonant(word, i - 1)


def _measure(stem: str) -> int:
    """The number of vowel-consonant sequences."""
    shape = "".join("c" if _is_consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall(r"v+c+", shape))


def _has_vowel(stem: str) -> bool:
    return any(not _is_consonant(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _is_consonant(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and _is_consonant(word, n - 3) and not _is_consonant(word, n - 2) and _is_consonant(word, n - 1) and word[-1] not in "wxy"


# Fixed values of the algorithm: suffixes and what replaces them.
_PORTER_2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous",
    ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_PORTER_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_PORTER_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    word = word.lower()
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            word = cut[:-1]
        else:
            word = cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_PORTER_2, _PORTER_3):
        if (suffix := _longest(word, table)) and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    if suffix := _longest(word, _PORTER_4):
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


# Fixed values of the algorithm.
_SNOWBALL_WHOLE = dict(
    skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli",
    singly="singl", sky="sky", news="news", howe="howe", atlas="atlas", cosmos="cosmos", bias="bias", andes="andes",
)
_SNOWBALL_EARLY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_SNOWBALL_2 = dict(
    tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate",
    alism="al", aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble",
    ogi="og", fulli="ful", lessli="less", li="",
)
_SNOWBALL_3 = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
_SNOWBALL_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def snowball(word: str) -> str:
    word = word.lower().strip("'")
    if len(word) <= 2:
        return word
    if word in _SNOWBALL_WHOLE:
        return _SNOWBALL_WHOLE[word]
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    prefix = re.match(r"gener|commun|arsen", word)
    first = re.search(r"[aeiouy][^aeiouy]", word)
    r1 = prefix.end() if prefix else first.end() if first else len(word)
    second = re.search(r"[aeiouy][^aeiouy]", word[r1:])
    r2 = r1 + second.end() if second else len(word)

    def short_end(w: str) -> bool:
        return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))

    for tail in ("'s'", "'s", "'"):
        if word.endswith(tail):
            word = word[: -len(tail)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy].+$", word[:-1]):
        word = word[:-1]
    if word in _SNOWBALL_EARLY:
        return word
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    elif suffix and re.search(r"[aeiouy]", word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    if (suffix := _longest(word, _SNOWBALL_2)) and len(word) - len(suffix) >= r1:
        stem = word[: -len(suffix)]
        if not (suffix == "ogi" and not stem.endswith("l") or suffix == "li" and stem[-1:] not in tuple("cdeghkmnrt")):
            word = stem + _SNOWBALL_2[suffix]
    if (suffix := _longest(word, _SNOWBALL_3)) and len(word) - len(suffix) >= (r2 if suffix == "ative" else r1):
        word = word[: -len(suffix)] + _SNOWBALL_3[suffix]
    if (suffix := _longest(word, _SNOWBALL_4)) and len(word) - len(suffix) >= r2:
        stem = word[: -len(suffix)]
        if suffix != "ion" or stem.endswith(("s", "t")):
            word = stem
    if word.endswith("e") and (len(word) > r2 or (len(word) > r1 and not short_end(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.lower()


# Fixed values of the algorithm: ending, * if only for intact words, letters removed, letters added, and whether it goes on.
_LANCASTER = """
ia* 2 . stop;a* 1 . stop;bb 1 . stop;ytic 3 s stop;ic 2 . on;nc 1 t on;dd 1 . stop;ied 3 y on;ceed 2 ss stop;eed 1 . stop;ed 2 . on;
hood 4 . on;e 1 . on;lief 1 v stop;if 2 . on;ing 3 . on;iag 3 y stop;ag 2 . on;gg 1 . stop;th* 2 . stop;guish 5 ct stop;ish 3 . on;
i* 1 . stop;i 1 y on;ij 1 d stop;fuj 1 s stop;uj 1 d stop;oj 1 d stop;hej 1 r stop;verj 1 t stop;misj 2 t stop;nj 1 d stop;j 1 s stop;
ifiabl 6 . stop;iabl 4 y stop;abl 3 . on;ibl 3 . on;bil 2 l on;cl 1 . stop;iful 4 y stop;ful 3 . on;ul 2 . stop;ial 3 . on;ual 3 . on;
al 2 . on;ll 1 . stop;ium 3 . stop;um* 2 . stop;ism 3 . on;mm 1 . stop;sion 4 j on;xion 4 ct stop;ion 3 . on;ian 3 . on;een 0 . stop;
an 2 . on;en 2 . on;nn 1 . stop;p 1 . on;pp 1 . stop;ier 3 y on;er 2 . on;ear 0 . stop;ar 2 . stop;or 2 . on;ur 2 . on;rr 1 . stop;
tr 1 . on;ies 3 y on;sis 2 s stop;is 2 . on;ness 4 . on;ss 0 . stop;ous 3 . on;us* 2 . stop;s* 1 . on;s 0 . stop;plicat 4 y stop;
at 2 . on;ment 4 . on;ent 3 . on;ant 3 . on;ript 2 b stop;orpt 2 b stop;duct 1 . stop;sumpt 3 . stop;cept 2 iv stop;olut 2 v stop;
sist 0 . stop;ist 3 . on;tt 1 . stop;iqu 3 . stop;ogu 1 . stop;siv 3 j on;eiv 0 . stop;iv 2 . on;bly 1 . on;ily 3 y on;ply 0 . stop;
ly 2 . on;ogy 1 . stop;phy 1 . stop;omy 1 . stop;opy 1 . stop;ity 3 . on;ety 3 . on;lty 2 . stop;istry 5 . stop;ary 3 . on;ory 3 . on;
ify 3 . stop;ncy 2 t on;acy 3 . on;iz 2 . on;yz 1 s stop
"""
_LANCASTER_RULES = [rule.split() for rule in _LANCASTER.replace("\n", "").split(";") if rule.strip()]


def lancaster(word: str) -> str:
    word, intact = word.lower(), True
    while True:
        for ending, cut, add, then in _LANCASTER_RULES:
            if not word.endswith(ending.rstrip("*")) or (ending.endswith("*") and not intact):
                continue
            stem = word[: len(word) - int(cut)]
            # a stem keeps a vowel: two letters after a first vowel, else three letters with a vowel
            if not (len(stem) >= 2 if stem[:1] in tuple(VOWELS) else len(stem) >= 3 and any(c in "aeiouy" for c in stem)):
                continue
            word, intact = stem + ("" if add == "." else add), False
            if then == "stop":
                return word
            break
        else:
            return word


STEMMERS: dict[str, Callable[[str], str]] = {"porter": porter, "snowball": snowball, "lancaster": lancaster}
