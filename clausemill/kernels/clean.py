"""Conservative cleaning of extracted text: each step is a function of its own, `clean` is their chain."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from .words import KEPT_PREFIXES, LINE_ABBREVIATIONS

# A word broken at a line's end; page lines, bare numbers, enumeration labels; quotes.
_BROKEN = re.compile(r"(\w+)-\n(\w)")
_PAGE = re.compile(r"(?im)^\s*page\s+\d+(\s+of\s+\d+)?\s*$")
_NUMBER = re.compile(r"(?m)^\s*\d+\s*$")
_LABEL = re.compile(r"(?m)^\s*(?:\d+(?:\.\d+)*|[a-z]|[ivx]+)[.)]\s+")
_GOES_ON = re.compile(r"\b(?:" + "|".join(LINE_ABBREVIATIONS) + r")\.$")
_QUOTES = str.maketrans({" ": " ", "‘": "'", "’": "'", "“": '"', "”": '"'})
# A line is a running header if it is shorter than this and occurs this often.
HEADER_CHARS, HEADER_TIMES = 60, 3


def normalise(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(_QUOTES)


def dehyphenate(text: str) -> str:
    """One pass from left to right: a chained break is consumed pairwise."""
    return _BROKEN.sub(lambda m: m[1] + ("-" if m[1].lower() in KEPT_PREFIXES else "") + m[2], text)


def drop_layout(text: str) -> str:
    """Without page lines, bare numbers and enumeration labels (a label in parentheses stays)."""
    for pattern in (_PAGE, _NUMBER, _LABEL):
        text = pattern.sub("", text)
    return text


def drop_headers(lines: list[str]) -> list[str]:
    often = Counter(x for x in lines if x and len(x) < HEADER_CHARS)
    return [x for x in lines if often.get(x, 0) < HEADER_TIMES]


def typical_width(lines: list[str]) -> int:
    """The line length at nine tenths of the lines above 20 characters, 0 without any."""
    lengths = sorted(len(x) for x in lines if len(x) > 20)
    return lengths[int(0.9 * (len(lengths) - 1))] if lengths else 0


def continues(before: str, line: str, width: int) -> bool:
    """Whether a physical line belongs to the paragraph of the physical line before it."""
    if not before or not line or (before[-1] in ".:;!?" and not _GOES_ON.search(before)):
        return False
    return line[0].islower() or len(before) >= 0.8 * width


def rejoin(lines: list[str]) -> list[str]:
    width, paragraphs, before = typical_width(lines), [], ""
    for line in lines:
        if paragraphs and continues(before, line, width):
            paragraphs[-1] += " " + line
        else:
            paragraphs.append(line)
        before = line
    return paragraphs


def clean(text: str | None) -> str:
    lines = drop_layout(dehyphenate(normalise(text or ""))).split("\n")
    joined = "\n".join(rejoin(drop_headers([x.strip() for x in lines])))
    return re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]+", " ", joined)).strip()


# A duration said twice.
_DURATION_TWICE = re.compile(r"(?i)\b(\d+)\s*\(\s*[a-z\- ]+\s*\)\s*(days?|weeks?|months?|years?)")


def normalise_numbers(text: str) -> str:
    """`6 (six) months` → `6 months`."""
    return _DURATION_TWICE.sub(r"\1 \2", text)
