"""Texts freed of markup, layout and odd spellings of characters, for comparison by words."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other alphabets that look like Latin ones.
LOOKALIKES = str.maketrans(
    "абвгԁеёһіїјкӏлмնоөрԛгѕсстѵуԝхуᴢαεικνορτυχАВСЕНІЈКМОРЅТХУԌΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "abbrdeehiijkllmnoopqrscctvywxyzaeikvoptuxABCEHIJKMOPSTXYGABEZHIKMNOPTYX",
)
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--.*?-->", re.S)
_ESCAPED = re.compile(r"\\+([nrt])(?![a-z])")
_BACKSLASH = re.compile(r"\\(?=[^\w\s])|\\+(?=[_*])")
_LATIN_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[\u0300-\u036f]")


def _latin(match: re.Match) -> str:
    """A word that mixes alphabets, or is spelled wholly in lookalikes next to Latin text, in Latin letters."""
    return match[0].translate(LOOKALIKES)


def plain(text: str) -> str:
    """Lower-case text without tags, entities, invisible characters, escapes, accents and lookalike letters."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _BACKSLASH.sub("", _ESCAPED.sub(" ", text))
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        if not text.isascii():
            text = _LATIN_WORD.sub(_latin, text)
    return text.lower()
