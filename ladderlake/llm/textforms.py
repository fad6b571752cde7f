"""Plain words of a text, whatever its markup, quoting and character forms."""

from __future__ import annotations

import html
import re
import unicodedata

_INLINE = re.compile(r"</?(?:a|abbr|b|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>")
_HIDDEN = re.compile("[­͏؜ᅟᅠ᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_OTHER = re.compile(r"[^\w\x00-\x7f]+")
#: Bytes that are no ASCII letter or digit become blanks; bytes of other letters stay.
_BYTES = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words as UTF-8, without punctuation, markup, invisible characters and compatibility forms; null gives none."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.lower().encode().translate(_BYTES).split()
    text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).casefold()
    return _OTHER.sub(" ", text).encode("utf-8", "replace").translate(_BYTES).split()
