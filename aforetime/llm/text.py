"""Words of texts however they are wrapped, quoted, escaped or marked up."""

from __future__ import annotations

import html
import re
import unicodedata

_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\+([nrtfb\"'/])|\\+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]|\x1b\\[[0-9;]*m")
_WORD = re.compile(r"[^\W_]+")
# Keys of the notebook file format around the text of cells and outputs.
_FORMAT_KEYS = (
    "cell_type", "collapsed", "execution_count", "id", "input", "language", "metadata", "name", "output_type", "outputs",
    "prompt_number", "source", "stream", "text",
)
_FORMAT = re.compile(
    r"\"(?:" + "|".join(_FORMAT_KEYS) + r")\"\s*:\s*(?:\"(?:code|markdown|raw|heading|python|stream|stdout|stderr|[0-9a-f-]{6,36})\"(?=\s*[,}])|-?[0-9]+|null|true|false|\{\s*\})?"
)
_NOTEBOOK = re.compile(r"\s*\{[^{}]*\"(?:cells|worksheets|metadata|nbformat|nbformat_minor)\"")
_CODE_LINE = re.compile(
    r"\w[(\[]|[^=<>!]=[^=]|[=<>!]=|[{};\])]\s*$|^\s*(?:def|class|return|import|from|if|elif|else|for|while|try|except|with|pass|raise)\b[^.!?]*:?\s*$"
)


def between_cells(text: str) -> str:
    """A notebook file's text without the keys and fixed words of the file format; other texts as they are."""
    return _FORMAT.sub(" ", text) if _NOTEBOOK.match(text) else text


def is_code(text: str) -> bool:
    """Whether a text has several lines and most of them look like code."""
    lines = [line for line in text.split("\n") if line.strip()]
    return len(lines) > 1 and 2 * sum(bool(_CODE_LINE.search(line)) for line in lines) > len(lines)


def _unescape(match: re.Match) -> str:
    if match[1]:
        return chr(int(match[1], 16))
    return "\n" if match[2] in ("n", "r") else " " if match[2] in ("t", "f", "b") else match[2] or ""


def plain(text: str) -> str:
    """The text with escapes, entities and tags resolved, in compatibility form.

    Surrogate pairs written as two escapes are joined; lone ones become blanks.
    """
    if "\\" in text:
        text = _ESCAPED.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    elif "\x1b" in text:
        text = _INVISIBLE.sub("", text)
    return text


def words(text: str) -> list[str]:
    """Words of a plain text in lower case; underscores and punctuation part words."""
    return _WORD.findall(text.lower())
