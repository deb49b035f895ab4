"""Visible lines of an HTML body, as text scans without building a tree."""

from __future__ import annotations

import re
from html import unescape

#: Elements whose start and end end a line (fixed values).
BLOCK_TAGS = (
    "address article aside blockquote body br button dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section select table tbody td th thead tr ul"
).split()

_ATTRS = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<head(?=[\s/>])[^>]*>", re.S | re.I)
_HEAD_END = re.compile(r"</head\s*>|(?=<body[\s>])", re.I)
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS, key=len, reverse=True))})(?=[\s/>]){_ATTRS}>", re.I)
_OTHER = re.compile(rf"</?[a-zA-Z]{_ATTRS}>|<[!?][^>]*>")
_BREAK = "\x00"


def without_hidden(body: str) -> str:
    """The body without head, script, style and comments."""
    out, at = [], 0
    while m := _HIDDEN.search(body, at):
        out.append(body[at : m.start()])
        at = m.end()
        if m.group(0)[:5].lower() == "<head":
            inner = at
            while True:  # the head's own scripts and comments can hold the text of an end tag
                end, skip = _HEAD_END.search(body, inner), _HIDDEN.search(body, inner)
                if skip and (not end or skip.start() < end.start()) and skip.group(0)[:5].lower() != "<head":
                    inner = skip.end()
                    continue
                at = end.end() if end else len(body)
                break
    out.append(body[at:])
    return "".join(out)


def visible_lines(body: str | None) -> list[str]:
    """Visible lines in page order, trimmed, without empty ones. None and empty bodies give no line."""
    if not body:
        return []
    text = without_hidden(body.replace(_BREAK, " "))
    text = _OTHER.sub("", _BLOCK.sub(_BREAK, text))
    return [line for part in text.split(_BREAK) if (line := " ".join((unescape(part) if "&" in part else part).split()))]


def text_lines(text: str | None) -> list[str]:
    """Lines of a plain text: split at newlines, trimmed, empty ones dropped."""
    return [s for x in (text or "").split("\n") if (s := x.strip())]
