"""Two more glob dialects as regexes: that of glob requests, and that of ignore files."""

from __future__ import annotations

import re

PIECES = re.compile(r"\*\*/|\*\*|\[[!^]?\]?[^\]]*\]|\\.|.", re.S)
IGNORE_PIECES = re.compile(r"\A(?:\*\*/)+|/(?:\*\*/)+|/\*\*\Z|\*+|\[[!^]?.[^\]]*\]|\\.|.", re.S)


class GlobError(ValueError):
    """A glob with an open bracket or brace."""


def inside(letters: str) -> str:
    """The body of a class, every letter by itself but for ranges."""
    return re.sub(r"[\[\]\\&~^]", lambda m: "\\" + m[0], letters)


def request_regex(glob: str, base: str) -> str:
    """The regex over whole paths for a glob below base.

    With a slash it starts at base, without one it is a name at any depth; a last slash means a folder and all in it; case doesn't
    count.
    """
    body = glob.removeprefix("./")
    folder = body.endswith("/")
    body = body.removesuffix("/")
    out, depth = "", 0
    for piece in PIECES.findall(body.removeprefix("/")):
        if piece == "**/":
            out += "(?:.*/)?"
        elif piece == "**":
            out += ".*"
        elif piece == "*":
            out += "[^/]*"
        elif piece == "?":
            out += "[^/]"
        elif piece == "[":
            raise GlobError(f"unclosed [ in glob {glob}")
        elif piece[0] == "[":
            negated = piece[1] in "!^"
            letters = piece[1 + negated : -1]
            first = "\\-" if letters[:1] == "-" else ""
            out += ("[^" if negated else "[") + first + inside(letters[len(first) > 0 :]) + "]"
        elif piece == "{":
            depth, out = depth + 1, out + "(?:"
        elif piece == "}" and depth:
            depth, out = depth - 1, out + ")"
        elif piece == "," and depth:
            out += "|"
        else:
            out += re.escape(piece[1:] if piece[0] == "\\" else piece)
    if depth:
        raise GlobError(f"unclosed {{ in glob {glob}")
    below = "/" if body.startswith("/") else re.escape(base.rstrip("/")) + "/" + ("(?:.*/)?" if folder or "/" not in body else "")
    return "(?is)^" + below + out + ("(?:/|$)" if folder else "$")


def ignore_class(piece: str) -> str | None:
    """A class of an ignore rule; None if a range runs backwards."""
    negated = piece[1] in "!^"
    letters, out, i = piece[1 + negated : -1], "", 0
    while i < len(letters):
        if i and letters[i] == "-" and i + 1 < len(letters):
            if letters[i + 1] < letters[i - 1]:
                return None
            out, i = out + "-" + inside(letters[i + 1]), i + 2
        else:
            out, i = out + ("\\-" if letters[i] == "-" else inside(letters[i])), i + 1
    return ("[^" if negated else "[") + out + "]"


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regex over the path below the rule's folder, whether it lets in, whether for folders only); None if the line is no rule."""
    if line.startswith("#"):
        return None
    text = line if line.endswith("\\ ") else line.rstrip()
    white = anchored = False
    if text[:2] in ("\\!", "\\#"):
        text = text[1:]
    else:
        white = text.startswith("!")
        text = text.removeprefix("!")
        anchored = text.startswith("/")
        text = text.removeprefix("/")
    folder = text.endswith("/")
    if folder:
        text = text[:-1].removesuffix("\\")
    if not text:
        return None
    if not anchored and "/" not in text and text != "**":
        text = "**/" + text
    if text.endswith("/**"):
        text += "/*"
    if text == "**":
        return "(?s)^.*$", white, folder
    out, depth, empty = "", 0, True
    for piece in IGNORE_PIECES.findall(text):
        was, empty = empty, False
        if piece == "\\" or piece == "{" and depth:
            return None
        if piece == "/**":
            out += "/.*"
        elif piece[0] == "/" and len(piece) > 1:
            out += "(?:/|/.*/)"
        elif piece.startswith("**/"):
            out += "(?:/?|.*/)"
        elif piece[0] == "*":
            out += "[^/]*"
        elif piece == "?":
            out += "[^/]"
        elif piece[0] == "[" and len(piece) > 1:
            if (letters := ignore_class(piece)) is None:
                return None
            out += letters
        elif piece == "{":
            depth, out, empty = 1, out + "(?:", True
        elif piece == "}":
            if depth:
                out = out.removesuffix("|") + ")"
            depth = 0
        elif piece == "," and depth:
            out, empty = out + ("" if was else "|"), True
        else:
            out += re.escape(piece[1:] if piece[0] == "\\" else piece)
    return None if depth else ("(?s)^" + out + "$", white, folder)


def narrowing(pattern: str, base: str) -> tuple[str, list[str]]:
    """What a request's glob asks of all that it matches: a lower-case beginning of the path, and extensions (none: any).

    Both are looked at before the regex; folders before the first wildcard only count where the glob is tied to the base.
    """
    root = base.rstrip("/").lower()
    folders = pattern.strip("/").split("/") if "/" in pattern.rstrip("/") else []
    fixed = []
    for part in folders[:-1]:
        if re.search(r"[*?\[{\\]", part):
            break
        fixed.append(part.lower())
    last = re.fullmatch(r"(?:.*/)?\*\.(?:(\w+)|\{(\w+(?:,\w+)*)\})", pattern)
    return "/".join([root, *fixed]), (last[1] or last[2]).lower().split(",") if last else []
