"""What a parsed query holds."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Token:
    """mode: fuzzy, exact, prefix or suffix; under: a later piece of a word with slashes."""

    text: str
    mode: str = "fuzzy"
    negate: bool = False
    under: bool = False


@dataclass(frozen=True)
class Glob:
    """One regex over the path below the scope for each alternative."""

    text: str
    patterns: tuple[str, ...]
    negate: bool = False


@dataclass
class Query:
    tokens: list[Token] = field(default_factory=list)
    globs: list[Glob] = field(default_factory=list)
    exts: list[str] | None = None
    not_exts: list[str] = field(default_factory=list)
    kind: int | None = None
    apps: bool = False
    scope: str | None = None
    size: tuple[int, int] | None = None
    mtime: tuple[int, int] | None = None
    name_regex: str | None = None
    path_regex: str | None = None
    git: list[str] = field(default_factory=list)
    grep: str | None = None
    grep_mode: str = "literal"
    limit: int = 50
