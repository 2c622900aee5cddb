"""Segments, stop signals and token counts as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Break strings and stop signals of each format.
BREAK_STRINGS = {
    "markdown": ["\n\n# ", "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "\n\n", "\n- ", "\n* ", "\n+ ", "\n1. ", "\n```\n", "\n", ". ", "! ", "? "],
    "plain": ["\n\n", "\n", ". ", "! ", "? "],
    "csharp": ["\n\n", "\n{", "\n}", "\n", "; "],
    "javascript": ["\n\n", "\n{", "\n}", "\n", "; "],
    "html": ["\n\n", "\n", ". "],
    "css": ["\n\n", "}\n", "\n", "; "],
    "python": ["\n\n", "\n", ". "],
}
STOP_SIGNALS = {
    "markdown": ["# ", "## ", "### ", "#### ", "##### ", "###### ", "```", "**"],
    "plain": [],
    "csharp": ["/// <summary>"],
    "javascript": ["/**"],
    "html": ["<h1", "<h2", "<h3"],
    "css": ["@media", "@keyframes", "@import", "@supports"],
    "python": ["def ", "async def ", "class "],
}
#: What a segment ends with, and what may follow while it still ends with a break string.
SEGMENT_ENDS = {
    "markdown": (r"(?:\n|[.!?] )", r"\n*"),
    "plain": (r"(?:\n|[.!?] )", r"\n*"),
    "csharp": (r"(?:\n[{}]?|; )", r"(?:\n[{}]?)*"),
    "javascript": (r"(?:\n[{}]?|; )", r"(?:\n[{}]?)*"),
    "html": (r"(?:\n|\. )", r"\n*"),
    "css": (r"(?:\n|; )", r"\n*"),
    "python": (r"(?:\n|\. )", r"\n*"),
}
#: Formats all of whose segments end in white space: word counts of joined segments then add up.
ADDITIVE = {"markdown", "plain", "html", "css", "python"}


@dataclass(frozen=True)
class ChunkOptions:
    """Token limit, break strings and stop signals; a preset's name or lists of strings."""

    max_tokens: int = 300
    break_strings: str | tuple[str, ...] = "markdown"
    stop_signals: str | tuple[str, ...] = "markdown"

    def __post_init__(self):
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be above 0")
        if not self.break_strings:
            raise ValueError("at least one break string is needed")

    @property
    def breaks(self) -> list[str]:
        return BREAK_STRINGS[self.break_strings] if isinstance(self.break_strings, str) else list(self.break_strings)

    @property
    def stops(self) -> list[str]:
        return STOP_SIGNALS[self.stop_signals] if isinstance(self.stop_signals, str) else list(self.stop_signals)


def segments(text: Column, preset: str) -> Column:
    """A text's segments: each runs up to a break string and takes in the ones that follow at once; they add up to the text."""
    end, more = SEGMENT_ENDS[preset]
    return F.regexp_extract_all(text, F.lit(rf"((?s).*?{end}{more}|.+\z)"), F.lit(1))


def count_words(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def has_stop_signal(segment: Column, stops: list[str]) -> Column:
    """Whether a segment, after leading white space, starts with a signal; empty signals do not count."""
    real = [re.escape(s) for s in stops if s]
    return segment.rlike(r"^(?U)\s*(?-U)(?:" + "|".join(_java(s) for s in stops if s) + ")") if real else F.lit(False)


def _java(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def task_prefix(text: Column, purpose: Column | str) -> Column:
    """A text with the prefix of its purpose: query or document."""
    chosen = F.lit(purpose) if isinstance(purpose, str) else purpose
    return F.concat(F.when(chosen == "query", F.lit("search_query: ")).otherwise(F.lit("search_document: ")), text)
