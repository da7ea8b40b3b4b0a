"""Line-first cleaning: drop bad lines, then reject documents that lose too much."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from rolloom.llm.texts import SPACES, WORD, Codes, byte_words, covered, window_codes, with_text_columns

#: A symbol as the last character of a word, or a word of symbols.
SYMBOLS = "#*$%&|<>"
#: Least words for a document, and most words (in %) that may stand in repeated 5-word windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Share of its words that a document may lose with its bad lines.
MOST_LOST = 0.4

WORDS = re.compile(WORD)
SENTENCE_END = re.compile(r"[.!?:;…。！？][\"'»”’)\]]*(?:[ \t]|$)")
SHOUT = re.compile(r"[!?]{1,8}$")
SYMBOL_END = re.compile(r"[#*$%&<>|]$")
NAVIGATION = re.compile(r"^(?:\||>|»|›|·|•|::|/|<)$")
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|(?:uses?|accept) cookies"
    r"|enable javascript|javascript (?:is )?(?:disabled|required)|click here|read more|sign up|log in to"
    r"|subscribe to|follow us|share this|back to top|skip to (?:main )?content|powered by"
    r"|licensed under the|released under the|lorem ipsum|copyright (?:\(c\)|©)|^©",
    re.IGNORECASE,
)


def line_fault(line: str) -> str | None:
    """Which rule a line with words fails: ``punctuation``, ``navigation``, ``boilerplate`` or none.

    navigation: separators are a fifth of the words or more. boilerplate: a phrase of the list in a
    line of up to 40 words. punctuation: no sentence ends in a line of five words or more, or three
    words in ten or more end with a symbol, or half of four words or more end with ! or ?.
    """
    words = WORDS.findall(line)
    n = len(words)
    separators = sum(1 for w in words if NAVIGATION.match(w))
    if separators * 5 >= n and separators:
        return "navigation"
    if n <= 40 and BOILERPLATE.search(line):
        return "boilerplate"
    rest = n - separators
    if 10 * sum(1 for w in words if SYMBOL_END.search(w)) >= 3 * rest:
        return "punctuation"
    if rest >= 4 and 2 * sum(1 for w in words if SHOUT.search(w)) >= rest:
        return "punctuation"
    if rest >= 5 and not SENTENCE_END.search(line.rstrip(SPACES)):
        return "punctuation"
    return None


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that stand in a window of ``width`` words that the text has twice or more."""
    windows = window_codes(Codes().numbers(words), width)
    if not len(windows):
        return 0
    counts = np.bincount(windows)
    if len(counts) == len(windows):
        return 0
    return int(covered(counts[windows] > 1, width, len(words)).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines and words in repeated windows."""
    text = text or ""
    words = byte_words(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            repeated += line in seen
            seen.add(line)
    letters = len(text) - sum(map(text.count, SPACES))
    return len(words), letters, sum(map(text.count, SYMBOLS)), repeated, repeated_words(words)


def clean_lines(text: str | None) -> tuple[str, int]:
    """The text without the lines that fail a rule, and how many words went with them."""
    kept, lost = [], 0
    for line in (text or "").split("\n"):
        if line.strip(SPACES) and line_fault(line):
            lost += len(byte_words(line))
        else:
            kept.append(line)
    return "\n".join(kept), lost


def judge(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` with the measures, ``clean_text``, ``n_lost_words`` and the verdicts.

    Lines go first: those that fail ``line_fault`` are removed; a document is rejected if more than
    MOST_LOST of its words went with them. ``base_failed``: fewer than LEAST_WORDS words, or more than
    MOST_REPEATED % of them in repeated windows. ``kept``: neither. A null text has no words, so it
    fails; so does an empty one. Lines without words stay and cost nothing. Every row is judged by
    itself over its whole text, so repeated rows get equal verdicts; no shuffle. An empty table gives
    an empty result.
    """
    fields = [
        ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
        ("n_repeat_words", "long"), ("n_lost_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"),
        ("clean_text", "string"),
    ]

    def verdict(value: str | None) -> tuple:
        found = measures(value)
        cleaned, lost = clean_lines(value)
        failed = found[0] < LEAST_WORDS or 100 * found[4] > MOST_REPEATED * found[0]
        return *found, lost, failed, not failed and lost <= MOST_LOST * found[0], cleaned

    made = {name for name, _ in fields}
    return with_text_columns(docs, text, fields, verdict, [c for c in keep if c not in made])
