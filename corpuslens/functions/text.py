"""The three tokenizers and the text marks. They are never mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it, spelled out because Java's \s is ASCII-only.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
NON_WS = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"
WORD2 = r"[\p{L}\p{N}_]{2,}"

# Mark patterns and emoji blocks.
MENTION = r"@[\p{L}\p{N}_]+"
HASHTAG = r"#[\p{L}\p{N}_]+"
URL = r"https?://|www\."
EXCLAMATION = r"!"
ELONGATION = r"([^\n])\1{2,}"
EMOJI = (r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}"
         r"\x{2700}-\x{27BF}\x{1F900}-\x{1F9FF}]")

# The English word list of the word-list rate.
WORD_LIST = [
    "fuck", "fucking", "fucker", "fuckin", "shit", "shitty", "bitch", "bitches", "asshole", "ass", "bastard",
    "damn", "dumbass", "crap", "piss", "pissed", "dick", "dickhead", "cock", "pussy", "cunt", "slut", "whore",
    "faggot", "fag", "retard", "retarded", "moron", "idiot", "stupid", "scum", "trash", "loser", "freak",
    "psycho", "douche", "douchebag", "prick", "twat", "wanker", "bollocks",
]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def white_tokens(c: Column) -> Column:
    """Lower-cased white-space tokens."""
    return F.regexp_extract_all(F.lower(c), F.lit(NON_WS), F.lit(0))


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def term_tokens(c: Column) -> Column:
    """Lower-cased runs of two or more word characters (TF-IDF terms)."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD2), F.lit(0))


def word_ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """All n-grams of lengths lo..hi, joined by one space.

    Each length extends the one before by the token that follows; the lambda sees
    two strings only, so the tokens are not cut from the text again per n-gram.
    """
    grams, out = tokens, []
    for n in range(1, hi + 1):
        if n > 1:
            grams = F.array_compact(F.zip_with(
                grams, F.slice(tokens, n, F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b)))
        if n >= lo:
            out.append(grams)
    return F.concat(*out)


def char_ngrams(words: Column, lo: int, hi: int) -> Column:
    """Character n-grams inside words padded with one space on each side.

    A padded word shorter than n gives itself once and no longer grams.
    """
    def per_word(w):
        p = F.concat(F.lit(" "), w, F.lit(" "))

        def grams(n):
            full = F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substring(p, i, F.lit(n)))
            return F.when(F.length(p) >= n, full).otherwise(
                F.array(p) if n == lo else F.array().cast("array<string>"))
        return F.concat(*[grams(n) for n in range(lo, hi + 1)])
    return F.flatten(F.transform(words, per_word))
