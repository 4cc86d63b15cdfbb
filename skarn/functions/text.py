"""Text functions as Column expressions; the same function serves documents and queries."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that don't decompose, and what they fold to.
FOLDED_APART = {"đ": "d", "ø": "o", "ł": "l", "ħ": "h", "ı": "i", "ŧ": "t"}
FOLDED_TO_TWO = {"ß": "ss", "æ": "ae", "œ": "oe"}


def word_tokens(text: Column) -> Column:
    """Runs of letters, marks and digits of any alphabet in the lower-cased text; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\pL\pM\pN]+)"))


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def _fold_table() -> tuple[str, str]:
    pairs = dict(FOLDED_APART)
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Lower-cased, without accents; letters that don't decompose go to their ASCII form."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for a, b in FOLDED_TO_TWO.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(out, *_fold_table()), r"\p{M}+", "")


def folded_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit("([a-z0-9]+)"))


def bound(value: Column, fn) -> Column:
    """fn(value) with the value computed once, however often fn names it, also inside lambdas."""
    return F.transform(F.array(value), fn)[0]


def _nfc(text: Column) -> Column:
    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return compose(text)


def normalize(text: Column, compose: bool = False) -> Column:
    """Lower case, single spaces, trimmed; null is empty. compose=True also applies NFC, which is no built-in."""
    given = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(_nfc(given) if compose else given), r"\s+", " "))


def compound_words(words: list[str], dictionary: frozenset[str], longest: int, stopwords: frozenset[str]) -> list[str]:
    """Greedy longest dictionary match from the left, parts joined by an underscore; single stopwords are dropped."""
    out, i = [], 0
    while i < len(words):
        n = next((n for n in range(min(longest, len(words) - i), 1, -1) if " ".join(words[i : i + n]) in dictionary), 1)
        if n > 1 or words[i] not in stopwords:
            out.append("_".join(words[i : i + n]))
        i += n
    return out


def segmenter(dictionary: Iterable[str], stopwords: Iterable[str] = ()):
    """Column -> Column of segmented text. The dictionary's compounds are given with spaces."""
    known = frozenset(" ".join(unicodedata.normalize("NFC", w).lower().split()) for w in dictionary)
    stop = frozenset(unicodedata.normalize("NFC", w).strip().lower() for w in stopwords)
    longest = max((len(w.split()) for w in known), default=1)

    @F.pandas_udf("string")
    def segment(words: pd.Series) -> pd.Series:
        return words.map(lambda x: " ".join(compound_words(x.split(), known, longest, stop)))

    return lambda text: segment(F.regexp_replace(normalize(text, compose=True), r"[^\p{L}\p{Nd}\s]", " "))


def cleaned_segments(words: Column, stopwords: Iterable[str] = ()) -> Column:
    """The words of another segmenter (compounds joined by an underscore) by the rules of this one: lower case, only letters, digits and
    underscores, no empty words, single stopwords dropped."""
    stop = list(stopwords)
    kept = F.transform(F.split(F.trim(normalize(words)), " "), lambda w: F.regexp_replace(w, r"[^\p{L}\p{Nd}_]", ""))
    return F.array_join(F.filter(kept, lambda w: (w != "") & (~w.isin(stop) if stop else F.lit(True))), " ")


def escape_html(text: Column) -> Column:
    """Text that is safe inside markup and attributes."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_highlight(marked: Column) -> Column:
    """A highlighted fragment with everything escaped but its own marks."""
    out = escape_html(marked)
    for tag in ("<em>", "</em>"):
        out = F.replace(out, F.lit(tag.replace("<", "&lt;").replace(">", "&gt;")), F.lit(tag))
    return out


def embedding_text(title_seg: Column, content_seg: Column, size: int = 2000) -> Column:
    return F.substring(F.concat(F.coalesce(title_seg, F.lit("")), F.lit(" "), F.coalesce(content_seg, F.lit(""))), 1, size)


def service_text(text: Column, size: int = 4000) -> Column:
    """What a model service takes of a text at most."""
    return F.substring(F.coalesce(text, F.lit("")), 1, size)


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct shingles of k tokens; fewer tokens are one shingle, none have none; k of 0 or less means 5."""
    k = k if k > 0 else 5

    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(F.size(t) >= k, F.array_distinct(many)).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    return bound(tokens, of)


def char_kgrams(text: Column, k: int = 2) -> Column:
    """Distinct character k-grams; a shorter text is its own."""
    many = F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, F.lit(k)))
    return F.when(F.length(text) < k, F.array(text)).otherwise(F.array_distinct(many))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; both empty: 1."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def document_id(url: Column) -> Column:
    return F.sha2(url, 256)


def title_of(text: Column) -> Column:
    """The first line."""
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def snippet_around(text: Column, word: Column, before: int = 60, after: int = 140, fallback: int = 200) -> Column:
    """Text around the first place of a word, with dots where it is cut."""
    at = F.instr(F.lower(text), word)
    first = F.greatest(at - before, F.lit(1))
    last = F.least(at + after, F.length(text))
    cut = F.concat(F.when(first > 1, "...").otherwise(""), F.substring(text, first, last - first + 1), F.when(last < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, fallback))


def highlight(text: Column, word: Column, size: int = 180) -> Column:
    """One fragment of ``size`` characters from the word's first place on, the word marked; else the head of the text."""
    at = F.instr(F.lower(text), word)
    fragment = F.substring(text, at, F.lit(size))
    marked = F.concat(F.lit("<em>"), F.substring(fragment, F.lit(1), F.length(word)), F.lit("</em>"), F.substring(fragment, F.length(word) + 1, F.lit(size)))
    return F.replace(F.when(at > 0, marked).otherwise(F.concat(F.substring(text, 1, size), F.lit("…"))), F.lit("_"), F.lit(" "))


def rerank_text(title: Column, content: Column, size: int = 2000) -> Column:
    return F.substring(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(content, F.lit(""))), 1, size)


def title_and_content(title: Column, content: Column) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))


def lenient_timestamp(text: Column) -> Column:
    """An ISO instant or a date; anything else is null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(T.*(Z|[+-]\d{2}:?\d{2}))?$"), F.try_to_timestamp(t))
