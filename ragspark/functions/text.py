"""Text expressions. All are built-in functions, so they stay in the JVM and prune columns as usual.

Word and space characters are spelled out as classes: Java's own ``\\w`` and ``\\s`` know ASCII only, and their Unicode
mode is slower and counts combining marks as word characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv

WORD_CHAR = r"\p{L}\p{N}_"
WORD = f"[{WORD_CHAR}]+"
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_SPACES}]"
_SPACE_IN_LINE = f"[{_SPACES}&&[^\\n]]"
_SPACE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
              0x3000]))
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
CODE_LINE = (
    r"^(def |class |function |#|//)|[{}]|\(\);|=>"
    rf"|(?<![{WORD_CHAR}])(for|while)(?![{WORD_CHAR}])|(?<![{WORD_CHAR}])if(?![{WORD_CHAR}]).*:"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE_CHARS))


def filled(text: Column) -> Column:
    """Null when the text is null or blank."""
    return F.nullif(strip(text), F.lit(""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_estimate(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def words(text: Column) -> Column:
    """Whitespace-separated words in order, repeats kept."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def query_terms(text: Column) -> Column:
    """Distinct lower-cased whitespace-separated words."""
    return F.array_distinct(words(F.lower(text)))


def query_keywords(text: Column) -> Column:
    return F.array_distinct(
        F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(*fv.STOP_WORDS))
    )


def keyword_hits(text: Column, keywords: Column) -> Column:
    """Non-overlapping occurrences of every keyword in the lower-cased text, added up."""
    def hits(t: Column) -> Column:
        return F.aggregate(
            keywords,
            F.lit(0).cast("long"),
            lambda n, k: n + F.floor((F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.length(k)),
        )
    return let(F.lower(text), hits)


def pronoun_ratio(text: Column) -> Column:
    def ratio(ts: Column) -> Column:
        said = F.size(F.filter(ts, lambda t: t.isin(*fv.PRONOUNS)))
        return F.when(F.size(ts) == 0, F.lit(0.0)).otherwise(said / F.size(ts))
    return let(tokens(text), ratio)


def has_structure(text: Column) -> Column:
    return (
        F.contains(text, F.lit("\n\n"))
        | text.rlike(f"(?md)^{SPACE}*[-•*]{SPACE}")
        | text.rlike(rf"\n[A-Z][A-Za-z{_SPACES}]{{3,}}\n")
    )


def is_forum_source(url: Column) -> Column:
    return url.rlike("|".join(s.replace(".", r"\.") for s in fv.FORUM_SITES))


def has_forum_noise(text: Column) -> Column:
    markers = strings(fv.FORUM_MARKERS)
    return let(F.lower(text), lambda t: F.exists(markers, lambda m: F.contains(t, m)))


def has_code_mixture(text: Column) -> Column:
    """Share of non-blank lines that look like code reaches the limit."""
    def share(lines: Column) -> Column:
        code = F.size(F.filter(lines, lambda line: line.rlike(CODE_LINE)))
        return F.when(F.size(lines) == 0, F.lit(False)).otherwise(code / F.size(lines) >= fv.CODE_LINE_SHARE)
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda line: line != "")
    return let(lines, share)


def answer_penalty(text: Column) -> Column:
    phrases = strings(fv.PENALTY_PHRASES)
    return let(F.lower(text), lambda t: F.size(F.filter(phrases, lambda p: F.contains(t, p))) * fv.PENALTY_PER_PHRASE)


def sentence_blocks(text: Column) -> Column:
    """Sentence-like blocks: newline runs collapse, then the text breaks between a full stop and a capital."""
    parts = F.split(F.regexp_replace(text, "\n+", "\n"), rf"(?<=\.){SPACE}+(?=[A-Z])")
    return F.filter(F.transform(parts, strip), lambda b: b != "")


def clean_text(text: Column) -> Column:
    """Whitespace, blank lines, line ends, space before punctuation, control characters, outer whitespace."""
    out = F.regexp_replace(text, r"[ \t]+", " ")
    out = F.regexp_replace(out, rf"\n{SPACE}*\n", "\n")
    out = F.regexp_replace(out, f"(?md)^{_SPACE_IN_LINE}+|{_SPACE_IN_LINE}+$", "")
    out = F.regexp_replace(out, rf"{SPACE}+([.,!?;:])", "$1")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", "")
    return strip(out)


def collapse_whitespace(text: Column) -> Column:
    """One space between words; a marker where nothing is left to embed."""
    return F.coalesce(F.nullif(F.array_join(words(text), " "), F.lit("")), F.lit(fv.EMPTY_MARKER))


def summary(text: Column) -> Column:
    cut = F.substring(text, 1, fv.SUMMARY_CHARS)
    return F.when(F.length(text) > fv.SUMMARY_CHARS, F.concat(cut, F.lit("..."))).otherwise(text)


def inverted_words(texts: Column) -> Column:
    """``word -> positions`` map of an array of texts, positions counted in each text: sort the words, then measure the runs."""
    places = F.flatten(F.transform(texts, lambda t: F.transform(
        words(t), lambda w, i: F.struct(w.alias("word"), i.alias("at")))))

    def runs(ps: Column) -> Column:
        starts = F.filter(F.transform(ps, lambda p, i: F.when((i == 0) | (p["word"] != F.get(ps, i - 1)["word"]), i)),
                          lambda i: i.isNotNull())
        ats = F.transform(ps, lambda p: p["at"])
        return let(F.struct(starts.alias("starts"), ats.alias("ats")), lambda x: F.map_from_entries(
            F.transform(x["starts"], lambda at, j: F.struct(
                F.get(ps, at)["word"].alias("word"),
                F.slice(x["ats"], at + 1, F.coalesce(F.get(x["starts"], j + 1), F.size(ps)) - at).alias("ats")))))
    return let(F.sort_array(places), runs)


def rebuild_abstract(inverted: Column) -> Column:
    """Text of a ``word -> positions`` map, by position and then word."""
    pairs = F.flatten(
        F.transform(
            F.map_entries(inverted),
            lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word"))),
        )
    )
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), " "), F.lit(""))
