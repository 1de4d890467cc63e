"""Text expressions: all of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folding() -> tuple[str, str]:
    """Lower-case letters that are one of a-z with marks, those letters, and after them the marks alone, which go."""
    parts = ((chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0x2000))
    marked = [(c, d[0]) for c, d in parts if len(d) > 1 and "a" <= d[0] <= "z" and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in marked) + "".join(map(chr, range(0x300, 0x370))), "".join(plain for _, plain in marked)


FOLD_FROM, FOLD_TO = _folding()
# Typographic characters and their plain forms.
TYPOGRAPHY = {"“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-", "…": "...", "ﬁ": "fi", "ﬂ": "fl", " ": " "}
# Words that carry no content in a question.
STOPWORDS = (
    "the what which how why does did are and for that this with from into when where who was were has have "
    "its his her their them they you not but can cannot some someone something one two call called make makes "
    "made say said people mean means after before than then there here about over under through between part parts"
).split()
# Words that are not marked in a passage.
UNMARKED = (
    "a an and are as at be but by can could do does for from had has have how i if in is it its of on or that the "
    "their there these they this to was were what when where which who why will with would you your"
).split()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Tokens of a question (with underscores), without single letters; single digits stay."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda t: (F.length(t) > 1) | t.rlike(r"^\d$"))


def or_query(terms: Column) -> Column:
    """Terms in quotes joined by OR."""
    return F.concat_ws(" OR ", F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))))


def phrase_query(terms: Column) -> Column:
    """The terms as one quoted phrase; empty below two terms."""
    return F.when(F.size(terms) >= 2, F.concat(F.lit('"'), F.concat_ws(" ", terms), F.lit('"'))).otherwise(F.lit(""))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct shingles of ``n`` words of a-z and digits."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    span = F.greatest(F.size(w) - (n - 1), F.lit(0))
    made = F.slice(w, F.lit(1), span)
    for i in range(1, n):  # shifted copies side by side: the words are not looked up again in each step
        made = F.zip_with(made, F.slice(w, F.lit(i + 1), span), lambda x, y: F.concat_ws(" ", x, y))
    return F.when(F.size(w) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def content_hash(data: Column) -> Column:
    """The first 8 bytes of SHA-256 as a signed number."""
    return F.conv(F.substring(F.sha2(data, 256), 1, 16), 16, -10).cast("bigint")


def plain_typography(text: Column) -> Column:
    """Plain quotes, dashes and ligatures; white space collapsed."""
    for a, b in TYPOGRAPHY.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stem(word: Column) -> Column:
    """Without one ending of ing, ed, es or s, if four letters stay."""
    out = word
    for end in ("s", "es", "ed", "ing"):
        out = F.when(word.endswith(end) & (F.length(word) - len(end) >= 4), F.substring(word, F.lit(1), F.length(word) - len(end))).otherwise(out)
    return out


def content_words(text: Column) -> Column:
    """Distinct words of three letters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)))


def overlap_share(question: Column, passage: Column) -> Column:
    """Share of a question's content words whose stem is in the passage."""
    words = content_words(question)
    found = F.filter(words, lambda w: F.contains(F.lower(passage), stem(w)))
    return F.when(F.size(words) > 0, F.size(found) / F.size(words)).otherwise(F.lit(0.0))


def distinctive_phrase(text: Column, n: int = 9) -> Column:
    """``n`` words from a quarter in; null for texts under twice as many words."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.when(F.size(w) >= 2 * n, F.concat_ws(" ", F.slice(w, F.floor(F.size(w) / 4).cast("int") + 1, n)))


def contains_term(text: Column, term: Column) -> Column:
    """Whether a term starts at a word boundary, by the letters of any script; only texts that hold it are looked at for that."""
    low = F.lower(text)
    return F.contains(low, F.lower(term)) & F.regexp_like(low, F.concat(F.lit(r"(?U)\b\Q"), F.lower(term), F.lit(r"\E")))


def duration_seconds(text: Column) -> Column:
    """90, 90s, 30m or 2h in seconds; null for anything else."""
    n = F.try_to_number(F.regexp_extract(text, r"^(\d+)[smh]?$", 1), F.lit("999999999")).cast("bigint")
    return F.when(text.rlike(r"^\d+[smh]?$"), n * F.when(text.endswith("h"), 3600).when(text.endswith("m"), 60).otherwise(1))


def size_label(size: Column) -> Column:
    """Bytes at the scale a person thinks in, to one decimal, halves upwards."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, scale in (("KB", 10**3), ("MB", 10**6), ("GB", 10**9)):
        tenths = F.floor((size + scale // 20) / (scale // 10)).cast("bigint")
        out = F.when(size >= scale, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def age_label(seconds: Column) -> Column:
    """How long ago, in the coarsest unit."""
    ago = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 0, "just now").when(seconds >= 86400, ago(86400, "d")).when(seconds >= 3600, ago(3600, "h")).when(seconds >= 60, ago(60, "m")).otherwise(ago(1, "s"))


def elide(text: Column, width: int, tail: int = 12) -> Column:
    """At most ``width`` characters, cut in the middle: titles differ at their ends."""
    end = min(tail, width - 2)
    cut = F.concat(F.substring(text, 1, width - end - 1), F.lit("…"), F.right(text, F.lit(end))) if width > 3 else F.substring(text, 1, width)
    return F.when(F.length(text) <= width, text).otherwise(cut)


def marked_terms(question: Column) -> Column:
    """Stems of a question's words that are worth marking in a passage: longest first, then by alphabet."""
    words = F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*UNMARKED))

    def cut(w: Column) -> Column:
        out = w
        for end in ("s", "ed", "es", "ies", "ing"):  # the last that fits stands outermost
            out = F.when(w.endswith(end) & (F.length(w) > len(end) + 3), F.substring(w, F.lit(1), F.length(w) - len(end))).otherwise(out)
        return out

    sized = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.struct((-F.length(cut(w))).alias("n"), cut(w).alias("w")))))
    return F.transform(sized, lambda x: x["w"])


def rendered(number: Column, text: Column, limit: int = 1600) -> Column:
    """A numbered passage as a model reads it; null for a passage without text."""
    return F.when(text != "", F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)))


def rephrasing(reply: Column) -> Column:
    """The first line of a reply that is a question of 3 to 40 words and no preamble; empty without one."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.regexp_replace(x, r'^[ "“”*-]+|[ "“”*-]+$', ""))
    # How a preamble begins.
    fits = F.filter(lines, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).between(3, 40) & ~F.lower(x).rlike("^(here|sure|one |a different|rephrase)"))
    return F.coalesce(F.get(fits, 0), F.lit(""))
