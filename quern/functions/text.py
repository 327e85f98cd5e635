"""Text functions as column expressions; all run inside the JVM.

Word characters are letters, numbers and the underscore, without combining marks; ``\\p{Nd}`` stands for digits.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from quern.functions import lexicons as lex

ARABIC = r"\u0600-\u06ff"
ARABIC_WIDE = r"\u0600-\u06ff\u0750-\u077f"
ZERO_WIDTH = r"[\u200b\u200c\u200d\ufeff]"
LETTERS = r"\p{L}\p{N}_"
SPACE = r"\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The characters of SPACE.
SPACES = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c evaluated once however often f uses it, inside lambdas too."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """The runs of characters that aren't white space."""
    return F.filter(F.split(F.translate(c, SPACES, " " * len(SPACES)), " "), lambda w: w != "")  # one character is split at without a regular expression


def n_matches(c: Column, chars: str) -> Column:
    """How many characters of a class there are."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]+", ""))  # a replacement for each run of them


def java(pattern: str) -> str:
    """A pattern with Unicode-aware classes and word boundaries that ignore combining marks."""
    edge = f"(?:(?<![{LETTERS}])(?=[{LETTERS}])|(?<=[{LETTERS}])(?![{LETTERS}]))"
    return pattern.replace(r"\b", edge).replace(r"\d", r"\p{Nd}").replace(r"\s", f"[{SPACE}]")


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern occurs, whatever the case."""
    return reduce(lambda a, b: a | b, [c.rlike("(?iu)" + java(p)) for p in patterns])


def fold_alef(c: Column) -> Column:
    return F.translate(c, "أإآٱ", "اااا")


def strip_article(c: Column) -> Column:
    """Without the leading article of a word of more than three characters."""
    return F.when(c.startswith("ال") & (F.length(c) > 3), F.substring(c, 3, 1 << 30)).otherwise(c)


def stop_words(stop: Sequence[str] = lex.STOP_AR + lex.STOP_EN, fold: bool = True) -> list[str]:
    """The stop words as tokens come out, so that each can match; as they are without ``fold``."""
    shaped = [x.translate(str.maketrans("أإآٱ", "اااا")) for x in stop]
    return sorted({x[2:] if x.startswith("ال") and len(x) > 3 else x for x in shaped} if fold else set(stop))


def tokenize(c: Column, stop: Sequence[str] = lex.STOP_AR + lex.STOP_EN, fold_stop: bool = True) -> Column:
    """Search tokens of a text, in order. fold_stop: fold the stop words as tokens are folded."""
    parts = F.split(F.lower(F.regexp_replace(fold_alef(c), f"[^{LETTERS}%]+", " ")), " ")  # one character is split at without a regular expression
    gone = stop_words(stop, fold_stop)
    return F.filter(F.transform(parts, strip_article), lambda t: (F.length(t) >= 2) & ~t.isin(gone))


#: Characters that no text holds, to mark places in it.
MARK, MARK_END = "\ufdd0", "\ufdd1"


def arabize_list_numbers(c: Column) -> Column:
    """Numbers at the start of lines, with a point or bracket, in Arabic-Indic digits where Arabic follows.

    What follows may stand on the next line that isn't blank; that line is then no number of its own.
    """
    marked = F.regexp_replace(c, rf"(?dm)^(\p{{Nd}}+)([.)][{SPACE}]*)(.*)", f"{MARK}$1{MARK_END}$2$3")

    def numbered(x: Column) -> Column:
        digits, rest = F.substring_index(x, MARK_END, 1), F.substring_index(x, MARK_END, -1)
        arabic = rest.rlike(rf"(?d)^[.)][{SPACE}]*.*[{ARABIC}]")
        return F.concat(F.when(arabic, F.translate(digits, "0123456789", "٠١٢٣٤٥٦٧٨٩")).otherwise(digits), rest)

    return F.array_join(F.transform(F.split(marked, MARK), lambda x, i: F.when(i == 0, x).otherwise(numbered(x))), "")


def clean(c: Column) -> Column:
    """Folded alefs, no tatweel, private-use or zero-width characters, trimmed lines, single blanks.

    Lines of brackets, dashes, slashes, underscores, points and Arabic commas alone are dropped.
    """
    c = arabize_list_numbers(F.regexp_replace(fold_alef(c), r"[\u0640\uf000-\uf0ff]", ""))
    kept = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: (x != "") & ~x.rlike(rf"^[()\[\]{{}}{SPACE}\-_/\\.،؛]+$"))
    return strip(F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"[ \t]{2,}", " "), ZERO_WIDTH, ""))


def clean_inline(c: Column, shapes: Mapping[str, str] = lex.SHAPES) -> Column:
    """One line: blanks squeezed, rules of dashes or underscores and zero-width characters out, shaped letters plain."""
    c = F.regexp_replace(F.regexp_replace(c, f"[{SPACE}]+", " "), r"[-_]{3,}", "")
    for shape, plain in shapes.items():
        c = F.replace(c, F.lit(shape), F.lit(plain))
    return strip(F.regexp_replace(c, ZERO_WIDTH, ""))


def join_broken_lines(c: Column) -> Column:
    """Lines of a block joined by blanks; a one- or two-letter Arabic end joins an Arabic next line without.

    A line that was joined so doesn't join the one after it.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("glue"), F.lit(False).alias("used"))

    def step(s: Column, x: Column) -> Column:
        glued = s["glue"] & x.rlike(rf"^[{ARABIC}]")
        short = ~glued & x.rlike(rf"(?:^|[{SPACE}])[{ARABIC}]{{1,2}}$")
        text = F.when(~s["used"], x).when(glued, F.concat(s["text"], x)).otherwise(F.concat_ws(" ", s["text"], x))
        return F.struct(text.alias("text"), short.alias("glue"), F.lit(True).alias("used"))

    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    return F.aggregate(lines, start, step, lambda s: s["text"])


def normalize_dialect(c: Column, rules: Mapping[str, str] = lex.DIALECT) -> Column:
    """Whole-word replacements one after the other, so that a result may meet a later rule."""
    for word, plain in rules.items():
        c = F.regexp_replace(c, java(rf"\b{word}\b"), plain)
    return c


def language(c: Column) -> Column:
    """ar or en by the counts of letters; Arabic where they are equal or there are none.

    Where Latin letters prevail this says en; a statistical detector is out of reach offline.
    """
    ar, en = n_matches(c, ARABIC_WIDE), n_matches(c, "A-Za-z")
    return F.when((en > ar), "en").otherwise("ar")


def chunk_language(c: Column) -> Column:
    ar, en = n_matches(c, ARABIC), n_matches(c, "A-Za-z")
    return F.when(ar > en, "ar").when(en > ar, "en").otherwise("mixed")


def display_language(c: Column) -> Column:
    return F.when(n_matches(c, ARABIC) > 0.2 * F.length(c), "ar").otherwise("en")


def occurs(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs; one of letters, digits and blanks alone is looked for as it is."""
    return c.contains(pattern) if all(x.isalnum() or x == " " for x in pattern) else c.rlike(pattern)


def section(c: Column, sections: Mapping[str, Sequence[str]] = lex.SECTIONS, fold: bool = True) -> Column:
    """The section most of whose patterns occur; the first of equal ones, ``general`` without any."""
    low = F.lower(c)
    scores = {}
    for name, patterns in sections.items():
        shaped = [p.translate(str.maketrans("أإآٱ", "اااا")) if fold else p for p in patterns]
        scores[name] = reduce(lambda a, b: a + b, [occurs(low, p).cast("int") for p in shaped], F.lit(0))
    best, out = F.greatest(*scores.values()), F.when(F.lit(False), F.lit(""))
    for name, score in scores.items():
        out = out.when((best > 0) & (score == best), name)
    return out.otherwise("general")


def chunk_type(c: Column, kind: Column) -> Column:
    amount = r"\p{Nd}+\s*(ألف|الف|جنيه|دولار|%)"
    return F.when(kind == "table", "table_row").when(c.rlike(r"(?m)^(س:|ج:)") | c.rlike(r"(?mi)^(Q:|A:)"), "faq").when(c.rlike(amount), "numeric_data").otherwise("paragraph")


def has_url(c: Column) -> Column:
    return c.contains("http")


def sentences(c: Column) -> Column:
    """Sentences of more than five characters."""
    parts = F.split(c, rf"(?<=[.!?؟])[{SPACE}]+|(?<=[{ARABIC}])\n|\n{{2,}}")
    return F.filter(F.transform(parts, strip), lambda x: F.length(x) > 5)


def tail_words(c: Column, n: int) -> Column:
    """The last n words; a text of no more than those as it is."""
    return let(words(c), lambda w: F.when(F.size(w) > n, F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n), " ")).otherwise(strip(c)))


def with_heading(body: Column, heading: Column) -> Column:
    absent = heading.isNotNull() & (heading != "") & ~body.contains(heading)
    return F.when(absent, F.concat_ws("\n", heading, body)).otherwise(body)


def row_title(c: Column) -> Column:
    """What precedes the title's dash."""
    return strip(F.substring_index(c, " — ", 1))


def document_label(name: Column, labels: Sequence = lex.LABELS) -> Column:
    low, out = F.lower(name), F.when(F.lit(False), F.lit(""))
    for marks, label in labels:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(x) for x in marks]), label)
    return out.otherwise(F.replace(name, F.lit("_"), F.lit(" ")))


def urls(c: Column) -> Column:
    """Addresses in a text; those that begin with www get a scheme."""
    stop = rf"[^{SPACE}{ARABIC}»«)\]}}]+"
    found = F.regexp_extract_all(c, F.lit(rf"(https?://{stop}|www\.{stop})"), 1)
    return F.transform(found, lambda u: F.when(u.startswith("www."), F.concat(F.lit("https://"), u)).otherwise(u))


def cache_key(query: Column, context: Column) -> Column:
    return F.md5(F.concat_ws("||", query, F.substring(context, 1, 200)))


def without_thoughts(c: Column) -> Column:
    """Without tagged thinking, trimmed."""
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def cosine(a: Column, b: Column) -> Column:
    """The dot product in double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
