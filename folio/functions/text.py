"""Column expressions over texts. All run in the JVM; patterns and word lists are arguments.

Positions count code points from 0. Words, sentences and paragraphs are arrays of strings.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the Russian defaults, and of any Latin or Cyrillic text.
RUSSIAN_WORD = r"(?U)\b[а-яёa-z]+\b"
LETTERS = r"\p{L}+"
#: Vowel runs count as syllables.
RUSSIAN_VOWELS = "[аеёиоуыэюя]+"
LATIN_VOWELS = "[aeiouyàâäáéèêëíîïóôöúùûüœæãõ]+"


#: What Python's split() takes for white space: a run of anything else as a pattern, and all characters of it.
TOKEN = r"(?U)[^\s\x1C-\x1F]+"
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once, however often it is used inside folds and branches."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def free(df, *names: str) -> list[str]:
    """Names that no column of `df` has, nor any other of them: these, with as many underscores before as that takes."""
    taken = {c.lower() for c in df.columns}
    under = next("_" * n for n in range(1, len(taken) + 3) if not any("_" * n + x in taken for x in names))
    return [under + x for x in names]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(BLANKS))


def pieces(c: Column, pattern: str) -> Column:
    """The stripped, non-empty parts between matches."""
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    return pieces(c, r"[.!?]+")


def paragraphs(c: Column, separator: str = "\n\n") -> Column:
    return pieces(c, separator.replace("\n", "\\n"))


def tokens(c: Column) -> Column:
    """Parts between white space, punctuation attached."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def tokens_at_blanks(c: Column) -> Column:
    """tokens(), cut at white space; that is quicker where most of a text is tokens."""
    return F.filter(F.split(strip(c), r"(?U)[\s\x1C-\x1F]+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    """Each part becomes one character, with the white space after it, so that none of them has to be made."""
    return F.length(F.regexp_replace(F.ltrim(c, F.lit(BLANKS)), r"(?U)[^\s\x1C-\x1F]++[\s\x1C-\x1F]*+", "x"))


def words(c: Column, pattern: str = LETTERS) -> Column:
    """Matches of a word pattern in the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def count_sub(text: Column, key) -> Column:
    """Non-overlapping occurrences of a substring."""
    key = F.lit(key) if isinstance(key, str) else key
    return (F.length(text) - F.length(F.replace(text, key, F.lit("")))) / F.length(key)


def word_list(keys: Sequence[str]) -> Column:
    return F.array(*(F.lit(k) for k in keys)) if keys else F.array().cast("array<string>")


def count_any(text: Column, keys: Sequence[str]) -> Column:
    """Sum of count_sub() over a word list; keys may overlap, and each counts on its own. One fold, however long the list,
    over the keys that are there at all. Null text: null."""

    def of(low: Column) -> Column:
        there = F.filter(word_list(keys), lambda k: F.contains(low, k))
        return F.when(low.isNotNull(), F.aggregate(there, F.lit(0.0), lambda a, k: a + count_sub(low, k)))

    return let(text, of)


def contains_any(text: Column, keys: Sequence[str]) -> Column:
    return let(text, lambda low: F.exists(word_list(keys), lambda k: low.contains(k)))


def count_in(array: Column, keys: Sequence[str]) -> Column:
    """How many elements are in a word list."""
    listed = word_list(keys)
    return F.size(F.filter(array, lambda w: F.array_contains(listed, w)))


def total(array: Column, value=lambda x: x) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + value(x))


def mean(array: Column, value=lambda x: x) -> Column:
    """0 for an empty array."""
    return let(array, lambda a: total(a, value) / F.greatest(F.size(a), F.lit(1)))


def variance(array: Column) -> Column:
    """Population variance of an array of numbers, in one fold; 0 for an empty one."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(a, x):
        n = a["n"] + 1
        d = x - a["m"]
        m = a["m"] + d / n
        return F.struct(n.alias("n"), m.alias("m"), (a["s"] + d * (x - m)).alias("s"))

    return F.aggregate(array, start, step, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1)"""
    return a / F.greatest(b, F.lit(1))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def syllables(word: Column, vowels: str = RUSSIAN_VOWELS) -> Column:
    return F.greatest(F.regexp_count(word, F.lit(vowels)), F.lit(1))


def ladder(c: Column, steps: Sequence[tuple[float, str]], top: str) -> Column:
    """The name of the first step whose bound is above the value; null for null."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for bound, name in steps:
        out = out.when(c < bound, name)
    return out.otherwise(top)


def weighted(metrics: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """Sum of metric * weight and of abs(weight), over the metrics that are there."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, weight in weights.items():
        top += F.coalesce(metrics[name] * weight, F.lit(0.0))
        bottom += F.when(metrics[name].isNotNull(), abs(weight)).otherwise(0.0)
    return top, bottom


def summary(c: Column, size: int = 200) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def duration(seconds: Column) -> Column:
    """`1h 2m 3s`; hours and minutes only where there are any."""
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.concat_ws(" ", F.when(h > 0, F.concat(h, F.lit("h"))), F.when((m > 0) | (h > 0), F.concat(m, F.lit("m"))), F.concat(s % 60, F.lit("s")))


# The words of shown numbers and times.


def abbreviated(n: Column) -> Column:
    """Thousands and millions with one decimal."""
    short = lambda size, name: F.concat(F.format_string("%.1f", F.round(n / size, 1)), F.lit(name))
    return F.when(n >= 1_000_000, short(1_000_000, " млн")).when(n >= 1_000, short(1_000, " тыс")).otherwise(n.cast("string"))


def ago(then: Column, now: Column) -> Column:
    """How long ago in minutes, hours or days; the date from a week on."""
    s = now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")
    whole = lambda unit, name: F.concat(F.floor(s / unit).cast("string"), F.lit(name))
    return F.when(s < 60, "только что").when(s < 3600, whole(60, " мин назад")).when(s < 86_400, whole(3600, " ч назад")).when(s < 604_800, whole(86_400, " д назад")).otherwise(F.date_format(then, "dd.MM.yyyy"))
