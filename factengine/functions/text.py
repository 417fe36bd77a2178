"""Text helpers as column expressions; regular expressions follow the ASCII word and wide white-space conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, no-break and ideographic spaces and the byte-order mark included; Java's own class has only ASCII ones.
SPACES = r"\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = f"[{SPACES}]"
#: The same, character by character.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Word boundaries over ASCII letters, digits and the underscore.
START, STOP = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Words that carry no meaning of a claim.
STOPWORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "from", "by", "with", "and", "or", "as", "is", "are", "was", "were", "be", "been", "its", "their", "our", "this", "that", "following")


def word(pattern: str) -> str:
    """A case-blind pattern that matches whole words only."""
    return f"(?i){START}(?:{pattern}){STOP}"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value bound once; a plain Column would be copied into every place that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clean(text: Column) -> Column:
    """No-break spaces become plain ones; trimmed."""
    return strip(F.translate(text, "\u00a0\u202f", "  "))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; trimmed."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def filled(text: Column) -> Column:
    """Whether a text is neither null nor blank."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def comparable(text: Column) -> Column:
    """Lower case, letters and digits only, words one space apart."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def same_text(a: Column, b: Column) -> Column:
    """Equality without regard to case and outer white space; null counts as empty."""
    plain = lambda x: F.lower(strip(F.coalesce(x, F.lit(""))))
    return plain(a) == plain(b)


def stem(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & token.endswith("ss"), token)
        .when((n > 3) & token.endswith("s"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def tokens(text: Column) -> Column:
    """The set of stems of a text's words, without stopwords; null gives an empty set."""
    words = F.split(comparable(F.coalesce(text, F.lit(""))), " ")
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 0) & ~w.isin(*STOPWORDS)), stem))


def token_affinity(a: Column, b: Column) -> Column:
    """Overlap of two token sets: the larger of Jaccard and three quarters of containment; 0 without overlap."""
    def measured(n: Column) -> Column:
        jaccard = n["shared"] / (n["a"] + n["b"] - n["shared"])
        contained = F.lit(0.75) * n["shared"] / F.least(n["a"], n["b"])
        return F.when(n["shared"] > 0, F.greatest(jaccard, contained)).otherwise(F.lit(0.0))

    return let(F.struct(F.size(a).alias("a"), F.size(b).alias("b"), F.size(F.array_intersect(a, b)).alias("shared")), measured)


def affinity(a: Column, b: Column) -> Column:
    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), lambda t: token_affinity(t["a"], t["b"]))


def pair_key(a: Column, b: Column) -> Column:
    """One key for both directions of a pair."""
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def chunk_number(position: Column, size: int) -> Column:
    """Number from 0 of the chunk that a position from 1 falls into."""
    return F.floor((position - 1) / size).cast("int")


def prettify(label: Column) -> Column:
    return F.replace(label, F.lit("_"), F.lit(" "))


def clamp_limit(value: float | None, default: int = 50, most: int = 500) -> int:
    """A page size: truncated to 1..``most``; the default if it is missing or not finite."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return default
    return max(1, min(most, int(value)))


def clamp_offset(value: float | None) -> int:
    return 0 if value is None or value != value or value in (float("inf"), float("-inf")) else max(0, int(value))
