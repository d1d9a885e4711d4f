"""Questions as text columns: reduced to their shape, and hashed into vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no intent, the vector's length, the weights of a word and of three characters in a row, and places to a group.
FILLER = ("the", "a", "an", "is", "are", "was", "were", "do", "does", "did", "please", "can", "you", "me", "us", "our", "my", "i", "we", "of", "for", "to", "on")
DIM, WORD_WEIGHT, GRAM_WEIGHT, STEP = 512, 1.0, 0.5, 16
_MACHINE, _PUNCTUATION, _NUMBER = "\\b[lmh]-?[0-9]{2}\\b", "[^a-z0-9<>. ]+", "(?<![a-z<])[0-9]+(?:\\.[0-9]+)?"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: a column that stands inside a lambda is worked out anew for every element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def normalise(c: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Lower case, machines and numbers as placeholders, synonyms by one name (the longest first), filler words gone."""
    t = F.lower(F.trim(c))
    t = F.regexp_replace(t, _MACHINE, "<machine>")
    t = F.regexp_replace(F.regexp_replace(t, _PUNCTUATION, " "), _NUMBER, "<n>")
    for phrase, name in sorted((synonyms or {}).items(), key=lambda x: (-len(x[0]), x[0])):
        if len(phrase) >= 3:
            t = F.regexp_replace(t, "\\b" + phrase.replace(".", "\\.") + "\\b", name)
    words = F.filter(F.split(F.regexp_replace(t, "[. ]+", " "), " "), lambda w: (w != "") & ~w.isin(*FILLER))
    return F.array_join(words, " ")


def embedding(normal: Column, dim: int = DIM) -> Column:
    """A unit vector of hashed words and three-character stretches; the same everywhere, as CRC-32 is. All zeros for no text.

    Text, places, sums and length are each worked out once a row, and places are dealt into groups of STEP neighbouring ones
    before they are added up, so a row's work is in proportion to its text.
    """
    return once(normal, lambda text: F.when(F.length(text) > 0, _unit_vector(text, dim)).otherwise(F.array_repeat(F.lit(0.0), dim)))


def _unit_vector(text: Column, dim: int) -> Column:
    at = lambda kind, x: (F.crc32(F.concat(F.lit(kind), x).cast("binary")) % dim).cast("int")
    place = lambda kind, x, w: F.struct(at(kind, x).alias("at"), F.lit(w).alias("w"))
    words = F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: place("w:", w, WORD_WEIGHT))
    stretches = lambda padded: F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: place("c:", F.substring(padded, i, F.lit(3)), GRAM_WEIGHT))
    grams = once(F.concat(F.lit("  "), text, F.lit("  ")), stretches)
    weight = lambda part, i: F.aggregate(part, F.lit(0.0), lambda a, s: F.when(s["at"] == i, a + s["w"]).otherwise(a))
    group = lambda part, b: F.transform(F.sequence(b, F.least(b + (STEP - 1), F.lit(dim - 1))), lambda i: weight(part, i))
    total = lambda places: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dim - 1), F.lit(STEP)), lambda b: once(F.filter(places, lambda s: F.floor(s["at"] / STEP) * STEP == b), lambda part: group(part, b))))
    scaled = lambda v: once(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda length: F.transform(v, lambda x: x / length))
    return once(F.concat(words, grams), lambda places: once(total(places), scaled))
