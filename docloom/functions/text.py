"""Text functions as column expressions (no Python on the rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the letters they fold to.
MARKED = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

#: Short function words of English, German, French and Spanish.
STOP = sorted(set("the a an of and to in is for on with by be this that it at or from are was der die das dem und ein eine mit von zu ist im nicht le la les des et en un une que dans pour pas est el los las y del al por con una de".split()))


def fold(x: Column) -> Column:
    """Lower case without accents; plain texts are not translated."""
    low = F.lower(x)
    return F.when(low.rlike(f"[{MARKED}]"), F.translate(low, MARKED, PLAIN)).otherwise(low)


def tokens(x: Column) -> Column:
    """Runs of letters a-z and digits, folded. Cutting a text between them is
    several times faster than extracting each."""
    return F.array_remove(F.split(fold(x), "[^a-z0-9]+"), "")


def n_tokens(x: Column) -> Column:
    """How many tokens there are; null of a null."""
    return F.regexp_count(fold(x), F.lit("[a-z0-9]+"))


def content_tokens(x: Column) -> Column:
    """Distinct tokens in order, without stop words."""
    return F.array_except(tokens(x), F.array(*map(F.lit, STOP)))


def collapse(x: Column) -> Column:
    """Runs of white space as one space; single spaces, the most of them, are
    not replaced."""
    return F.trim(F.regexp_replace(x, r"[^\S ]\s*| \s+", " "))


def strip_tags(x: Column) -> Column:
    return collapse(F.regexp_replace(x, "<[^>]+>", " "))


def sentences(x: Column) -> Column:
    return F.split(x, r"(?<=[.!?])\s+")


def truncate(x: Column, n: int) -> Column:
    return F.rtrim(F.substring(x, 1, n))


def without_repeats(words: Column) -> Column:
    """Drop each word that equals the one before it."""
    return F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1)))


def summary_cut(x: Column, limit: int = 320) -> Column:
    """Cut at the last sentence end within the limit if it is not too early;
    else at one shortly after; else at the last space; else hard."""
    head = F.substring(x, 1, limit)
    ahead = F.substring(x, 1, limit + 120)
    back = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?;:])", 1))
    forward = F.length(F.regexp_extract(ahead, rf"(?s)^(.{{{limit}}}[^.!?;:]*[.!?;:])", 1))
    space = F.length(F.regexp_extract(head, r"(?s)^(.*)\s", 1))
    cut = F.when(back >= max(15, limit // 4), back).when(forward > 0, forward).when(space > 0, space).otherwise(F.lit(limit))
    return F.when(F.length(x) <= limit, x).otherwise(F.rtrim(F.substring(x, F.lit(1), cut)))


def joined_hash(*parts: Column) -> Column:
    """sha256 of the lower-cased parts joined by |, nulls as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.lower(p.cast("string")), F.lit("")) for p in parts]), 256)


def parsed_date(x: Column, *formats: str) -> Column:
    """The first format that fits, null if none does."""
    return F.coalesce(*[F.try_to_date(x, f) for f in formats])


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is of length zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot / (na * nb))


#: Letters that have one capital, but are written out as several in capitals.
SMALL = "ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ"
CAPITAL = "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ"


def capital(x: Column) -> Column:
    """A letter in upper case as one letter (ß as ẞ, where upper() has SS)."""
    up = F.upper(x)
    return F.when(F.char_length(up) > F.char_length(x), F.translate(x, SMALL, CAPITAL)).otherwise(up)


def unit(x: Column) -> Column:
    """Clamp to 0..1, four decimals."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)
