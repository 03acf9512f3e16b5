"""A light suffix stemmer, as an expression: plural and common endings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings tried in order, with what stands in their place.
ENDINGS = [("acoes", "acao"), ("icoes", "icao"), ("oes", "ao"), ("ais", "al"), ("eis", "el"), ("mente", ""), ("ies", "y"), ("ing", ""), ("es", "e"), ("s", "")]


def stem(token: Column, least: int = 3) -> Column:
    """The first ending that fits and leaves at least `least` letters goes."""
    out = token
    for end, new in reversed(ENDINGS):
        fits = token.endswith(end) & (F.length(token) - len(end) + len(new) >= least)
        out = F.when(fits, F.concat(F.substring(token, F.lit(1), F.length(token) - len(end)), F.lit(new))).otherwise(out)
    return out


def analysed(tokens: Column, stop: list[str], synonyms: dict[str, str]) -> Column:
    """Tokens without stop words, stemmed, with synonyms replaced."""
    kept = F.filter(tokens, lambda t: ~t.isin(stop))
    known = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]) if synonyms else None
    stems = F.transform(kept, lambda t: stem(t))  # transform would give a second parameter the index
    return F.transform(stems, lambda t: F.coalesce(F.element_at(known, t), t)) if synonyms else stems
