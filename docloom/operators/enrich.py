"""Rule-based enrichment: spans, tags, topics, chunks by boundary, gates."""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import fold


def topics(text: Column, rules: dict[str, tuple[list[str], list[str]]], most: int = 3, otherwise: str = "other") -> Column:
    """Topics, at most `most`, in rule order: one holds if any of its words
    occurs in the folded text and none of its negative words does."""
    t = fold(text)

    def some(words: list[str]) -> Column:
        c = F.lit(False)
        for w in words:
            c = c | t.contains(w)
        return c

    found = F.array_compact(F.array(*[F.when(some(yes) & ~some(no), F.lit(name)) for name, (yes, no) in rules.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(otherwise))).otherwise(F.slice(found, 1, most))


SPANS = "array<struct<tag:string,start:int,end:int>>"


def found(texts: list[str | None], patterns: dict[str, re.Pattern], overlap: bool) -> pa.Array:
    """The spans of each text, laid out flat: a place and a number each, no
    object but for the text at hand."""
    tags, starts, ends, offsets = array("b"), array("i"), array("i"), array("i", [0])
    for x in texts:
        hits = sorted((m.start(), tag, m.end()) for tag, p in enumerate(patterns.values()) for m in p.finditer(x or "") if m.end() > m.start())
        last = 0
        for a, tag, b in hits:
            if overlap or a >= last:
                tags.append(tag)
                starts.append(a)
                ends.append(b)
                last = b
        offsets.append(len(starts))
    flat = lambda a, kind: pa.Array.from_buffers(kind, len(a), [None, pa.py_buffer(a)])
    names = pa.DictionaryArray.from_arrays(flat(tags, pa.int8()), pa.array(list(patterns), pa.string())).cast(pa.string())
    each = pa.StructArray.from_arrays([names, flat(starts, pa.int32()), flat(ends, pa.int32())], ["tag", "start", "end"])
    return pa.ListArray.from_arrays(flat(offsets, pa.int32()), each)


def spans(text: Column, patterns: dict[str, str], overlap: bool = True) -> Column:
    """array<struct<tag,start,end>> of all matches of each pattern (of Python's
    re; empty matches do not count), by start, then tag. Without overlap: those
    that start at or after the end of the last one kept."""
    compiled = {tag: re.compile(patterns[tag]) for tag in sorted(patterns)}

    @F.arrow_udf(SPANS)
    def of(texts: pa.Array) -> pa.Array:
        return found(texts.to_pylist(), compiled, overlap)

    return of(text)


def without_overlap(s: Column) -> Column:
    """Keep each span that starts at or after the end of the last one kept."""

    @F.arrow_udf(SPANS)
    def kept(lists: pa.Array) -> pa.Array:
        flat, offsets, places = lists.flatten(), [0], array("i")
        starts, ends, at = flat.field("start").to_numpy(), flat.field("end").to_numpy(), 0
        for n in pc.fill_null(pc.list_value_length(lists), 0).to_pylist():
            last = 0
            for i in range(at, at + n):
                if starts[i] >= last:
                    places.append(i)
                    last = ends[i]
            at += n
            offsets.append(len(places))
        mask = lists.is_null() if lists.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.take(pa.array(places, pa.int32())), mask=mask)

    return kept(s)


def tagged(sections: list[tuple[str, Column]]) -> Column:
    """<tag>text</tag> lines of the sections that are not empty, escaped."""

    def escape(x: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    return F.concat_ws("\n", *[F.when(F.length(F.trim(x)) > 0, F.concat(F.lit(f"<{tag}>"), escape(x), F.lit(f"</{tag}>"))) for tag, x in sections])


def section_map(xml: Column) -> Column:
    """map<tag, struct<start,len>> of the sections of a tagged text."""
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<([a-z_]+)>.*?</\1>"), 0)
    located = F.transform(found, lambda s: F.struct(F.regexp_extract(s, "<([a-z_]+)>", 1).alias("k"), F.struct((F.instr(xml, s) - 1).alias("start"), F.length(s).alias("len")).alias("v")))
    return F.map_from_entries(located)


def split_at(docs: DataFrame, id_col: str, text_col: str, boundary: str, least: int = 50) -> DataFrame:
    """(id, seq, part): a text cut before each match of the boundary pattern;
    parts shorter than `least` are dropped, a text without match is one part."""
    parts = F.filter(F.split(F.col(text_col), f"(?={boundary})"), lambda x: F.length(F.trim(x)) >= least)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("seq", "part"))


def first_true(cases: list[tuple[Column, str, float]], otherwise: tuple[str, float]) -> Column:
    """struct<label, confidence> of the first case that holds."""
    out = F.struct(F.lit(otherwise[0]).alias("label"), F.lit(otherwise[1]).alias("confidence"))
    for c, label, confidence in reversed(cases):
        out = F.when(c, F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out
