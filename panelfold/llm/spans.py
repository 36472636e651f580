"""Spans of regular expressions in whole texts, with DataFrame functions only.

A span is a struct (start, kind, end, shown): code points, end exclusive, ``kind`` the
place of its name in a list, ``shown`` its text, ``before`` up to 40 characters ahead.
"""

from pyspark.sql import Column, functions as F

BLOCK = 256  # positions are summed in blocks, so a text of many matches stays linear
CONTEXT = 40
SPANS = "array<struct<start:int,kind:int,end:int,shown:string,before:string>>"


def _starts(gaps: Column, matches: Column) -> Column:
    """Start of each match from the lengths of gaps and matches before it."""
    size = F.size(matches)
    lengths = F.zip_with(F.slice(gaps, 1, size), matches,
                         lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    last = F.greatest(F.floor((size - 1) / F.lit(BLOCK)).cast("int"), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))

    def total(part):
        return F.aggregate(part, F.lit(0), lambda a, x: a + x["g"] + x["m"])

    sums = F.transform(blocks, total)
    nested = F.transform(blocks, lambda part, b: F.transform(part, lambda x, k: F.aggregate(
        F.slice(sums, 1, b), F.lit(0), lambda a, s: a + s) + total(F.slice(part, 1, k)) + x["g"]))
    return F.flatten(nested)


def find(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """All matches, left to right without overlap, of which ``keep`` (a function of the
    matched text) holds; an empty array where nothing matches."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(_starts(gaps, matches).alias("s"), matches.alias("m"),
                        F.slice(gaps, 1, F.size(matches)).alias("g"))
    found = F.transform(rows, lambda r: F.struct(
        r["s"].alias("start"), F.lit(kind).alias("kind"), (r["s"] + F.length(r["m"])).alias("end"),
        r["m"].alias("shown"), F.substring(r["g"], -CONTEXT, CONTEXT).alias("before")))
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["shown"]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def placed(*parts: Column) -> Column:
    """Spans of several kinds by start, then kind, without their texts."""
    joined = F.concat(*[F.transform(p, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))) for p in parts])
    return F.array_sort(joined)


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column, kinds: list[str]) -> Column:
    return F.sha2(listed(spans, kinds), 256)


def count(spans: Column) -> Column:
    return F.size(spans).cast("bigint")
