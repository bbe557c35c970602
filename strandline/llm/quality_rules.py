"""Quality rules with thresholds adapted to each language and source.

Fixed cutoffs suit one corpus; here the bulk of each (language, source) group
says what is usual in it. Each per-document rate goes into a quantile sketch
of its group: a histogram over integer cells that are exact up to 255 and
keep a relative error of 1/128 above, so that sketches of partitions, groups
and levels merge by adding counts, whatever the order. From a sketch come
quartiles and from these an outer fence, ``WIDTH`` interquartile ranges
outside them; a document beyond a fence is rejected. There is no other
threshold. The fences are joined back to the documents.

A group's quartiles are averaged with those of its language, which count as
``WEIGHT`` documents, and a language's with those of the whole corpus (the
finer sketches merged), so a small group's chance quartiles have little say
and verdicts change smoothly with its size.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.batches import map_texts
from strandline.llm.shared import stored
from strandline.llm.textkit import covered, window_hashes, word_hashes

#: Symbols that prose seldom holds, and all ASCII punctuation.
SYMBOLS = b"#*$%&|<>"
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
WINDOW = 8


class Rate(NamedTuple):
    """floor(scale * numerator / denominator) of two of BASE. ``sparse``: most
    documents have none, and the sketch and its upper fence are of those that
    have some."""

    numerator: str
    denominator: str
    scale: int
    sparse: bool


RATES = {
    "word_length": Rate("word_chars", "n_words", 100, False),
    "marks": Rate("n_marks", "word_chars", 1000, False),
    "dup_lines": Rate("n_dup_lines", "n_lines", 1000, True),
    "repeats": Rate("n_repeat_words", "n_words", 1000, True),
}
#: Interquartile ranges from a quartile to its fence: the usual outer fences.
WIDTH = 3
#: Documents as many as which a coarser group's quartiles count.
WEIGHT = 200
#: Bits of a cell, the leading one included.
CELL_BITS = 8


def _measure():
    def of(data: bytes) -> tuple:
        words = word_hashes(data)
        n = len(words)
        spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
        continuing = len(data) - len(data.decode())
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        seen, duplicate, lines = set(), 0, 0
        for line in data.split(b"\n"):
            if line.strip(b" \t\n\x0b\x0c\r"):
                lines += 1
                if line in seen:
                    duplicate += 1
                else:
                    seen.add(line)
        repeated = 0
        if n > WINDOW:
            windows = window_hashes(words, WINDOW)
            order = np.argsort(windows, kind="stable")
            ranked = windows[order]
            same = ranked[1:] == ranked[:-1]
            if same.any():
                hit = np.zeros(len(windows), dtype=bool)
                hit[order[1:][same]] = True
                hit[order[:-1][same]] = True
                repeated = int(covered(np.flatnonzero(hit), WINDOW, n).sum())
        return n, len(data) - spaces - continuing, symbols, duplicate, repeated, lines, len(data) - len(data.translate(None, MARKS))

    return of


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks"]


def measures(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per document its keys and counts of words, characters, lines and repeats.

    Null texts are empty; an empty text has no words and no lines. Texts may
    be of any length (they are hashed in pieces) and rows may repeat. Key
    columns named as one of BASE are not taken, as the counts have the name.
    """
    return map_texts(docs, [k for k in keys if k not in BASE], text, _measure, [(n, pa.int64(), "bigint") for n in BASE])


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)


def cell(value: Column) -> Column:
    """Sketch cell of a non-negative integer: the lower end of its range.

    Below 2**CELL_BITS each integer has its own cell; above, CELL_BITS bits
    from the leading one are kept.
    """
    unit = F.pow(F.lit(2.0), F.length(F.bin(value)) - F.lit(CELL_BITS)).cast("long")
    return F.when(value < 1 << CELL_BITS, value).otherwise(F.floor(value / unit).cast("long") * unit)


def _cell_of(rate: Rate) -> Column:
    """The rate's cell; null where it has no value, or is sparse and zero."""
    value = F.expr(f"({rate.scale} * {rate.numerator}) div nullif({rate.denominator}, 0)")
    return cell(F.when(value > 0, value) if rate.sparse else value)


def sketches(counts: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., rate, cell, n): mergeable sketches, one row per used cell."""
    rates = F.array(*[F.struct(F.lit(k).alias("rate"), _cell_of(r).alias("cell")) for k, r in RATES.items()])
    cells = counts.select(*groups, F.explode(rates).alias("x")).filter("x.cell is not null")
    return cells.groupBy(*groups, "x.rate", "x.cell").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "rate", "cell").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., rate, n, q1, q3): the least cell with a quarter, or three,
    of the rows at or below it."""
    w = Window.partitionBy(*groups, "rate")
    ranked = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("cell")), "rows": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("rows"), F.col("cell")))
    return ranked.groupBy(*groups, "rate").agg(F.max("rows").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def limits(sketch: DataFrame, width: int = WIDTH, weight: int = WEIGHT) -> DataFrame:
    """(_lang, _source, and <rate>_low and <rate>_high): a row for each group
    of the sketch (_lang, _source, rate, cell, n); null where the corpus has
    no value of a rate."""
    levels = F.array(F.struct("_lang", "_source"), F.struct("_lang", F.lit(None).cast("string").alias("_source")), F.struct(F.lit(None).cast("string").alias("_lang"), F.lit(None).cast("string").alias("_source")))
    every = sketch.select(F.explode(levels).alias("g"), "rate", "cell", "n").select("g.*", "rate", "cell", "n")
    found = stored(quartiles(merged(every, ["_lang", "_source"]), ["_lang", "_source"]), "quality-quartiles")
    whole = found.filter("_lang is null").select("rate", F.col("q1").alias("q1_2"), F.col("q3").alias("q3_2"))
    langs = found.filter("_lang is not null and _source is null").select("_lang", "rate", *[F.col(c).alias(f"{c}_1") for c in ("n", "q1", "q3")])
    own = found.filter("_source is not null").select("_lang", "_source", "rate", *[F.col(c).alias(f"{c}_0") for c in ("n", "q1", "q3")])
    # every rate of every group, also where none of its documents has it
    groups = found.filter("_source is not null").select("_lang", "_source").distinct().select("*", F.explode(F.array(*map(F.lit, RATES))).alias("rate"))
    rows = groups.join(own, ["_lang", "_source", "rate"], "left").join(langs, ["_lang", "rate"], "left").join(whole, "rate", "left")
    blend = lambda n, q, parent: F.expr(f"(coalesce({n} * {q}, 0) + {weight} * {parent}) div (coalesce({n}, 0) + {weight})")
    for q in ("q1", "q3"):
        rows = rows.withColumn(q, blend("n_1", f"{q}_1", f"{q}_2")).withColumn(q, blend("n_0", f"{q}_0", q))
    reach = width * (F.col("q3") - F.col("q1"))
    rows = rows.select("_lang", "_source", "rate", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    picked = lambda rate, side: F.max(F.when(F.col("rate") == rate, F.col(side))).alias(f"{rate}_{side}")
    return rows.groupBy("_lang", "_source").agg(*[picked(r, s) for r in RATES for s in ("low", "high")])


def judge(counts: DataFrame, lang: str = "lang", source: str = "source", width: int = WIDTH, weight: int = WEIGHT) -> DataFrame:
    """``counts`` with base_failed and kept.

    Documents that fail the base rules take no part in the sketches. Null
    languages and sources are groups of their own. Equal rows are judged
    alike. An empty table gives an empty table. Columns of ``counts`` named
    base_failed or kept are replaced, and so are those of the working names
    (_lang, _source and <rate>_low, <rate>_high).
    """
    sides = [f"{r}_{s}" for r in RATES for s in ("low", "high")]
    counts = counts.drop("base_failed", "kept", "_lang", "_source", *sides)
    groups = F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("")).alias("_lang"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_source")
    rows = counts.select("*", *groups).withColumn("base_failed", base_failed())
    fine = stored(sketches(rows.filter(~F.col("base_failed")), ["_lang", "_source"]), "quality-sketches")
    # written down: Spark broadcasts a small table, by its size, or splits the rows of a source with most of the documents
    fences = stored(limits(fine, width, weight), "quality-limits")
    inside = F.lit(True)
    for name, rate in RATES.items():
        value = _cell_of(rate)
        fits = value <= F.col(f"{name}_high")
        if not rate.sparse:
            fits = fits & (value >= F.col(f"{name}_low"))
        inside = inside & F.coalesce(fits, F.lit(True))
    judged = rows.join(fences, ["_lang", "_source"], "left")
    return judged.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(inside)).drop("_lang", "_source", *sides)
