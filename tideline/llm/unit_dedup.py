"""Removal of repeated lines and sentences across documents by hashing normalised units.

A text is cut without loss into sentences (up to and with their closing marks or line end and the white space after); a line is
a run of sentences. Sentences of at least `min_words` words are units, and so is a line of that length that holds a shorter
sentence (else its sentences say it all). A unit is normalised (lower case, single blanks) and hashed to 128 bits. Over all
documents the earliest occurrence by (doc_id, place) of each digest stays; every other one is cut. Spans keep the original
offsets in code points.

Digests are counted with map-side combine, so a unit that a third of all documents share is one row a task; only digests that
occur more than once are joined back, an equi-join whose hot side Spark can split.

Defined results: a null text stays null and an empty one stays empty; a text cut to nothing is empty, and its row stays; null
doc_id ranks last; rows with the same doc_id and text are one document, cut alike; rows with the same doc_id and other texts are
ranked by text hash; an empty table gives an empty result; other columns are kept, those named `_cut_*` are the operator's own and given ones named removed_spans or removed_chars are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import only, slices, stage, text_of, texts

MIN_WORDS = 8
#: A sentence: what comes before closing marks or a line end, these, and the white space after; or the rest of the text.
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+")


def units(text: str, min_words: int = MIN_WORDS):
    """(normalised unit, start, end) of every unit of a text; lines come after their sentences."""
    line, line_start, short = [], 0, False
    for m in SENTENCE.finditer(text):
        words = m.group().lower().split()
        if len(words) >= min_words:
            yield " ".join(words), m.start(), m.end()
        elif words:
            short = True
        line += words
        if "\n" in m.group() or m.end() == len(text):
            if short and len(line) >= min_words:
                yield " ".join(line), line_start, m.end()
            line, line_start, short = [], m.end(), False


def digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, _cut_text, high, low, start, end) of every unit; _cut_text is the hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        only()
        for b in slices(batches):
            row, start, end, digest = [], [], [], []
            for i, text in enumerate(texts(b)):
                for unit, lo, hi in units(text, min_words):
                    row.append(i), start.append(lo), end.append(hi), digest.append(xxhash.xxh3_128_digest(unit))
            row = pa.array(row, pa.int64())
            both = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(row), b.column("_cut_text").take(row), *(pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                ["doc_id", "_cut_text", "high", "low", "start", "end"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("_cut_text"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, _cut_text long, high long, low long, start int, end int")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, _cut_text, spans): the units to cut of each document that has any, as an array of (start, end)."""
    found = stage(digests(docs, min_words), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_cut_text", "start")
    counted = found.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1").drop("n")
    again = found.join(counted, ["high", "low"]).where(rank != F.col("first"))
    return again.groupBy("doc_id", "_cut_text").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for t, s in zip(text, spans, strict=True):
        cuts = merged((x["start"], x["end"]) for x in s)
        at, kept = 0, []
        for lo, hi in cuts:
            kept.append(t[at:lo])
            at = hi
        rows.append(("".join(kept) + t[at:], ",".join(f"{lo}-{hi}" for lo, hi in cuts), sum(hi - lo for lo, hi in cuts)))
    return pd.DataFrame(rows, columns=["text", "spans", "removed"])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text cut, removed_spans ("start-end,..." of the original text) and removed_chars."""
    docs = docs.drop("removed_spans", "removed_chars")
    cuts = repeats(docs, min_words).select(F.col("doc_id").alias("_cut_doc"), F.col("_cut_text").alias("_cut_hash"), F.col("spans").alias("_cut_spans"))
    same = F.col("_cut_doc").eqNullSafe(F.col("doc_id")) & (F.col("_cut_hash") == F.xxhash64("text"))
    joined = docs.join(cuts, same, "left")
    cutter = F.pandas_udf(_cut, "text string, spans string, removed int")
    cut = joined.withColumn("_cut_out", cutter(text_of(), F.coalesce("_cut_spans", F.array().cast("array<struct<start:int,end:int>>"))))
    text = F.when(F.col("text").isNotNull(), F.col("_cut_out.text")).alias("text")
    kept = [text if c == "text" else F.col(c) for c in docs.columns]
    return cut.select(*kept, F.col("_cut_out.spans").alias("removed_spans"), F.col("_cut_out.removed").alias("removed_chars"))


ORACLE = r"""
WITH d AS (SELECT doc_id, text FROM documents),
s AS (SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+') AS l FROM d)),
o AS (SELECT *, coalesce(sum(length(u)) OVER w, 0)::BIGINT AS lo, coalesce(sum(contains(u, chr(10))::INT) OVER w, 0) AS line
  FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT doc_id, line, lo, lo + length(u) AS hi, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) AS norm FROM o),
c AS (SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS k FROM n),
q AS (SELECT doc_id, lo, hi, md5(norm) AS h FROM c WHERE k >= 8
  UNION ALL SELECT doc_id, min(lo), max(hi), md5(string_agg(norm, ' ' ORDER BY lo) FILTER (norm <> '')) FROM c GROUP BY doc_id, line
  HAVING sum(k) >= 8 AND bool_or(k BETWEEN 1 AND 7)),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, lo) AS turn FROM q),
x AS (SELECT doc_id, lo, hi, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE turn > 1),
g AS (SELECT *, sum((before IS NULL OR lo > before)::INT) OVER (PARTITION BY doc_id ORDER BY lo, hi DESC) AS island FROM x),
m AS (SELECT doc_id, island, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY ALL),
z AS (SELECT doc_id, string_agg(lo::BIGINT || '-' || hi::BIGINT, ',' ORDER BY lo) AS removed_spans, sum(hi - lo)::INT AS removed_chars FROM m GROUP BY doc_id),
p AS (SELECT doc_id, hi AS lo, lead(lo, 1, 4000000000) OVER (PARTITION BY doc_id ORDER BY lo, hi) AS hi FROM (SELECT doc_id, lo, hi FROM m UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM m)),
k AS (SELECT p.doc_id, string_agg(substring(text, (lo + 1)::BIGINT, (hi - lo)::BIGINT), '' ORDER BY lo) AS text FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(k.text, d.text) AS text, coalesce(removed_spans, '') AS removed_spans, coalesce(removed_chars, 0)::INT AS removed_chars
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN k USING (doc_id)
"""
