"""Quality rules with cross-document line frequency (operator 3).

One pass over the texts gives each document its own figures and the hashes of its normalised lines (ASCII letters
lower, digits as 0, words joined by one space; lines without a word don't count).  For each host, documents of distinct
text are counted for each line; a line above the host's limit is boilerplate and is removed from every document but
the one of smallest id, which keeps the host's one copy.  A document with too few words left is depleted and rejected.

The texts are read once and never shuffled; line counts are partial aggregates, so a line that a third of all
documents share costs one row for each task.

Defined cases: null texts have no words; a null host is the empty host; a null id sorts last; repeated rows of one id
and text get the same figures; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import real_id, sort_id, text_slices, utf8, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
#: A line is boilerplate above this many documents of a host and above this share of them.
LINE_DOCS, LINE_SHARE = 20, 0.02
#: A document is depleted if fewer than MIN_WORDS words or less than this share of its words are left.
LEAST_LEFT = 0.3
NORMAL = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside a window of that width that the text has twice or more."""
    shifts = [words[i:] for i in range(width)]
    if len(set(zip(*shifts))) == max(0, len(words) - width + 1):
        return 0
    first: dict[tuple, int] = {}
    hit = np.zeros(len(words) + 1, np.int64)
    for at, window in enumerate(zip(*shifts)):
        seen = first.setdefault(window, at)
        if seen != at:
            for start in (seen, at):
                hit[start] += 1
                hit[start + width if start + width < len(hit) else -1] -= 1
    return int((np.cumsum(hit)[:-1] > 0).sum())


def text_figures(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; hashes of the distinct normalised lines and their words."""
    words = text.encode().split()
    lines, duplicates, normal = set(), 0, {}
    for line in text.split("\n"):
        own = line.encode().translate(NORMAL).split()
        if own:
            duplicates += line in lines
            lines.add(line)
            key = xxhash.xxh64_intdigest(b" ".join(own)) - 2**63
            normal[key] = normal.get(key, 0) + len(own)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words), list(normal), list(normal.values())


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(_id, _h, host, the five figures, lines, line_words), without the texts."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            _, offsets = utf8(texts)
            for a, b in text_slices(offsets, 4_000_000):
                rows = list(zip(*map(text_figures, texts.slice(a, b - a).to_pylist())))
                keys = [batch.column(i).slice(a, b - a) for i in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, *(pa.array(x, pa.int64()) for x in rows[:5]), pa.array(rows[5], pa.list_(pa.int64())), pa.array(rows[6], pa.list_(pa.int64()))],
                    ["_id", "_h", "host", *FIGURES, "lines", "line_words"],
                )

    whole = docs.select(sort_id(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    schema = "_id long, _h long, host string, " + ", ".join(f"{x} long" for x in FIGURES) + ", lines array<long>, line_words array<long>"
    return whole.mapInArrow(run, schema)


def frequent_lines(figures: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, line, keeper): the lines above their host's limit, and the smallest id that has them."""
    distinct = figures.groupBy("host", "_h").agg(F.min("_id").alias("_id"), F.first("lines").alias("lines"))
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counted = distinct.select("host", "_id", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("keeper"))
    return counted.where(F.col("n") > line_docs).join(hosts, "host").where(F.col("n") > line_share * F.col("host_docs")).select("host", "line", "keeper")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """One row for each document: figures, base_failed, words and lines to remove (removed_lines: hashes), kept."""
    figures = written(document_figures(docs, id_col, text_col, host_col), "line-figures")
    boilerplate = written(frequent_lines(figures, line_docs, line_share), "frequent-lines")
    lines = figures.select("_id", "_h", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("_id", "_h", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    # repeated rows of a document would count twice in the sum, so they are told apart by being the same text
    cut = lines.join(boilerplate, ["host", "line"]).where("_id <> keeper").dropDuplicates(["_id", "_h", "host", "line"])
    removed = cut.groupBy("_id", "_h", "host").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return figures.join(removed, ["_id", "_h", "host"], "left").select(
        "_id", "_h", real_id("_id").alias(id_col), *FIGURES, failed.alias("base_failed"),
        (~failed & (left >= MIN_WORDS) & (left >= LEAST_LEFT * F.col("n_words"))).alias("kept"),
        F.coalesce("removed_words", F.lit(0)).alias("removed_words"), "removed_lines",
    )


def without_lines(texts: DataFrame) -> DataFrame:
    """(…, text): the lines whose hash is in removed_lines cut out of text; everything else stays as it is."""

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for i, (text, gone) in enumerate(zip(pdf["text"], pdf["removed_lines"])):
                if text and gone is not None and len(gone):
                    gone = set(gone.tolist())
                    pdf.iat[i, pdf.columns.get_loc("text")] = "\n".join(
                        x for x in text.split("\n") if not (own := x.encode().translate(NORMAL).split()) or xxhash.xxh64_intdigest(b" ".join(own)) - 2**63 not in gone
                    )
            yield pa.RecordBatch.from_pandas(pdf.drop(columns="removed_lines"), preserve_index=False, schema=batch.schema.remove(batch.schema.get_field_index("removed_lines")))

    kept = [f for f in texts.schema.fields if f.name != "removed_lines"]
    return texts.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept))


ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
base AS (
  SELECT doc_id, text, host, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM words),
wins AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS win FROM (SELECT doc_id, w, unnest(generate_series(1, n_words - {WINDOW - 1})) AS i FROM base)),
again AS (SELECT doc_id, win FROM wins GROUP BY doc_id, win HAVING count(*) > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT wins.doc_id, i + k AS p FROM wins JOIN again USING (doc_id, win), generate_series(0, {WINDOW - 1}) g(k)) GROUP BY doc_id),
lines AS (SELECT doc_id, text, host, line, list_aggregate(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\\x20\\x09-\\x0D]+'), 'string_agg', ' ') AS norm
  FROM (SELECT doc_id, text, host, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT text) AS host_docs FROM docs GROUP BY host),
freq AS (SELECT host, norm, min(doc_id) AS keeper FROM lines JOIN hosts USING (host) GROUP BY host, norm, host_docs
  HAVING count(DISTINCT text) > {LINE_DOCS} AND count(DISTINCT text) > {LINE_SHARE} * host_docs),
gone AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS removed FROM lines JOIN freq USING (host, norm) WHERE doc_id <> keeper GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words)
    AND n_words - coalesce(removed, 0) >= {MIN_WORDS} AND n_words - coalesce(removed, 0) >= {LEAST_LEFT} * n_words AS kept
FROM base LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
