"""Source divergence audit by sorted runs (operator 13): how far the sources of a language differ in their words.

1. Each task counts the terms of its documents by (lang, source) and writes partial runs (lang, term, source, chunk,
   documents, occurrences); a chunk is one task's share of the documents, in place of the single documents, so the
   most frequent term costs a row a source and chunk and not a row a document.
2. The runs are dealt by (lang, term), sorted by (lang, term, source, chunk) and read once from front to back.  Run
   lengths give each term's document frequency in its language and its occurrences by source; a term that enough
   documents have is passed on as soon as that is known, so a scan never holds more than a few rows.
3. A second scan of the runs of kept terms, now with the shares p of their sources, emits partial sums for the pairs of
   sources of a run and the leading terms of each source.

With p0 the share of a term that a source lacks, the divergence of sources s and t is split so that no term costs a row
for each pair of all sources:

    V f(p0s, p0t) + sum over terms of s: f(p, p0t) - f(p0s, p0t) + the same for t
                  + sum over shared terms: f(p, q) - f(p, p0t) - f(p0s, q) + f(p0s, p0t)

The second part depends on a term's count alone, so it is summed over (source, count, number of such terms); the third
is what the scan emits.  All numbers are integers of 64 bits, exact for counts up to 9e13 (`share` divides in two steps).
A language of S sources has S (S - 1) result rows of part `pair`; nothing else grows with the square of a group.

Defined cases: null lang, source and text count as ''; every row is a document of its own, repeated rows too; a group
without terms has count 0 for every kept term; a language without kept terms has pairs of value 0 and no terms; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: A share of one is so much; the smoothing adds PRIOR to each count.
SCALE, PRIOR = 1_000_000_000, 2
MIN_DOCS, TOP_TERMS = 10, 10
#: Entries (term of a source) that a task counts before it writes a chunk.
CHUNK = 1_000_000
#: Letters of ASCII in lower case, bytes above 0x7F as they are, all others a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RUN = "lang string, term string, source string, chunk long, docs long, n long"
KEPT = "lang string, term string, source string, n long, lead int"


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split(b" ")


def partial_runs(docs: DataFrame) -> DataFrame:
    """One row for each (lang, term, source) and chunk of documents."""

    def rows(groups: dict, chunk: int) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, again) in groups.items():
            counts.pop(b"", None)
            found, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            seen = 1 + np.fromiter(map(again.get, found, repeat(0)), np.int64, len(found))
            for a in range(0, len(found), 50_000):
                part = pa.array(found[a : a + 50_000], pa.binary()).cast(pa.string())
                same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(part), np.int64)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), part, same(source), pa.array(np.full(len(part), chunk)), pa.array(seen[a : a + 50_000]), pa.array(n[a : a + 50_000])], ["lang", "term", "source", "chunk", "docs", "n"])

    def run(batches):
        # of each group: occurrences of its terms, and documents of a term after its first one
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts, again = groups.setdefault((lang, source), (Counter(), Counter()))
                words = terms(text.encode())
                before = len(counts)
                again.update(counts.keys() & set(words))
                counts.update(words)
                size += len(counts) - before
                if size > CHUNK:
                    yield from rows(groups, chunk)
                    groups, chunk, size = {}, chunk + 1, 0
        yield from rows(groups, chunk)

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*columns).mapInArrow(run, RUN)


def changes(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    """Whether each row differs from the one before it in a column of names; the first does."""
    n = batch.num_rows
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = np.logical_or.reduce([pc.not_equal(batch[c].slice(1), batch[c].slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in names])
    return out


def joined(held: pa.Table | None, batch: pa.RecordBatch) -> pa.Table:
    now = pa.Table.from_batches([batch])
    return pa.concat_tables([held, now]).combine_chunks() if held is not None and held.num_rows else now


def kept_runs(runs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, lead) of the terms of at least min_docs documents of their language; lead is 1 once a term."""

    def scan(batches):
        held, passed = None, False  # the last run's rows; whether rows of it have been passed on
        for batch in batches:
            if batch.num_rows == 0:
                continue
            now = joined(held, batch)
            at = np.flatnonzero(changes(now, ["lang", "term", "source"]))
            docs, n = (np.add.reduceat(now[c].to_numpy(), at) for c in ("docs", "n"))
            now = pa.table({"lang": now["lang"].take(at), "term": now["term"].take(at), "source": now["source"].take(at), "docs": docs, "n": n})
            first = changes(now, ["lang", "term"])
            starts = np.flatnonzero(first)
            kept = np.add.reduceat(docs, starts) >= min_docs
            kept[0] |= passed
            lead = first.copy()
            lead[0] &= not passed
            # of the last run, which may go on: nothing if it isn't kept yet, else all rows but its last
            end = len(docs) - 1 if kept[-1] else int(starts[-1])
            passed = bool(kept[-1]) and (end > starts[-1] or (len(starts) == 1 and passed))
            keep = np.repeat(kept, np.diff([*starts, len(docs)]))[:end]
            out = now.slice(0, end).append_column("lead", pa.array(lead[:end].astype(np.int32))).filter(pa.array(keep))
            yield from out.select(["lang", "term", "source", "n", "lead"]).to_batches()
            held = now.slice(end).append_column("chunk", pa.array(np.zeros(len(docs) - end, np.int64))).select(batch.schema.names)
        if held is not None and held.num_rows:
            # one run is left; a passed one has one row left
            if passed or sum(held["docs"].to_pylist()) >= min_docs:
                lead = np.zeros(held.num_rows, np.int32)
                lead[0] = not passed
                yield from held.append_column("lead", pa.array(lead)).select(["lang", "term", "source", "n", "lead"]).to_batches()

    dealt = runs.repartition(4 * partitions(runs.sparkSession), "lang", "term").sortWithinPartitions("lang", "term", "source", "chunk")
    return dealt.mapInArrow(scan, KEPT)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / total) in 64 bits: 10^5 times, then 10^4 times the remainder."""
    scaled = (count + PRIOR) * F.lit(100_000).cast("long")
    return 1 + _div(scaled, total) * 10_000 + _div((scaled % total) * F.lit(10_000).cast("long"), total)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    scaled = (count + PRIOR) * 100_000
    return 1 + scaled // total * 10_000 + scaled % total * 10_000 // total


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, v, lang_n): occurrences of kept terms of every group, kept terms and occurrences of its language."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("lead").alias("v"))
    found = groups.join(own, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    langs = found.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("n").alias("lang_n"))
    return found.drop("v").join(langs, "lang")


def partial_results(kept: DataFrame, totals: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(part, lang, source, item, value): of each run the share pairs' third part (source < item) and its leading terms."""

    def emitted(now: pa.Table) -> Iterator[pa.RecordBatch]:
        n, smooth, lang_smooth = (now[c].to_numpy() for c in ("n", "smooth", "lang_smooth"))
        first = changes(now, ["lang", "term"])
        run = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        own, none = shares(n, smooth), shares(np.zeros_like(n), smooth)
        of_lang = shares(np.add.reduceat(n, starts), lang_smooth[starts])[run]
        # (lang, source) as one number
        names = pa.table({"lang": now["lang"], "source": now["source"]}).group_by(["lang", "source"]).aggregate([])
        place = {x: i for i, x in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist()))}
        group = np.fromiter((place[x] for x in zip(now["lang"].to_pylist(), now["source"].to_pylist())), np.int64, len(n))
        keys, values = [], []
        for k in range(1, int(np.diff([*starts, len(n)]).max())):
            i = np.flatnonzero(run[k:] == run[:-k])
            j = i + k
            keys.append(group[i] * len(place) + group[j])
            values.append(distances(own[i], own[j]) - distances(own[i], none[j]) - distances(none[i], own[j]) + distances(none[i], none[j]))
        if keys:
            pair, back = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(pair), np.int64)
            np.add.at(sums, back, np.concatenate(values))
            yield rows("pair", names, pair // len(place), names["source"].take(pair % len(place)), sums)
        value = distances(own, of_lang)
        above = np.flatnonzero(own > of_lang)
        by = pa.table({"group": group[above], "value": value[above], "term": now["term"].take(above)})
        by = by.sort_by([("group", "ascending"), ("value", "descending"), ("term", "ascending")])
        owner = by["group"].to_numpy()
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = by.filter(pa.array(rank < top))
        yield rows("term", names, best["group"].to_numpy(), best["term"], best["value"].to_numpy())

    def rows(part: str, names: pa.Table, group: np.ndarray, item, value: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([part] * len(value), pa.string()), names["lang"].take(group), names["source"].take(group), item, pa.array(value, pa.int64())]
        return pa.table(columns, names=["part", "lang", "source", "item", "value"]).combine_chunks().to_batches()[0] if len(value) else pa.RecordBatch.from_arrays([pa.array([], x) for x in (pa.string(),) * 4 + (pa.int64(),)], ["part", "lang", "source", "item", "value"])

    def scan(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            now = joined(held, batch)
            end = int(np.flatnonzero(changes(now, ["lang", "term"]))[-1])  # the last run may go on
            if end:
                yield from emitted(now.slice(0, end).combine_chunks())
            held = now.slice(end)
        if held is not None and held.num_rows:
            yield from emitted(held.combine_chunks())

    known = totals.select("lang", "source", (F.col("n") + PRIOR * F.col("v")).alias("smooth"), (F.col("lang_n") + PRIOR * F.col("v")).alias("lang_smooth"))
    dealt = kept.drop("lead").join(known, ["lang", "source"]).repartition(4 * partitions(kept.sparkSession), "lang", "term")
    return dealt.select("lang", "term", "source", "n", "smooth", "lang_smooth").sortWithinPartitions("lang", "term", "source").mapInArrow(scan, "part string, lang string, source string, item string, value long")


def pair_sums(kept: DataFrame, totals: DataFrame, partial: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language."""
    smooth = F.col("n") + PRIOR * F.col("v")
    none = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.nullif(smooth, F.lit(0))))  # null for a language without kept terms
    own = totals.select("lang", "source", "v", smooth.alias("smooth"), none.alias("none"))
    other = own.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))
    pairs = own.join(other, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("v") * distance(F.col("none"), F.col("item_none")), F.lit(0)).alias("value"))
    counts = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("k"))
    gain = distance(share(F.col("n"), F.col("smooth")), F.col("item_none")) - distance(F.col("none"), F.col("item_none"))
    one = counts.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("k") * gain).alias("value"))
    both = partial.where("part = 'pair'").select("lang", "source", "item", "value")
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    every = base.union(one).union(turned(one)).union(both).union(turned(both))
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others, and by which terms from its language."""
    kept = written(kept_runs(partial_runs(docs), min_docs), "divergence-kept")
    totals = written(group_totals(docs, kept), "divergence-totals")
    partial = written(partial_results(kept, totals, top), "divergence-partial")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(kept, totals, partial).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    best = partial.where("part = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.union(best.where(F.col("rank") <= top))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
words AS (SELECT d, lang, source, unnest(ts) AS term FROM docs),
terms AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
grps AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN terms USING (lang, term) GROUP BY ALL),
every AS (SELECT lang, source, term, coalesce(c, 0)::HUGEINT AS c FROM grps JOIN terms USING (lang) LEFT JOIN counts USING (lang, source, term)),
sized AS (SELECT *, sum(c) OVER (PARTITION BY lang, source)::HUGEINT AS n, count(*) OVER (PARTITION BY lang, source)::HUGEINT AS v, sum(c) OVER (PARTITION BY lang, term)::HUGEINT AS lc, sum(c) OVER (PARTITION BY lang)::HUGEINT AS ln FROM every),
ps AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (n + 2 * v) AS p, 1 + (1000000000::HUGEINT * (lc + 2)) // (ln + 2 * v) AS q FROM sized),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN far USING (lang, source, item)
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM ps WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
