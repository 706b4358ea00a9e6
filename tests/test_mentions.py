"""Mentions of names of any length."""

import regex

from spanforge.operators import feeds
from spanforge.plans import catalog


def test_names_of_any_length_are_found(spark):
    name = "Staff of the Last Keeper of the Old Drowned Grey Tower"
    texts = spark.createDataFrame([(1, f"selling {name.lower()}, cheap"), (2, "Keeper of the Old"), (3, None)], "id long, text string")
    names = spark.createDataFrame([(name,), ("Old Keeper",)], "name string")
    assert [tuple(r) for r in feeds.mentions(texts, names, ["id"]).collect()] == [(1, name, 2)]
    assert feeds.mentions(texts, names.limit(0), ["id"]).collect() == []


def test_the_registered_dictionary_has_short_and_long_names(spark, tmp_path):
    words = "Iron Ring lay under one grey stone beside Old Keeper".split()
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spoken = ["iron ring", "I saw Iron there", "grey stone", " ".join(words[:8]), "lay under"]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(spoken)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r["turn"], r["name"]) for r in catalog.queries()["mention_scan"](spark, str(tmp_path)).collect()}
    assert found == {(0, "Iron Ring"), (1, "Iron"), (2, "grey stone"), (3, " ".join(words[:8]))}


def plain(rows, names):
    """Every run of words against the dictionary, longest first, then by place and name; kept ones don't overlap or repeat."""
    by_words = {}
    for name in names:
        by_words.setdefault(tuple(name.lower().split(" ")), []).append(name)
    lengths = sorted({len(k) for k in by_words}, reverse=True)
    capital = lambda w: bool(regex.match(r"\p{Lu}", w))
    out = set()
    for ids, text in rows:
        words = [w for w in (regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", x) for x in regex.split(r"\s+", text or "")) if w]
        hits = []
        for n in lengths:
            for i in range(len(words) - n + 1):
                for name in by_words.get(tuple(w.lower() for w in words[i : i + n]), []):
                    alone = not (i > 0 and capital(words[i - 1])) and not (i + 1 < len(words) and capital(words[i + 1]))
                    if n > 1 or (words[i] == name and alone):
                        hits.append((-n, i + 1, name))
        used, seen = set(), set()
        for n, at, name in sorted(hits):
            own = set(range(at, at - n))
            if not (own & used) and name not in seen:
                used |= own
                seen.add(name)
                out.add((*ids, name, at))
    return out


def test_the_whole_table_equals_brute_force(spark, sf):
    rows = [((r["conv_id"], r["turn"]), r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    names = [r["name"] for r in catalog.mention_names(spark, sf).collect()]
    found = [tuple(r) for r in catalog.queries()["mention_scan"](spark, sf).select("conv_id", "turn", "name", "at").collect()]
    assert len(found) == len(set(found)) > 100 and set(found) == plain(rows, names)
