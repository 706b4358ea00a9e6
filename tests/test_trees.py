"""Searches, sorts and bars over the rows of a compiled tree; routes with their ways and the places they may use."""

import random

from spanforge.operators import lookup, present

TREE = "path array<string>, label string, rank int, total long"


def tree(spark, paths):
    return spark.createDataFrame([(p.split("/") if p else [], p.rpartition("/")[2] or "Total", i, len(p)) for i, p in enumerate(paths)], TREE)


def plain(rows, query):
    """The walk as it is told: a row's own hit keeps its children, a child's narrows it."""
    kids = {}
    for p in rows:
        if p:
            kids.setdefault(p.rpartition("/")[0], []).append(p)

    def own(label):
        at = label.lower().find(query)
        if at >= 0:
            return 100 - min(at, 50) + (20 if at == 0 or not label[at - 1].isalnum() else 0)
        return None

    found = {}

    def keep(p):
        for c in kids.get(p, []):
            found.setdefault(c, None)
            keep(c)

    def walk(p):
        scores = [s for s in map(walk, kids.get(p, [])) if s is not None]
        best, mine = max(scores, default=0), own(p.rpartition("/")[2])
        if mine is not None:
            keep(p)
            found[p] = (True, bool(scores), float(mine + 200 + best))
        elif scores:
            found[p] = (False, True, float(best))
        return found[p][2] if found.get(p) else None

    for p in kids.get("", []):
        walk(p)
    return {p: v or (False, False, 0.0) for p, v in found.items()}


def test_search_over_a_tree(spark):
    paths = ["", "Ann", "Ann/Blaze", "Ann/Slash", "Ann/Blaze/a gnoll", "Ann/Blaze/a blob", "Bob", "Bob/Kick", "Bob/Kick/a blob", "Blade", "Blade/Bl", "Blade/Kick", "Blade/Bl/bl bl", "Zed", "Zed/Kick"]
    for query in ("bl", "kick", "ann", "a gnoll", "nothing"):
        found = {"/".join(r["path"]): (r["hit"], r["open"], r["score"]) for r in present.filter_tree(tree(spark, paths), query).collect()}
        if query == "a gnoll":  # two tokens: letters of one label in any order
            assert set(found) == {"Ann", "Ann/Blaze", "Ann/Blaze/a gnoll"}
        else:
            assert found == plain(paths, query), query
    assert present.filter_tree(tree(spark, paths), " ").count() == len(paths)


def test_sorts_at_every_level(spark):
    names = ["Rex10", "rex2", "Rex 1", "", "Ann", "rex02", "12", "9"]
    rows = tree(spark, [f"{a}/{b}" for a in ("Raider10", "Raider9") for b in names if b] + ["Raider10", "Raider9"])
    found = {}
    for r in present.sort_tree(rows, None, descending=False).orderBy("rank").collect():
        found.setdefault(tuple(r["path"][:-1]), []).append(r["path"][-1])
    assert found[()] == ["Raider9", "Raider10"]
    assert found["Raider10",] == ["9", "12", "Ann", "rex2", "rex02", "Rex10", "Rex 1"]
    top = present.sort_tree(rows, "total").where("size(path) = 1").orderBy("rank").collect()
    assert [r["label"] for r in top] == ["Raider10", "Raider9"]


def test_bars_fold_the_rest(spark):
    rng = random.Random(1)
    parts = {(f"s{i}", f"p{j}"): rng.randrange(1, 1000) for i in range(6) for j in range(5) if rng.random() < 0.8}
    spell, who = {}, {}
    for (s, p), n in parts.items():
        spell[s], who[p] = spell.get(s, 0) + n, who.get(p, 0) + n
    rows = spark.createDataFrame([([s], s, 1, n) for s, n in spell.items()] + [([s, p], p, 1, n) for (s, p), n in parts.items()], TREE)
    bars, loud = (sorted(x, key=lambda k: (-x[k], k)) for x in (spell, who))
    want = {}
    for (s, p), n in parts.items():
        b, g = min(bars.index(s) + 1, 4), min(loud.index(p) + 1, 3)
        key = (b, s if b < 4 else "Other (3)", g, p if g < 3 else "Other")
        want[key] = want.get(key, 0) + n
    assert {tuple(r)[:4]: r["total"] for r in present.ability_bars(rows, bars=3, segments=2).collect()} == want


def test_ways_go_by_order_and_only_where_allowed(spark):
    edges = spark.createDataFrame([("a", "z"), ("a", "m"), ("z", "b"), ("m", "y"), ("b", "end"), ("y", "end"), ("m", "x"), ("x", "end")], "a string, b string")
    ways = {r["node"]: r["path"] for r in lookup.routes(edges, "a").collect()}
    # the first by the order of all nodes on the way, not of the last one
    assert ways["end"] == ["a", "m", "x", "end"]
    allowed = spark.createDataFrame([(n,) for n in "a z b end y".split()], "node string")
    ways = {r["node"]: (r["hops"], r["via"], r["path"]) for r in lookup.routes(edges, "a", allowed).collect()}
    assert ways["end"] == (3, "b", ["a", "z", "b", "end"]) and "m" not in ways and ways["y"][0] == 4
    assert lookup.routes(edges, "m", allowed).collect() == []
