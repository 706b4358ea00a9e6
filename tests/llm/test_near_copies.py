"""The pipeline's near-dedup against brute-force Jaccard similarity of five-word shingles."""

from itertools import combinations

import corpus_pipeline


def brute_force(rows):
    """The ids that stay: the smallest of each component of pairs of similarity 0.8 or more."""
    sets = {}
    for i, text in rows:
        words = text.encode().lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if root[a] != root[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    return {i for i in root if root[i] == i}


def test_stage_is_brute_force_jaccard_on_documents(spark, sf, documents):
    found = corpus_pipeline.near_dedup(spark, documents, sf)
    rows = [(r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect()]
    want = brute_force(rows)
    assert {r["doc_id"] for r in found.collect()} == want and len(want) < len(rows)


def test_pairs_on_both_sides_of_the_limit_and_chains(spark, docs_of, sf):
    def changed(i, at):
        words = [f"w{i}x{k}" for k in range(200)]
        for k in at:
            words[k] += "y"
        return " ".join(words)

    rows = [(10 * i, changed(i, [])) for i in range(8)]
    rows += [(10 * i + 1, changed(i, range(5, 5 + 10 * i, 10))) for i in range(1, 8)]  # i changed words: similar up to 4
    rows += [(10 * i + 2, changed(i, range(5, 5 + 10 * 2 * i, 10))) for i in range(1, 8)]  # similar to the one before up to 4
    want = brute_force(rows)
    found = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs_of(rows), sf).collect()}
    assert found == want and 41 not in found and 42 not in found and {50, 51, 52} <= found
