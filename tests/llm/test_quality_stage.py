"""The pipeline's quality rules on hosts of many texts."""

import corpus_pipeline


def test_lines_of_a_large_host_go_by_their_count_alone(spark, docs_of, sf):
    line = "Share this page with all of your friends today please and thank you"
    letters = str.maketrans("0123456789", "abcdefghij")  # lines that differ in digits only count as equal
    own = lambda i: " ".join(f"{i}x{k}".translate(letters) for k in range(12))
    # 30 of 1600 texts have the line: above 20, below 2 %
    rows = [(i, f"{own(i)}\n{line}") for i in range(30)] + [(i, own(i)) for i in range(30, 1600)]
    rows += [(2000, f"{line}\n{own(2000)[:20]}")]
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs_of(rows), sf).collect()}
    assert len(left) == 1600 and 2000 not in left
    assert [i for i, text in left.items() if line in text] == [0]
