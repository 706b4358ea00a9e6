from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spanforge.operators import intervals

SPANS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 200000), st.integers(-50, 5000)), min_size=0, max_size=25)
FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, rows):
    return spark.createDataFrame([(k, b, b + n) for k, b, n in rows], "k int, b long, e long")


def plain_merge(rows):
    out = []
    for k, b, e in sorted((k, min(b, b + n), max(b, b + n)) for k, b, n in rows):
        if out and out[-1][0] == k and b <= out[-1][2] + 1:
            out[-1] = (k, out[-1][1], max(out[-1][2], e))
        else:
            out.append((k, b, e))
    return out


@FEW
@given(SPANS)
def test_merge_is_the_union(spark, rows):
    merged = intervals.merge(frame(spark, rows), ["k"])
    assert sorted(map(tuple, merged.collect())) == plain_merge(rows)


@FEW
@given(SPANS, st.integers(0, 3000), st.integers(1, 3000))
def test_trim_keeps_the_middle(spark, rows, skip, most):
    got = intervals.trim(intervals.merge(frame(spark, rows), ["k"]), ["k"], skip, most)
    want = []
    for key in {r[0] for r in rows}:
        seconds = [s for k, b, e in plain_merge(rows) if k == key for s in range(b, e + 1)][skip : skip + most]
        want += [(key, s) for s in seconds]
    assert sorted((k, s) for k, b, e in got.collect() for s in range(b, e + 1)) == sorted(want)


@FEW
@given(SPANS, SPANS)
def test_intersect_is_pairwise(spark, left, right):
    a, b = plain_merge(left), plain_merge(right)
    want = sorted((k, max(x, u), min(y, v)) for k, x, y in a for j, u, v in b if k == j and max(x, u) <= min(y, v))
    frames = [spark.createDataFrame(r or [], "k int, b long, e long") for r in (a, b)]
    assert sorted(map(tuple, intervals.intersect(*frames, ["k"]).collect())) == want


def test_touching_seconds_merge_and_gaps_do_not(spark):
    rows = spark.createDataFrame([(0, 10, 20), (0, 21, 30), (0, 32, 40)], "k int, b long, e long")
    assert sorted(map(tuple, intervals.merge(rows, ["k"]).collect())) == [(0, 10, 30), (0, 32, 40)]
