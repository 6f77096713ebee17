"""The first of many overlapping ranges, without a row for each pair of an offset and a range."""

import random

from lexforge.operators import relational as R


def test_first_range_of_many(spark):
    rng = random.Random(11)
    ranges = [(f"f{k}", a := rng.randint(-300, 300), a + rng.choice([-1, 0, 1, 5, 64, 200]), o if (o := rng.randint(0, 10**6)) % 5 else None) for k in range(150)]
    asked = [rng.randint(-350, 550) for _ in range(200)] + [None]
    out = R.range_lookup(spark.createDataFrame([(x,) for x in asked], "off int"), spark.createDataFrame(ranges, "file string, first int, last int, ord int"), "off", "first", "last", "ord")
    want = []
    for x in asked:
        holds = [r for r in ranges if x is not None and r[1] <= x < r[2] and r[3] is not None]
        best = min(holds, key=lambda r: r[3], default=None)
        want.append((x, best and best[0], None if best is None else x - best[1]))
    assert sorted(map(repr, ((r.off, r.range and r.range.file, r.within) for r in out.collect()))) == sorted(map(repr, want))
    lookup = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in lookup and "min_by(struct(file" not in lookup  # lists of buckets meet offsets, not pairs
