import random
from collections import defaultdict

import pytest

from loamlens.llm.packing import MAX_KINDS, OpenBins, packed, packing_report


def placed(spark, sizes, kinds=((1, 10), (2, 64)), **options):
    s = spark.createDataFrame([(*x, 7) for x in sizes], "doc_id long, n_tokens long, bin_id long")
    c = spark.createDataFrame([(i, "x", n) for i, n in kinds], "container_id long, label string, capacity long")
    return packed(s, c, **options)


def check(rows, sizes, kinds):
    wanted = defaultdict(int)
    for _, n in sizes:
        wanted["sum"] += max(n or 0, 0)
    for kind, capacity in kinds:
        mine = [r for r in rows if r.container_id == kind]
        assert sum(r.size for r in mine) == wanted["sum"]
        used = defaultdict(int)
        for r in mine:
            used[r.bin_id] += r.size
            assert 0 <= r.size <= capacity
        assert all(v <= capacity for v in used.values())
        pieces = defaultdict(list)
        for r in mine:
            pieces[r.doc_id].append(r)
        for key, n in sizes:
            if key is not None and sum(1 for k, _ in sizes if k == key) == 1:
                own = sorted(pieces[key], key=lambda r: r.piece)
                assert sum(r.size for r in own) == max(n or 0, 0)
                assert [r.piece for r in own] == list(range(len(own)))
                assert len(own) == 1 or n > capacity
    return rows


def test_every_item_is_placed_whole_and_nothing_overflows(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 3, 7, 10, 11, 63, 64, 65, 200, rng.randrange(1, 50)])) for i in range(400)]
    rows = placed(spark, sizes, items_per_shard=90, open_bins=8).collect()
    check(rows, sizes, ((1, 10), (2, 64)))


def test_few_bins_more_than_needed(spark):
    rng = random.Random(2)
    sizes = [(i, rng.randrange(1, 40)) for i in range(3000)]
    report = packing_report(placed(spark, sizes, kinds=((1, 64),), items_per_shard=1000)).first()
    assert report.n_bins <= 1.02 * report.least_bins
    assert 0 <= report.unused_share < 0.02


def test_null_negative_repeated_and_null_keys(spark):
    sizes = [(1, None), (2, -5), (3, 4), (3, 4), (None, 2), (4, 10)]
    rows = placed(spark, sizes, kinds=((1, 10),)).collect()
    assert len(rows) == 6 and sum(r.size for r in rows) == 20
    check(rows, sizes, ((1, 10),))


def test_empty_tables_bad_and_repeated_kinds(spark):
    assert placed(spark, []).count() == 0
    assert placed(spark, [(1, 2)], kinds=()).count() == 0
    assert placed(spark, [(1, 2)], kinds=((1, 0), (2, None), (3, 5), (3, 5))).count() == 1
    with pytest.raises(ValueError):
        placed(spark, [(1, 2)], kinds=tuple((i, 5) for i in range(MAX_KINDS + 1)))


def test_best_fit_and_fullest_closes_first():
    bins = OpenBins(10, 2)
    assert [bins.add(s) for s in (6, 8, 2, 4)] == [0, 1, 1, 0]
    assert bins.add(5) == 2 and len(bins.closed) == 1
    assert bins.add(5) == 2
