"""How many blocks of points a search has: with many neighbours each block of points costs a list of them."""

from affinity.operators import knn as K


def test_many_neighbours_have_one_block_of_points():
    # 120,000 vectors of 64 doubles, 1,000 neighbours: three blocks of points gave 360 million candidates
    asked = K.RESULT_BYTES // (24 * 1001)
    qb, pb = K._sides(120_000, 120_000, asked, 131_072, 6, 512, 1000)
    assert pb == 1 and qb == -(-120_000 // asked)
    # more points than a side holds are still dealt
    assert K._sides(120_000, 300_000, asked, 131_072, 6, 512, 1000)[1] == 3


def test_every_task_has_a_tile_and_few_neighbours_share_the_vectors():
    for tasks in (1, 6, 8, 100, 1000):
        for k in (5, 100):
            qb, pb = K._sides(50_000, 50_000, 32_768, 131_072, tasks, 512, k)
            assert qb * pb >= tasks
    qb, pb = K._sides(50_000, 50_000, 32_768, 131_072, 1000, 512, 1)
    assert qb < 100 and pb > 10
    assert K._sides(3, 0, 10, 10, 8, 512, 5) == (1, 1)
