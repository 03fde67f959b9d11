"""Links within one shard against brute force: dense groups, strangers, groups joined late."""

import random

import pytest

from marlstone.llm.simhash import BKTree, shard_links


def components(n, links):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


def near(r, center, bits):
    for b in r.sample(range(64), bits):
        center ^= 1 << b
    return center


@pytest.mark.parametrize("seed", range(40))
def test_links_give_the_components_of_all_pairs(seed):
    r = random.Random(seed)
    centers = [r.getrandbits(64)]
    while len(centers) < 5:  # some groups are near enough to be bridged
        centers.append(near(r, r.choice(centers), r.choice([5, 7, 9, 30])))
    fps = list({near(r, r.choice(centers), r.randint(0, 6)) for _ in range(r.choice([3, 20, 120]))})
    (r.shuffle if seed % 2 else list.sort)(fps)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    links = shard_links(fps, list(range(len(fps))), 4)
    assert components(len(fps), links) == components(len(fps), pairs)
    assert set(map(frozenset, links)) <= set(map(frozenset, pairs)) and len(links) == len(fps) - len(set(components(len(fps), pairs)))


def test_a_dense_group_is_not_searched_through():
    r = random.Random(1)
    center = r.getrandbits(64)
    fps = sorted({near(r, center, r.randint(0, 2)) for _ in range(3000)})
    tree, seen = BKTree(), 0

    def known(label):
        return found

    for i, fp in enumerate(fps):
        found = False
        for _ in tree.within(fp, 4, known):
            found, seen = True, seen + 1
        tree.add(fp, i, lambda a, b: True)
    assert seen == len(fps) - 1


def test_a_search_without_classes_finds_all():
    r = random.Random(2)
    fps = list({near(r, 12345, r.randint(0, 8)) for _ in range(300)})
    tree = BKTree()
    for i, fp in enumerate(fps):
        tree.add(fp, i)
    for fp in fps[:30]:
        assert sorted(tree.within(fp, 4)) == [i for i, x in enumerate(fps) if (x ^ fp).bit_count() <= 4]
