import random
import re

import pytest
import xxhash

from cohortlens.llm import simhash
from tests.llm.conftest import ODD_ROWS


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_groups(rows, bits=2):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            first[find(i)] = min(doc, first.get(find(i), doc))
    return sorted([(d, f"{prints[i]:016x}", first.get(find(i))) for i, (d, _) in enumerate(rows)], key=repr)


def words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(40):  # groups of near copies, and chains of them
        base = words(rng, 150)
        for j in range(rng.choice([1, 2, 6])):
            out.append((len(out), " ".join(base)))
            if j % 2:
                base[rng.randrange(150)] = "changed"
    return out + [(len(out) + i, "Hot copy of a text") for i in range(120)]


def test_against_brute_force(documents, rows):
    got = sorted((tuple(r) for r in simhash.near_groups(documents(rows)).collect()), key=repr)
    assert got == brute_groups(rows)
    assert len({r[2] for r in got}) < len({r[1] for r in got})  # some differ in bits


def test_odd_rows(odd):
    got = sorted((tuple(r) for r in simhash.near_groups(odd).collect()), key=repr)
    assert got == brute_groups(ODD_ROWS)


def test_one_of_each_group_stays(documents, rows):
    left = simhash.deduplicate(documents(rows))
    assert sorted(r.doc_id for r in left.collect()) == sorted({r[2] for r in brute_groups(rows)})
    assert left.columns == documents(rows).columns


def test_odd_rows_stay_once(odd):
    left = simhash.deduplicate(odd).collect()
    assert len(left) == len({r[1] for r in brute_groups(ODD_ROWS)})


def test_empty(empty):
    assert simhash.near_groups(empty).count() == 0
    assert simhash.deduplicate(empty).count() == 0


def test_links_of_random_prints(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for k in (1, 2, 3, 4):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    from cohortlens.llm.components import components

    for bits in (2, 4):
        root = {r.node: r.root for r in components(simhash.links(df, bits)).collect()}
        low = {p: p for p in signed}
        for _ in range(len(signed)):
            new = {p: min(low[q] for q in signed if ((p ^ q) & (1 << 64) - 1).bit_count() <= bits) for p in signed}
            if new == low:
                break
            low = new
        assert {p: root.get(p, p) for p in signed} == low


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), 3)
