"""SimHash classes against plain loops over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(prints, radius=3):
    """Smallest id reachable, per id, by links between all pairs."""
    ids = sorted(prints)
    found = {i: i for i in ids}
    for i in ids:
        if found[i] != i:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            for y in ids:
                if found[y] == y and y > i and any((a ^ b).bit_count() <= radius for a in prints[x] for b in prints[y]):
                    found[y] = i
                    todo.append(y)
    return found


def check(spark, rows, got):
    prints = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            prints.setdefault(doc_id, set()).add(fingerprint(text))
    least = least_reachable(prints)
    want = sorted((d if d is not None else -1, f"{fingerprint(t):016x}", least.get(d, -1)) for d, t, *_ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in got) == want


def test_odd_rows(spark, docs, rows, empty):
    from groundwire.llm.simhash import simhash_duplicates

    out = simhash_duplicates(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    check(spark, rows, out.collect())
    assert simhash_duplicates(empty).count() == 0


def test_whole_table(spark, monkeypatch):
    from groundwire.llm import near_dup
    from groundwire.llm.queries import op13_simhash

    monkeypatch.setattr(near_dup, "HOT_ROWS", 3)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, op13_simhash(spark, "/root/testdata/sf0.001").collect())


def test_hash_is_the_library_s():
    from groundwire.llm.simhash import xxh64

    r = np.random.default_rng(1)
    data = r.integers(0, 256, 4000, dtype=np.uint8)
    sizes = [*range(0, 140), 255, 256, 257, 700]
    start = np.array([int(r.integers(0, 4000 - n)) for n in sizes])
    end = start + np.array(sizes)
    assert xxh64(data, start, end).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(start, end)]


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_block_finds_all_pairs(radius):
    from groundwire.llm.simhash import close_pairs

    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 8))) for b in base for _ in range(9)]
    fp = np.array([*base, *near, 0, (1 << 64) - 1], np.uint64)
    i, j = close_pairs(fp, radius)
    plain = [int(x) for x in fp]
    want = [(a, b) for a in range(fp.size) for b in range(a + 1, fp.size) if (plain[a] ^ plain[b]).bit_count() <= radius]
    assert sorted(zip(i.tolist(), j.tolist())) == want


def test_agreeing_groups_lose_no_pair():
    from groundwire.llm.simhash import BLOCK, _agreements

    r = random.Random(3)
    levels = _agreements(3)
    for _ in range(200):
        differ = sum(1 << k for k in r.sample(range(64), r.randint(0, 3)))
        paths = {0}
        for level in levels:
            paths = {child for path, child, mask in level if path in paths and not differ & mask}
            assert paths
    assert max(64 - mask.bit_count() for _, _, mask in levels[-1]) <= BLOCK.bit_length() - 1


def test_crowded_buckets_are_split(spark, monkeypatch):
    """Thousands of fingerprints that agree on one group of bits, with pairs at every distance around the radius."""
    from groundwire.llm import near_dup, simhash

    monkeypatch.setattr(near_dup, "HOT_ROWS", 500)
    r = random.Random(9)
    prints = {(r.getrandbits(48) << 16) | 0xBEEF for _ in range(3000)}
    linked = []
    for x in list(prints)[:40]:
        y = x ^ sum(1 << k for k in r.sample(range(64), 3))
        prints.add(y)
        linked.append({x, y})
    prints |= {x ^ sum(1 << k for k in r.sample(range(64), 4)) for x in list(prints)[100:130]}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    links = simhash.simhash_links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"))
    got = {frozenset((a % 2**64, b % 2**64)) for a, b in links.collect()}
    assert got == {frozenset(x) for x in linked}
