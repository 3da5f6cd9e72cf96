"""SimHash groups, ranked search and spelling variants against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from drivelaws.llm import lexical, simhash, spelling
from drivelaws.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, fp long, word string, term string, n long, cell string, component string"


def with_clashes(spark, rows):
    return spark.createDataFrame([(*r, 7, "w", "t", 1, "c", "k") for r in rows], DOCS)


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [words[i:i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fps, distance=4):
    root = {x: x for x in set(fps)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(root)
    for i, x in enumerate(names):
        for y in names[i + 1:]:
            if (x ^ y).bit_count() <= distance:
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    return {x: top(x) for x in names}


def expected_groups(rows):
    of = grouped([fingerprint(t) for _, t in rows])
    least = {}
    for k, t in rows:
        g = of[fingerprint(t)]
        if k is not None:
            least[g] = min(least.get(g, k), k)
    return sorted(((k, f"{fingerprint(t):016x}", least.get(of[fingerprint(t)])) for k, t in rows), key=str)


def test_simhash_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    out = simhash.near_duplicates(table(spark, SF, "documents"))
    assert sorted(map(tuple, out.collect()), key=str) == expected_groups(rows)


def test_simhash_edges(spark):
    base = [f"word{i}" for i in range(400)]
    near = " ".join(base[:200] + ["Other"] + base[201:])
    rows = [(5, " ".join(base)), (3, "\t".join(base).upper()), (2, near), (9, None), (8, ""), (7, " \n "), (6, "one"), (6, "one"),
            (None, "one"), (None, "only null keys"), (1, "Ünï cöde drei"), (4, "a b c d e"), (10, "x" * 300_000), (11, "a b c d e " * 40_000)]
    out = simhash.near_duplicates(with_clashes(spark, rows)).collect()
    assert sorted(map(tuple, out), key=str) == expected_groups(rows)
    assert {r["component_id"] for r in out if r["doc_id"] in (7, 8, 9)} == {7}
    assert simhash.near_duplicates(with_clashes(spark, rows).filter("false")).count() == 0


@pytest.mark.parametrize("crowded", [4, 4096])
def test_fingerprints_that_link(spark, crowded):
    rnd = random.Random(crowded)
    fps = {rnd.getrandbits(64) for _ in range(200)}
    for seed in [rnd.getrandbits(64) for _ in range(6)]:
        for _ in range(60):  # chains and dense families
            seed ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5)))
            fps.add(seed)
    center = rnd.getrandbits(64)
    fps |= {center ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.near_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5), crowded=crowded)
    got = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in found.collect()}
    groups, theirs = {}, {}
    for x, g in grouped(fps).items():
        theirs.setdefault(g, set()).add(x)
    for x in fps:
        groups.setdefault(got.get(x, x), set()).add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in theirs.values()}


def test_embedding_is_a_lower_bound_and_grids_lose_nothing():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (20_000, 4), dtype=np.uint64), axis=1)
    apart = np.bitwise_count(simhash.embedded(a) ^ simhash.embedded(a ^ flips))
    assert (apart <= np.bitwise_count(flips)).all()
    share = np.zeros(len(a), bool)
    for mask in np.array(simhash.grids(7, 4), np.uint64):
        share |= (simhash.embedded(a) & mask) == (simhash.embedded(a ^ flips) & mask)
    assert share.all()


def best_documents(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    spoken = [(key, Counter(split(text)), len(split(text))) for key, text in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in spoken), sum(n for _, _, n in spoken)
    df, out = Counter(t for _, c, _ in spoken for t in c), []
    for item, text in items:
        scores = []
        for key, counts, n in spoken:
            m = 75 + 25 * n * n_docs // max(n_terms, 1)
            scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * counts[t] // (1000 * counts[t] + 12 * m))
                               for t in split(text) if counts[t]), key))
        scores = sorted((-s, key is None, key or 0, key) for s, key in scores if s > 0)[:k]
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(scores)]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings", [30, 200_000])
def test_ranked_search_against_brute_force(spark, postings):
    rnd = random.Random(2)
    say = lambda n: " ".join(rnd.choice(["alpha", "Beta", "gämma", "ÉTÉ", "été", "x1", "2", "delta-eps", "zeta", "q"]) for _ in range(n))
    docs = [(i, say(rnd.randint(1, 30))) for i in range(80)]
    docs += [(5, docs[5][1]), (200, docs[5][1]), (None, docs[5][1]), (201, None), (202, ""), (203, "?! -"), (204, "zeta " * 200_000)]
    items = [(i, say(rnd.randint(1, 12))) for i in range(12)] + [(3, "Zeta zeta"), (None, "q"), (50, None), (51, ""), (52, "nowhere")]
    rows = spark.createDataFrame([(t, *r) for r, t in zip(items, "abcdefghijklmnopqrst")], "term string, item_id long, text string")
    out = lexical.ranked(with_clashes(spark, docs).repartition(6), rows, k=7, postings=postings)
    assert sorted(map(tuple, out.collect()), key=str) == best_documents(docs, items, 7)
    assert lexical.ranked(with_clashes(spark, docs).filter("false"), rows).count() == 0
    assert lexical.ranked(with_clashes(spark, docs), rows.filter("false")).count() == 0


def spelled(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, many = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        many[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], many[w], n[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowded", [3, 20_000])
def test_spelling_against_brute_force(spark, crowded):
    rnd = random.Random(crowded)
    words = ["".join(rnd.choice("aábcÉéz") for _ in range(rnd.randint(4, 8))) for _ in range(60)]
    for w in list(words):
        for _ in range(6):
            i = rnd.randrange(len(w))
            words.append(rnd.choice([w[:i] + w[i + 1:], w[:i] + rnd.choice("abcéZ") + w[i:], w[:i] + rnd.choice("abcéz") + w[i + 1:], w.upper()]))
    docs = [(i, rnd.choice([" ", "1", ", ", "\n"]).join(rnd.choice(words) for _ in range(60))) for i in range(150)]
    long = "x" * 3000 + "yz" * 500
    docs += [(None, "aaaaa aaaab " * 9), (None, None), (1, ""), (2, "aaaaa"), (2, "aaaaa"), (400, f"{long} {long}a {long[1:]}b " * 4), (401, "abcde" * 60_000)]
    out = spelling.variants(with_clashes(spark, docs).repartition(5), crowded=crowded)
    assert sorted(map(tuple, out.collect()), key=str) == spelled(docs)
    assert spelling.variants(with_clashes(spark, docs).filter("false")).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(37)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got) == {w for w, _ in chain} and set(got.values()) == {"w37"}
