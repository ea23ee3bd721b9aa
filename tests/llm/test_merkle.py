import hashlib
import random
import zlib

from cohortlens.llm import merkle


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    if v is None:
        return "-"
    v = str(v)
    return f"{len(v.encode())}:{v}"


def tree(nodes, fanout):
    """Levels of runs: a list of levels, each a list of node digests."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        levels.append([H("".join(cur[i:i + fanout])) for i in range(0, len(cur), fanout)])
    return levels


def siblings(levels, i, fanout):
    out, hashed = [], []
    for level in levels[:-1]:
        start = i // fanout * fanout
        run = level[start:start + fanout]
        out.append(("".join(run[:i - start]), "".join(run[i - start + 1:])))
        i //= fanout
    return out


def brute(rows, fanout=16):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = [H("".join(field(v) for v in r)) for r in rows]
    by = {}
    for k, r in enumerate(rows):
        by.setdefault(r[1], []).append(k)
    key = lambda s: (s is not None, (s or "").encode())
    sources = sorted(by, key=key)
    trees, subroot = {}, {}
    for s in sources:
        order = sorted(by[s], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf[k]))
        trees[s] = (order, tree([leaf[k] for k in order], fanout))
        subroot[s] = trees[s][1][-1][0]
    top = tree([subroot[s] for s in sources], fanout)
    root = top[-1][0]
    out = []
    for si, s in enumerate(sources):
        order, levels = trees[s]
        for i, k in enumerate(order):
            path = siblings(levels, i, fanout) + siblings(top, si, fanout)
            proof = H("".join(a + b for a, b in path))
            r = rows[k]
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            v = H("".join(field(x) for x in (r[0], r[1], r[2], r[3], text)))
            for a, b in path:
                v = H(a + v + b)
            out.append((r[0], leaf[k], subroot[s], root, proof, v, v == root))
    return sorted(out, key=repr)


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)
    for name in ("tree", "src", "level", "idx", "digest", "path", "sub", "leaf", "now_leaf"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n, seed=0):
    rng = random.Random(seed)
    sources = [None, "a", "b", "é", "ab", "Z"]
    rows = []
    for i in range(n):
        doc = None if i % 97 == 5 else rng.randint(0, 2**62) if i % 13 == 0 else i
        text = None if i % 31 == 7 else "".join(rng.choice("AbC dEf\n漢") for _ in range(rng.randint(0, 30)))
        rows.append((doc, rng.choice(sources[:2] * 20 + sources) if i % 5 else "a", rng.choice([None, "en"]), i % 7, text))
    rows += rows[:4] + [(3, "solo", "en", 1, "Only One")]
    return rows


def test_against_brute_force(spark):
    rows = corpus(700)
    assert got(merkle.tamper_check(docs(spark, rows))) == brute(rows)


def test_small_fanout_many_levels(spark):
    rows = corpus(300, seed=1)
    made = merkle.build(docs(spark, rows), fanout=3)
    want = brute(rows, fanout=3)
    assert made.root == want[0][3]
    got_rows = sorted(((r.doc_id, r.leaf, r.subroot, merkle_proof(r.path)) for r in made.rows.collect()), key=repr)
    assert got_rows == sorted(((w[0], w[1], w[2], w[4]) for w in want), key=repr)


def merkle_proof(path):
    return H("".join(e.left + e.right for e in path))


def test_one_row_and_empty(spark):
    one = [(7, None, None, None, None)]
    assert got(merkle.tamper_check(docs(spark, one))) == brute(one)
    empty = docs(spark, one).where("doc_id < 0")
    made = merkle.build(empty)
    assert made.root is None and made.rows.count() == 0
    assert merkle.tamper_check(empty).count() == 0


def test_long_text_and_hot_source(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "en", 1, "Word " * (20_000 if i == 4 else 3)) for i in range(600)]
    assert got(merkle.tamper_check(docs(spark, rows))) == brute(rows)
