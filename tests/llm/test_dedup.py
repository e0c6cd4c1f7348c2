"""Substring, line and near-duplicate operators against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from larkspur.llm import lines, minhash, substring
from larkspur.llm import tokens as tk
from larkspur.llm.sieve import Sieve

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substring(rows, window):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def planted(prose):
    a, b = prose(120), prose(70)
    rows = [(k, f"{prose(30)} {a} {prose(10)}") for k in range(10, 22)]
    rows += [(30, b), (31, f"{prose(5)}\n{b}\t{prose(5)}"), (32, b + " " + b), (9, " ".join(a.split()[20:75]))]
    return rows + [(40, a), (40, prose(80)), (40, a)]


def test_substring(docs, prose, odd):
    rows = planted(prose) + odd
    for window in (50, 5, 110):
        got = [tuple(r) for r in substring.substring_dedup(docs(rows), window=window).collect()]
        assert sorted(got, key=key) == sorted(brute_substring(rows, window), key=key)


def test_substring_levels():
    assert substring.levels(50) == [25, 50]
    assert substring.levels(200) == [25, 50, 100, 200]
    assert substring.levels(5) == [3, 5]


def brute_lines(rows, chars=40, n=5):
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    lower = {c: c + 32 for c in range(65, 91)}
    k = lambda x: x.strip(strip).translate(lower)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(k(x)) >= chars and i is not None:
                held[k(x)].add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        keep = [x for x in own if i is None or len(held.get(k(x), ())) < n or i == max(held[k(x)])]
        out.append((i, len(own), len(own) - len(keep), "\n".join(keep)))
    return out


def test_lines(docs, prose, odd):
    a, b, c = prose(5), "É" * 40, "x" * 39
    rows = [(k, f"{prose(3)}\n {a.upper()}\t\n{b}\n{c}\n{a}\n") for k in range(50, 58)] + [(60, a + "\r"), (60, b), (61, "")] + odd
    got = [tuple(r) for r in lines.line_dedup(docs(rows)).collect()]
    assert sorted(got, key=key) == sorted(brute_lines(rows), key=key)
    # A filter far too small suspects everything and changes nothing.
    got = [tuple(r) for r in lines.line_dedup(docs(rows), max_bits=1 << 10).collect()]
    assert sorted(got, key=key) == sorted(brute_lines(rows), key=key)


def test_empty_tables(docs):
    assert substring.substring_dedup(docs([])).count() == 0
    assert lines.line_dedup(docs([])).count() == 0
    assert [x.count() for x in minhash.near_duplicates(docs([]))] == [0, 0]


def bag(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def jaccard(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def test_bag_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 40, 50)
    b = np.maximum(1, a + rng.integers(-12, 12, 50))
    true, seen = np.minimum(a, b).sum() / np.maximum(a, b).sum(), []
    for seed in range(60):
        f = np.sort(tk.mix(np.arange(50, dtype=np.uint64), seed))
        s = minhash.signatures(np.repeat([0, 1], 50), np.concatenate([f, f]), np.concatenate([a, b]), 2)
        seen.append((s[0] == s[1]).mean())
    assert abs(np.mean(seen) - true) < 4 * np.std(seen) / 60**0.5


def test_overlap_is_exact(prose):
    a, b = prose(40), prose(40)
    for x, y in ((a, b), (a, a + " " + b), (a + " " + a, a), ("", a), ("one", "one"), ("one", "two")):
        assert abs(minhash.overlap(x, y) - jaccard(bag(x), bag(y))) < 1e-12


def near(prose, n, edits, seed):
    rng = np.random.default_rng(seed)
    base = prose(n).split()
    out = [" ".join(base)]
    for _ in range(edits):
        w = list(base)
        for p in rng.choice(n, max(1, n // 25), replace=False):
            w[p] = prose(1)
        out.append(" ".join(w))
    return out


def test_near_duplicates(docs, prose, odd):
    rows = [(k, prose(60)) for k in range(20)]
    groups = [near(prose, n, e, n) for n, e in ((60, 1), (200, 3), (90, 40), (12, 2))]
    for g in groups:
        start = len(rows) + 100
        rows += [(start + k, t) for k, t in enumerate(g)]
    rows += [(900, groups[0][0]), (901, groups[0][0].upper())] + [(r[0] and r[0] + 1000, r[1]) for r in odd]
    members, links = near_pairs(docs(rows))
    bags = {}
    for i, t in rows:
        if i is not None and bag(t):
            bags[i] = bag(t)
    # Components of all pairs at the threshold, by brute force.
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if jaccard(bags[i], bags[j]) >= 0.6:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {m.doc_id: m.class_id for m in members if m.doc_id in bags} == {i: root(i) for i in ids}
    for m in members:
        if m.doc_id not in bags:
            assert (m.class_id, m.copies, m.n_links) == (m.doc_id, 1, 0)
        else:
            assert m.copies == sum(bag(t) == bags[m.doc_id] for i, t in rows if i is not None)
    assert links and all(abs(jaccard(bags[r.a], bags[r.b]) - r.similarity) < 1e-12 and r.similarity >= 0.6 for r in links)


def near_pairs(df):
    members, links = minhash.near_duplicates(df)
    return members.collect(), links.collect()


def test_no_link_is_lost(docs, prose, monkeypatch):
    monkeypatch.setattr(minhash, "SALT", 7)
    base = prose(120).split()
    for home in (128, 4):
        monkeypatch.setattr(minhash, "HOME", home)
        rows = [(k, " ".join([*base[:k], "w%d" % k, *base[k + 1 :]])) for k in range(30)] + [(40 + k, prose(60)) for k in range(5)]
        rows += [(k + 100, t) for k, t in rows[:10]]  # exact copies add no link
        members, links = near_pairs(docs(rows))
        bags = {i: bag(t) for i, t in rows if i < 100}
        want = {(i, j): jaccard(bags[i], bags[j]) for i in bags for j in bags if i < j and jaccard(bags[i], bags[j]) >= 0.6}
        assert len(want) == 30 * 29 / 2
        assert sorted((r.a, r.b) for r in links) == sorted(want) and all(abs(want[r.a, r.b] - r.similarity) < 1e-12 for r in links)
        ends = Counter(i for pair in want for i in pair)
        assert {m.doc_id: (m.class_id, m.n_links) for m in members} == {i: (0 if i % 100 < 30 else i, ends[i % 100 if i >= 100 else i]) for i, _ in rows}


def test_one_of_each(docs, prose, odd):
    t = prose(50)
    rows = [(1, t), (2, t), (3, t + " more"), (4, prose(50)), (4, prose(50)), (None, t)] + [(r[0] and r[0] + 10, r[1]) for r in odd]
    kept = minhash.one_of_each(docs(rows))
    assert kept.columns == docs(rows).columns
    # The blank texts, the equal long ones and the rest; both null ids.
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 11, 12, 13, 14, 15, 17, 18, None, None])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(50, 51), (51, 52), (200, 200)]
    got = dict(minhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {50: 50, 51: 50, 52: 50}
    assert got == want


def test_queries_agree_with_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {tuple(r) for r in substring.op1_substring_dedup(spark, sf_dir).collect()}
    assert got == {(*r[:3], sha(r[3])) for r in brute_substring(rows, 50)}
    got = {tuple(r) for r in lines.op9_line_dedup(spark, sf_dir).collect()}
    assert got == {(*r[:3], sha(r[3])) for r in brute_lines(rows)}


def test_words_match_the_pattern(prose):
    texts = ["", " ", "a b", "\x0ba\x0c\r\nb c", "é ü", prose(20)]
    buf, offs = tk.string_buffers(pa.array(texts, pa.string()))
    s, e, first = tk.words(buf, offs, tk.SPACE)
    raw = buf.tobytes()
    for d, t in enumerate(texts):
        assert [raw[a:b].decode() for a, b in zip(s[first[d] : first[d + 1]], e[first[d] : first[d + 1]])] == WORD.findall(t)


def test_different_texts_under_one_id_stay(docs, prose, odd):
    t, a, b = prose(50), prose(50), prose(50)
    rows = [(1, t), (2, t), (3, t + " more"), (4, a), (4, b), (4, b), (5, a + " more"), (None, t), (None, t)] + [(r[0] and r[0] + 10, r[1]) for r in odd]
    kept = minhash.without_near_copies(docs(rows))
    assert kept.columns == docs(rows).columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    long = odd[4][1]
    # Of the near copies 4 and 5 the one with an id of its own stays; both null ids' rows stay.
    want = Counter([(1, t), (5, a + " more"), (4, b), (None, t), (None, t), (11, None), (12, ""), (13, " \t\n "), (14, "one"), (15, long), (None, "null id text " * 30), odd[8], odd[9]])
    want = Counter({(i + 10 if i in (7, 8) else i, x): n for (i, x), n in want.items()})
    assert got == want
    assert got == Counter((r.doc_id, r.text) for r in minhash.without_near_copies(docs(rows[::-1])).collect())
    assert minhash.without_near_copies(docs([])).count() == 0


@pytest.fixture
def splitting(spark):
    """Adaptive execution that divides whatever is twice the median."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_keys_are_divided(spark, docs, prose, splitting, monkeypatch):
    hot = prose(60)
    rows = [(k, f"u{k} v{k} {hot} w{k}") for k in range(1500)]
    plans = []
    for module in (substring, lines, minhash):
        real = module.durable

        def spy(df, real=real):
            out = real(df)
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return out

        monkeypatch.setattr(module, "durable", spy)
    got = substring.substring_dedup(docs(rows).repartition(8)).collect()
    assert sum(r.n_removed for r in got) == 60 * 1499
    assert sum("skew=true" in p for p in plans) >= 2
    plans.clear()
    own = [(k, f"{hot}\nu{k}") for k in range(1500)]
    assert sum(r.n_dropped for r in lines.line_dedup(docs(own).repartition(8)).collect()) == 1499
    assert any("skew=true" in p for p in plans)
    plans.clear()
    star = spark.range(1, 3000).selectExpr("0L as a", "id as b")
    assert minhash.components(star.repartition(8)).where("c = 0").count() == 3000
    assert any("skew=true" in p for p in plans)


def test_repeats_double_until_none_survives(docs, prose, odd):
    a, b = prose(230), prose(55)
    rows = [(k, f"u{k} {a} v{k}") for k in range(3)] + [(10, " ".join(a.split()[:120])), (11, b), (12, b + " x"), (13, prose(90)), (14, prose(20))] + [(None, a), (20, None)]
    got = dict(substring.repeat_lengths(docs(rows)).collect())
    assert got == {0: 200, 1: 200, 2: 200, 10: 100, 11: 50, 12: 50}
    assert substring.repeat_lengths(docs([(1, prose(80)), (2, prose(80))])).count() == 0 and substring.repeat_lengths(docs([])).count() == 0
    alone = [(1, prose(80)), (2, prose(80)), (3, None)]
    got = [tuple(r) for r in substring.substring_dedup(docs(alone)).collect()]
    assert sorted(got) == sorted(brute_substring(alone, 50))


def test_sieve_misses_none(spark):
    ids = spark.range(0, 30000, 3).selectExpr("id - 9000 as x").union(spark.sql("select cast(null as long)"))
    rows = spark.range(60000).selectExpr("id - 9000 as v").union(spark.sql("select cast(null as long)"))
    for bits, most in ((1 << 25, 20), (1 << 15, 60000)):
        held, rest = Sieve(ids, bits).split(rows, "v")
        held, rest = {r.v for r in held.collect()}, [r.v for r in rest.collect()]
        want = set(range(-9000, 21000, 3))
        assert want <= held and len(held - want) <= most and len(held) + len(rest) == 60001 and None in rest
    assert Sieve(ids.limit(0)).split(rows, "v")[0].count() == 0
