"""Mixing, sharding, decontamination and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from larkspur.llm import decontaminate, mixing, sharding
from larkspur.llm.toxicity import toxicity_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    t = mixing.targets([10, 500, 490], [5, 2, 1])
    assert t[0] == 30 and abs(sum(t) - 1000) < 1e-9 and abs(t[1] / t[2] - 2) < 1e-9
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_quotas_are_the_highest_quotients():
    rng = random.Random(4)
    for _ in range(60):
        t = [rng.choice([0.0, rng.random() * 10 ** rng.randint(0, 4), 7.0]) for _ in range(rng.randint(1, 9))]
        seats = rng.randint(0, 200)
        every = sorted((-x / (2 * k + 1), i) for i, x in enumerate(t) if x for k in range(seats))[:seats]
        want = Counter(i for _, i in every)
        assert mixing.quotas(t, seats) == [want[i] for i in range(len(t))]


def test_shard_quotas_add_up():
    t = [50.0, 20.0, 10.0, 1.0]
    rows = mixing.shard_quotas(t, 1003, 7)
    assert all(q >= 0 for r in rows for q in r)
    assert [sum(c) for c in zip(*rows)] == mixing.quotas(t, 1003)
    assert {sum(r) for r in rows} <= {143, 144}


def mix_rows(prose, odd):
    rows = [(k, prose(20 + k % 90), f"src{k % 4}") for k in range(400)] + [(k + 1000, t, None if k % 2 else "z") for k, (_, t) in enumerate(odd)]
    return rows + [(k + 5000, prose(3), "tiny") for k in range(3)]


def test_mix(docs, prose, odd):
    rows = mix_rows(prose, odd)
    got = mixing.mix(docs(rows)).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    by, taken, goal = defaultdict(int), defaultdict(int), {}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        by[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert all(r.source_size == by[source[r.doc_id]] for r in got)
    for s in by:
        assert abs(taken[s] - goal[s]) <= 2 * mixing.BLOCK * 3, s
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(rows)).collect()), key=str)
    assert mixing.mix(docs([])).count() == 0
    assert [r.taken for r in mixing.mix(docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_mixed_documents_are_what_is_taken(docs, prose, odd):
    df = docs([r for r in mix_rows(prose, odd) if r[0] != 1006])
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        own = WORD.findall(texts[r.doc_id])
        assert r.n_chars == len(r.text) and not Counter(WORD.findall(r.text)) - Counter(own)
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {i: n for i, n in taken.items() if n} == dict(words)


def check_shards(got, n_shards, sizes, tolerance):
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(0 <= s < n_shards for s in by)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    mean = sum(sizes) / n_shards
    assert all(abs(sum(r["size"] for r in by[s]) - mean) <= tolerance for s in range(n_shards))


def test_shards(docs, prose):
    hot = prose(40)
    rows = [(k, prose(5 + k % 60)) for k in range(3000)] + [(9000 + k, hot) for k in range(1500)] + [(20000 + k, t) for k in range(40) for t in [prose(30)] for _ in range(1)]
    got = sharding.shard(docs(rows), n_shards=10).collect()
    size = {i: len(t.encode()) + 16 for i, t in rows}
    crc = {i: zlib.crc32(t.encode()) for i, t in rows}
    assert len(got) == len(rows) and all(r["size"] == size[r.doc_id] and r.text_crc32 == crc[r.doc_id] for r in got)
    mean = sum(size.values()) / 10
    check_shards(got, 10, size.values(), 0.06 * mean)
    small = [(k, t) for k, t in enumerate([prose(20) for _ in range(200)] * 3)] + rows
    groups = defaultdict(set)
    for r in sharding.shard(docs(small), n_shards=4).collect():
        groups[r.text_crc32].add(r.shard)
    hot_crc = zlib.crc32(hot.encode())
    assert all(len(s) == 1 for c, s in groups.items() if c != hot_crc)


def test_shards_of_odd_rows(docs, odd):
    got = sharding.shard(docs(odd)).collect()
    assert sorted((r.doc_id or -1, r["size"], -1 if r.text_crc32 is None else r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, -1 if t is None else zlib.crc32(t.encode())) for i, t in odd)
    check_shards(got, 40, [r["size"] for r in got], 10**9)
    assert sharding.shard(docs([])).count() == 0
    df = docs(odd)
    placed = sharding.sharded_documents(df)
    assert placed.columns == [*df.columns, "shard", "slot"]
    assert Counter((r.doc_id, r.text) for r in placed.collect()) == Counter(odd)
    assert sharding.sharded_documents(docs([])).count() == 0


ITEMS = [(1, "Alpha beta Gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "kurz, ÉTÉ"), (3, ""), (4, None), (10, "one two three four five six seven eight nine ten"), (5, "one-two three")]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_hits(t, items):
    w, hit, found = words(t), set(), set()
    for k, item in items:
        q = words(item)
        for win in [q[i : i + 10] for i in range(max(1, len(q) - 9))] if q else []:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(str(k))
    return len(w), len(hit), sorted(found)


def contaminated(prose, odd):
    long = ITEMS[0][1]
    rows = [(k, f"{prose(40)} {long} {prose(3)}") for k in range(5)] + [(10, long.upper().replace(" ", ", ")), (11, " ".join(long.split()[:9])), (12, "kurz ÉTÉ kurz\nÉTÉ"), (13, "kurz été")]
    rows += [(14, "one two three four five six seven eight nine ten " * 3), (15, "one two"), (16, "three"), (17, " ".join(long.split()[1:] + ["x"]))]
    return rows + odd


@pytest.mark.parametrize("block", [4 << 20, 1])
def test_phrases(spark, docs, prose, odd, block):
    rows = contaminated(prose, odd)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.benchmark_matches(docs(rows), bench, slack=None, block_bytes=block).collect()
    have = Counter((r.doc_id, r.n_words, sum(x.stop - x.start for x in r.hits), tuple(sorted(r["items"]))) for r in got)
    want = Counter()
    for i, t in rows:
        n, hit, found = brute_hits(t, ITEMS)
        want[i, n, hit, tuple(found)] += 1
    assert have == want
    df = docs(rows)
    kept = decontaminate.without_contaminated(df, bench, block_bytes=block)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in rows if not brute_hits(t, ITEMS)[1])


@pytest.mark.parametrize("block", [4 << 20, 1])
def test_items_without_an_id_or_with_one_twice(spark, docs, block):
    bench = spark.createDataFrame([(None, "red green"), (7, "one two three"), (7, "four five six"), (8, "six seven")], "item_id long, text string")
    rows = [(1, "a one two three four five six seven"), (2, "red, green"), (3, "red one two"), (2, "green red")]
    got = decontaminate.benchmark_matches(docs(rows), bench, slack=None, block_bytes=block).collect()
    assert sorted((r.doc_id, sum(x.stop - x.start for x in r.hits), sorted(r["items"])) for r in got) == [(1, 7, ["7", "8"]), (2, 0, []), (2, 2, []), (3, 0, [])]
    kept = decontaminate.without_contaminated(docs(rows), bench, block_bytes=block).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(2, "green red"), (3, "red one two")]


def test_phrases_of_nothing(spark, docs, prose, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.hits and not r["items"] for r in decontaminate.benchmark_matches(docs(odd), bench).collect())
    assert decontaminate.benchmark_matches(docs([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_proximity(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    w = item.split()
    texts = {1: item, 2: " ".join(w[:4] + ["x"] + w[4:]), 3: " ".join(w[:3] + ["x"] + w[4:7] + ["y"] + w[8:]), 4: " ".join(w[::-1]), 5: " ".join(w[:6]), 6: " x x x x ".join(w)}
    got = {r.doc_id: (len(r["items"]), len(r.near_items)) for r in decontaminate.benchmark_matches(docs(list(texts.items())), bench).collect()}
    assert got == {1: (1, 1), 2: (0, 1), 3: (0, 1), 4: (0, 0), 5: (0, 0), 6: (0, 0)}


def test_proximity_belongs_to_its_document(spark, docs, tmp_path):
    w = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    # A clean text, then one that starts at the item's second or third word.
    texts = [(1, "u v"), (2, " ".join(w[1:]) + " x"), (3, "u v"), (4, " ".join(w[2:])), (5, "u v"), (6, " ".join(w[:8])), (7, "u v"), (8, " ".join(w))]
    df = docs(texts).coalesce(1)
    got = {r.doc_id: (len(r["items"]), list(r.near_items)) for r in decontaminate.benchmark_matches(df, bench).collect()}
    assert got == {i: (int(i == 8), ["1"] * (i % 2 == 0)) for i, _ in texts}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = decontaminate.QUERIES["op8_near_matches"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_items, r.n_near_items, r.contaminated) for r in rows} == {i: (int(i == 8), int(i % 2 == 0), i % 2 == 0) for i, _ in texts}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    states = [docs]
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, states[-1], sf_dir)
        states.append(spark.createDataFrame(out.collect(), out.schema))
    for s in states[1:-1]:
        assert s.columns == docs.columns
    ids = [Counter(r.doc_id for r in s.collect()) for s in states]
    scores = {r.doc_id: r.score for r in toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert set(ids[1]) == {i for i, s in scores.items() if s < 0.7}
    from .test_dedup import bag, jaccard

    kept = {r.doc_id: bag(r.text) for r in states[1].collect() if bag(r.text)}
    stay = sorted(set(ids[2]) & set(kept))
    for x, i in enumerate(stay):
        assert all(jaccard(kept[i], kept[j]) < 0.6 for j in stay[:x])
    for i in set(kept) - set(stay):
        assert any(jaccard(kept[i], kept[j]) >= 0.6 for j in kept if j < i)
    for r in states[2].collect():
        assert (r.doc_id in ids[3]) == (not brute_hits(r.text, bench)[1])
    assert set(ids[4]) <= set(ids[3]) and len(ids[4]) > 0.5 * len(ids[3])
    assert ids[5] == ids[4]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == ids[5]
    assert sorted((r.shard, r.slot) for r in rows) == sorted((r.shard, r.slot) for r in states[5].collect())


def brute_near(t, items, slack=2, share=0.8):
    w, found = words(t), set()
    for k, item in items:
        q = words(item)
        for win in [q[i : i + 10] for i in range(max(1, len(q) - 9))] if q else []:
            for p in range(-len(win), len(w)):
                n = sum(x in w[max(p + i - slack, 0) : max(p + i + slack + 1, 0)] for i, x in enumerate(win))
                if n >= share * len(win) - 1e-9:
                    found.add(str(k))
    return found


@pytest.mark.parametrize("block", [2 << 20, 300, 1])
def test_near_matches_equal_brute_force(spark, docs, block):
    rng = random.Random(5)
    few = [f"w{k}" for k in range(14)]
    items = [(k, " ".join(rng.choices(few, k=rng.choice([1, 2, 3, 5, 9, 10, 13, 90])))) for k in range(12)]
    rows = [(k, " ".join(rng.choices(few + [f"x{k}" for k in range(8)], k=rng.choice([0, 1, 4, 9, 12, 30])))) for k in range(60)]
    rows += [(100 + k, " ".join(w for w in t.split() if rng.random() < 0.9)) for k, (_, t) in enumerate(items)]
    got = decontaminate.benchmark_matches(docs(rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    want = {i: brute_near(t, items) for i, t in rows}
    assert {r.doc_id: set(r.near_items) for r in got} == want and 10 < sum(map(bool, want.values())) < len(rows)
    assert all(set(r["items"]) <= set(r.near_items) for r in got)


def test_groups_stay_whole_where_they_fit(docs, prose):
    rows = [(k, prose(5 + k % 60)) for k in range(1500)]
    mean = sum(len(t.encode()) + 16 for _, t in rows) / 4
    # Groups of 0.6, 0.3, 0.2 and 2.5 of about a shard of 8.
    for n, share in enumerate((0.6, 0.6, 0.3, 0.2, 0.2, 2.5)):
        t = prose(30)
        rows += [(100000 * (n + 1) + k, t) for k in range(int(share * mean / (len(t) + 16)))]
    got = sharding.shard(docs(rows), n_shards=8).collect()
    sizes = [len(t.encode()) + 16 for _, t in rows]
    check_shards(got, 8, sizes, 0.06 * sum(sizes) / 8)
    per = defaultdict(set)
    for r in got:
        per[r.text_crc32].add(r.shard)
    assert sorted(len(s) for s in per.values())[-2:][0] == 1 and max(map(len, per.values())) >= 2


def test_packed_groups():
    homes, loads = sharding._packed({1: 60, 2: 60, 3: 60, 4: 40, 5: 30, 6: 500}, 3, 100.0)
    assert homes == {6: -1, 1: 0, 2: 1, 3: 2, 4: 0, 5: 1} and sorted(loads) == [60, 90, 100]


def test_rows_that_cannot_be_told_apart(docs):
    got = sharding.shard(docs([(None, "same text")] * 500 + [(None, None)] * 500), n_shards=5).collect()
    check_shards(got, 5, [r["size"] for r in got], 10**6)


def test_the_sample_is_no_larger_with_more_tasks(docs, prose):
    df = docs([(k, prose(3)) for k in range(4000)]).repartition(16)
    rows = df.select(*[c.alias(k) for k, c in sharding._keyed(df, "doc_id", "text", 16).items()])
    total = rows.agg({"size": "sum"}).first()[0]
    drawn = sharding._sample(rows, 200, 3, total)
    assert 130 < len(drawn) < 270


def test_first_shards_follow_the_quotas(docs, prose, odd):
    rows = mix_rows(prose, odd)
    got = mixing.mix(docs(rows), n_shards=7).collect()
    plan = mixing.plan(docs(rows), "source", mixing.size_of("text"), n_shards=7)
    assert [sum(c) for c in zip(*plan.shards)] == plan.quotas and {sum(r) for r in plan.shards} <= {sum(plan.quotas) // 7, sum(plan.quotas) // 7 + 1}
    assert all((r.first_shard is None) == (r.taken == 0) and (r.first_shard is None or 0 <= r.first_shard < 7) for r in got)
    assert {r.first_shard for r in got} >= set(range(5))
    # By hand: a source's documents in their order, its blocks in theirs.
    import hashlib
    import math

    source = {i: s for i, _, s in rows}
    by = defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            by[source[r.doc_id]].append((hashlib.md5(f"1-{r.doc_id}".encode()).hexdigest(), r.doc_id, r["size"], r.first_shard, r.taken))
    for s in ("src1", "tiny"):
        i, at = plan.sources.index(s), 0
        q, m = min(plan.quotas[i], 3 * plan.blocks[i]), plan.blocks[i]
        a = mixing.multiplier(m, 1, i)
        assert math.gcd(a, m) == 1
        ends = [sum(x[i] for x in plan.shards[: k + 1]) for k in range(7)]
        for _, _, n, shard, taken in sorted(by[s]):
            seats = [((a * j + (7919 + i * 104729) % m) % m, min(at + n, (j + 1) * 64) - max(at, j * 64)) for j in range(at // 64, (at + n - 1) // 64 + 1)]
            assert taken == sum(w * (q // m + (k < q % m)) for k, w in seats)
            used = [k for k, _ in seats if q >= m or k < q % m]
            assert shard == (sum(e <= min(used) for e in ends) if used else None)
            at += n


def test_multipliers_are_prime_to_the_blocks():
    import math

    for m in [1, 2, 3, 6, 30, 210, 3171, 2310, 30030, 9699690, 10**12]:
        got = [mixing.multiplier(m, 1, i) for i in range(20)]
        assert all(math.gcd(a, m) == 1 for a in got)
        if m > 3000:
            assert len(set(got)) > 5 and min(got) > m // 3 and mixing.multiplier(m, 2, 0) != got[0]
