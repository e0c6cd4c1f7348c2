"""The queries of the training-data operators against their SQL."""

import re
import zlib
from collections import defaultdict

import pytest
from larkspur.llm.catalog import QUERIES, SQL

from ..test_queries import duck, plain  # noqa: F401
from .test_dedup import bag, jaccard
from .test_scoring import brute_base


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):  # noqa: F811
    df, r = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    order = [r.columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in row) for row in df.collect()), key=repr) == want


def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_pii_counts(spark, sf_dir):
    """E-mail addresses and IP numbers by other patterns than the operator's."""
    texts = documents(spark, sf_dir)
    got = QUERIES["op2_pii"](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(texts) and any(r.n_emails for r in got)
    for r in got:
        t = texts[r.doc_id]
        assert r.n_emails == len(re.findall(r"\S+@[a-z0-9]+(?:\.[a-z0-9]+)*\.(?:com|org|net)\b", t)), t
        assert r.n_found == r.n_emails + r.n_phones + r.n_numbers + r.n_ips + r.n_dates
        assert (r.text == t) == (r.n_found == 0) and len(r.text.split("\n")) == len(t.split("\n"))


def test_near_copies_against_all_pairs(spark, sf_dir):
    bags = {i: bag(t) for i, t in documents(spark, sf_dir).items() if bag(t)}
    got = {r.doc_id: r for r in QUERIES["op3_minhash"](spark, sf_dir).collect()}
    ids, seen = sorted(bags), 0
    pairs = [(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if min(bags[i].total(), bags[j].total()) >= 0.6 * max(bags[i].total(), bags[j].total()) and jaccard(bags[i], bags[j]) >= 0.6]
    assert pairs
    for i, j in pairs:
        seen += got[i].class_id == got[j].class_id
    assert seen >= 0.95 * len(pairs)
    # Nothing is joined that no chain of such pairs joins.
    joined = {i: {i} for i in ids}
    for i, j in pairs:
        if joined[i] is not joined[j]:
            joined[i] |= joined[j]
            for k in joined[j]:
                joined[k] = joined[i]
    assert all(got[i].class_id in joined[i] for i in ids)


def test_toxicity_columns(spark, sf_dir):
    got = QUERIES["op5_toxicity"](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(documents(spark, sf_dir))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_shards_of_the_query(spark, sf_dir):
    texts = documents(spark, sf_dir)
    got = QUERIES["op7_sharding"](spark, sf_dir).collect()
    per = defaultdict(list)
    for r in got:
        t = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        per[r.shard].append(r)
    assert len(got) == len(texts) and all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in per.values())
    sizes = [sum(r["size"] for r in rs) for rs in per.values()]
    mean, largest = sum(sizes) / 40, max(r["size"] for r in got)
    assert all(abs(s - mean) <= largest for s in sizes)


def test_quality_columns(spark, sf_dir):
    texts = documents(spark, sf_dir)
    for r in QUERIES["op10_quality_rules"](spark, sf_dir).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(texts[r.doc_id])
        assert not (r.kept and r.base_failed) and 0 <= r.content_share <= 1
