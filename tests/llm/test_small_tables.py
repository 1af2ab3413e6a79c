"""Odd rows for every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tagweave.llm import compression_quality, packing, simhash, toxicity
from tagweave.llm.queries import byte_bpe

ODD = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four five six"),
       (5, "one two three four five six"), (6, "x" * 300_000), (7, "word " * 60_000), (None, "one"), (8, "퟿ <|endoftext|> é")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "score", 1.0, "fp") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, stage_score double, fp string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0), (5, 0, 1), (5, 1, 1), (6, None, None), (7, 0, 1), (8, 1, 0), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda i: -1 if i is None else i)


WANT = sorted((i for i, _t in ODD), key=lambda i: -1 if i is None else i)


@pytest.mark.parametrize("operator", [toxicity, compression_quality])
def test_classifiers_on_odd_rows(operator, odd, labels):
    got = operator.judged(odd, labels)
    assert ids(got) == WANT
    assert all(0 <= r.score <= 1 and r.held_out is not None and r.predicted in (0, 1) for r in got.collect())
    assert operator.judged(odd.limit(0), labels).collect() == []
    unlabelled = operator.judged(odd, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} <= ({0.0, 1e-9} if operator is toxicity else {1.0}) or \
        max(r.score for r in unlabelled) < 1e-6


def test_packing_odd_rows(odd):
    got = packing.packed(odd, **byte_bpe()).collect()
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in got}) == sorted({-1 if i is None else i for i in WANT})
    check_sequences(got)
    assert sum(r.length for r in got if r.doc_id == 2) == 1
    assert packing.packed(odd.limit(0), **byte_bpe()).collect() == []


def check_sequences(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_simhash_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id for r in got)) == [-1 if i is None else i for i in WANT]
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


def test_stages_on_odd_rows(spark, odd, tmp_path, labels):
    folder = str(tmp_path)
    odd.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, rows, folder)
            assert kept.columns == odd.columns
            assert set(kept.collect()) <= set(rows.collect()), name
    kept = simhash.keep_one(odd).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept).count(5) == 1
    assert len({r.doc_id for r in kept}) == len(kept)


def test_fingerprint_by_hand():
    import xxhash
    words = "A b\tC\x0bd e".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(2)]
    assert simhash.fingerprint("A b\tC\x0bd e") == hashes[0] & hashes[1]
    assert simhash.fingerprint("A  B") == xxhash.xxh64_intdigest("a b", 42)
    assert simhash.fingerprint("Ä B") == xxhash.xxh64_intdigest("Ä b", 42)


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-2**62, 2**62, 300)
    near = np.concatenate([base] + [base[:60] ^ (1 << rng.integers(0, 63)) ^ (1 << rng.integers(0, 63)) for _ in range(8)])
    prints = np.concatenate([near, near[:50]])
    chain = np.array([sum(1 << k for k in range(4 * n)) for n in range(12)])  # each 4 bits from the next
    prints = np.concatenate([prints, chain])
    far = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= 4
    want = np.arange(len(prints))
    while True:
        new = np.array([want[row].min() for row in far])
        if (new == want).all():
            break
        want = new
    rows = spark.createDataFrame([(i, int(p)) for i, p in enumerate(prints)], "doc_id bigint, fp bigint")
    for tree in (2048, 16):  # with ordinary and with split shards
        joined = rows.join(simhash.components(rows, tree), "fp").collect()
        assert {r.doc_id: r.component_id for r in joined} == dict(enumerate(want.tolist()))


def test_forest_finds_all_near_members():
    rng = np.random.default_rng(5)
    v = np.unique(rng.integers(0, 2**12, 900).astype(np.uint64))
    shard = np.sort(rng.integers(0, 3, len(v)))
    x, y = simhash.Forest(v, shard, np.ones(len(v), bool)).search(np.arange(len(v)), 4)
    close = (np.bitwise_count(v[:, None] ^ v[None, :]) <= 4) & (shard[:, None] == shard) & ~np.eye(len(v), dtype=bool)
    assert set(zip(x.tolist(), y.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(close))))


@pytest.mark.parametrize("first_bands", [2, 16])
def test_stage_drops_near_copies_and_no_others(spark, monkeypatch, first_bands):
    """Planted copies at 0.8 to 0.95 go, those at 0.5 to 0.79 stay; lengths of 40 to 400 words, also split shards."""
    monkeypatch.setattr(simhash, "FIRST_BANDS", first_bands)
    rng = np.random.default_rng(11)
    rows, near, far = [], {}, set()

    def add(words):
        rows.append((len(rows), " ".join(map(str, words))))
        return len(rows) - 1

    for n in range(360):
        wanted = (0.5, 0.7, 0.79, 0.8, 0.85, 0.9, 0.95)[n % 7]
        words = rng.integers(0, 10**9, int(rng.integers(40, 400)))
        shingles = len(words) - 4
        shared = 2 * shingles * wanted / (1 + wanted)
        shared = int(np.floor(shared)) if wanted < 0.8 else int(np.ceil(shared))
        other = words.copy()
        other[shared + 4:] = rng.integers(10**9, 2 * 10**9, shingles - shared)
        sets = [{tuple(w[i:i + 5]) for i in range(shingles)} for w in (words.tolist(), other.tolist())]
        alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        a, b = add(words), add(other)
        far.add(a)
        if alike >= 0.8:
            near.setdefault(wanted, []).append(b)
        else:
            far.add(b)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    assert far <= kept
    lost = {wanted: sum(i in kept for i in ids_) for wanted, ids_ in near.items()}
    assert set(near) == {0.8, 0.85, 0.9, 0.95} and sum(lost.values()) <= 1, lost


def test_split_shards_of_near_copies():
    """A tree and its guests, taken in small steps, connect what all pairs do."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 100)
    sets = [np.unique(np.append(base[:rng.integers(70, 101)], rng.integers(0, 2**63, 12)).astype("<u8")) for _ in range(60)]
    want = np.arange(len(sets))
    alike = np.array([[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for a in sets] for b in sets])
    for _ in sets:
        want = np.array([want[row].min() for row in alike])
    links = []
    for own in range(3):
        mine = [(i, i % 3 != own) for i in range(len(sets)) if i % 3 <= own]
        mine.sort(key=lambda m: (m[1], m[0]))
        rows = [{"band": 0, "value": 7, "tree": own, "guest": guest, "node": i, "root": i, "fp": int(np.uint64(
            simhash._majority(sets[i])).astype(np.int64)), "shingles": sets[i].tobytes()} for i, guest in mine]
        batches = [pa.RecordBatch.from_pylist(rows[k:k + 5]) for k in range(0, len(rows), 5)]
        for made in simhash._confirm_shards(batches):
            links += zip(made.column("a").to_pylist(), made.column("b").to_pylist())
    got = np.arange(len(sets))
    for _ in sets:
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
    assert 1 < len(set(want.tolist())) < len(sets) and (got == want).all()
