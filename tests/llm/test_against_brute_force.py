"""Operators and stages against brute force, library results, hand-worked rows or held-out accuracy."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

import corpus_pipeline
from tagweave.llm import (bm25, compression_quality, kmeans_tree, packing, preferences, sentencepieces, simhash,
                          toxicity, url_rules, wordpiece_counts)
from tagweave.llm.queries import QUERIES, byte_bpe

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}


def held_out_errors(spark, operator, label, folder="/root/testdata/sf0.1"):
    got = operator.judged(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    return collections.Counter((r[label], r.predicted) for r in rows)


def test_toxicity_held_out(spark):
    seen = held_out_errors(spark, toxicity, "toxic")
    assert seen[1, 1] >= 0.8 * (seen[1, 0] + seen[1, 1]) and seen[0, 1] <= 0.01 * seen[0, 0]


def test_quality_held_out(spark):
    seen = held_out_errors(spark, compression_quality, "quality")
    assert seen[0, 0] >= 0.6 * (seen[0, 0] + seen[0, 1]) and seen[1, 0] <= 0.01 * seen[1, 1]


def test_folds(spark):
    for name, parts, held in (("op1_toxicity", 3, 1), ("op10_quality_classifier", 5, 0)):
        for r in QUERIES[name](spark, SMALL).collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held)


def test_word_pieces_against_the_library(spark, docs):
    pieces = wordpiece_counts.pieces_of(MODEL)
    library = models.WordPiece({p: i for i, p in enumerate(pieces)} | {"[UNK]": len(pieces)}, unk_token="[UNK]",
                               max_input_chars_per_word=10**6)
    for r in QUERIES["op2_wordpiece_counts"](spark, SMALL).collect():
        cut = [library.tokenize(w) for w in wordpiece_counts.WORD.findall(docs_of(spark, SMALL)[r.doc_id])]
        assert (r.n_words, r.n_tokens) == (len(cut), sum(map(len, cut)))
        assert r.n_unknown == sum(c[0].value == "[UNK]" for c in cut)


def docs_of(spark, folder, kept={}):
    if folder not in kept:
        kept[folder] = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    return kept[folder]


def test_automaton_on_random_vocabularies():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab") for _ in range(rng.randint(1, n)))
    for _ in range(100):
        pieces = list({word(4) for _ in range(5)} | {"##" + word(5) for _ in range(5)})
        library = models.WordPiece({p: i for i, p in enumerate(pieces)} | {"[UNK]": 99}, unk_token="[UNK]")
        automaton = wordpiece_counts.Automaton(pieces)
        for w in (word(12) + rng.choice(["", "c"]) for _ in range(30)):
            cut = library.tokenize(w)
            assert automaton.count(w) == (0 if cut[0].value == "[UNK]" else len(cut))


def test_sentencepiece_digests(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in QUERIES["op5_sentencepiece"](spark, SMALL).collect():
        text = docs_of(spark, SMALL)[r.doc_id]
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.span_bytes == len(text.encode())
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


TRICKY = ["", " ", "a  b", " a", "a ", "▁", "a▁ b", "\n \n x", "日本 語\x00 é", "<s> </s>", "é é ｶﾞ ﬁ ㌔ Ⅷ", "x" * 3000]


def test_sentencepiece_spans_and_round_trip(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = spark.createDataFrame(list(enumerate(TRICKY)) + [(99, None)], "doc_id bigint, text string")
    got = sentencepieces.encoded(rows, MODEL, ["doc_id"])
    for r in got.collect():
        text = TRICKY[r.doc_id] if r.doc_id < 99 else ""
        proto = library.encode(text, return_type="proto")
        assert list(zip(r.starts, r.ends))[1:-1] == [(p.begin, p.end) for p in proto.pieces]
        assert r.ids == library.encode(text, add_bos=True, add_eos=True)
    back = {r.doc_id: r.text for r in sentencepieces.decoded(got, MODEL, ["doc_id"]).collect()}
    assert all(back[i] == library.decode(library.encode(t)) for i, t in enumerate(TRICKY)) and back[99] == ""


def test_normaliser_against_the_library():
    for rule in ("nmt_nfkc", "identity"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        own = sentencepieces.Normalizer(**sentencepieces.normalizer_of(library.serialized_model_proto()))
        for text in TRICKY:
            raw, place = own(text)
            chars = np.cumsum([0, *(len(c.encode()) for c in raw.decode())])
            source = np.cumsum([0, *(len(c.encode()) for c in text)])
            want = library.normalize(text, with_offsets=True)
            assert (raw.decode(), np.searchsorted(source, place[chars]).tolist()) == (want[0], list(want[1]))


def test_packing_against_the_tokenizer(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op6_best_fit_packing"](spark, SMALL).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    texts = docs_of(spark, SMALL)
    assert by.keys() == texts.keys()
    for doc_id, parts in by.items():
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (r.length == 2048 or n == 0)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start:at].tobytes())
        assert at == len(ids)
    room = collections.Counter()
    for r in rows:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048 and len(room) <= -(-sum(room.values()) // 2048) + 1


def test_fast_ids_are_the_tokenizers(docs):
    encode = packing.Encoder(**byte_bpe())
    odd = ["a\x85b \xa0 c\x1c d", "don't DON'T  x's", "é" * 50 + "\n\n \t\n", "<|endoftext|> x", "x" * 5000, " " * 3000, "½ ²³ ªº", "Ɏɏɐ"]
    odd += ["".join(map(chr, range(k, k + 40))) + " a" for k in range(0, 0x260, 40)]
    for text in [*odd, *list(docs.values())[:300]]:
        assert encode(text).tolist() == encode.exact.encode(text, add_special_tokens=False).ids


def test_plans_hold_every_length_and_beat_best_fit():
    rng, better = random.Random(2), 0
    for _ in range(400):
        room, counts = rng.choice([10, 20, 50]), {}
        for _ in range(rng.randint(1, 9)):
            counts[rng.randint(1, room)] = rng.randint(1, 4)
        sizes = []
        for made in (packing.best_fit(counts, room), packing.plan(counts, room)):
            held = collections.Counter()
            for pattern, times in made:
                assert sum(s * n for s, n in pattern) <= room
                for s, n in pattern:
                    held[s] += n * times
            assert held == counts
            sizes.append(sum(t for _p, t in made))
        assert sizes[1] <= sizes[0]
        better += sizes[1] < sizes[0]
    assert better > 0


def brute_near(vectors, ids, query, k):
    score = {i: float((v * vectors[query]).sum()) for i, v in zip(ids, vectors) if i != ids[query]}
    return heapq.nsmallest(k, score, key=lambda i: (-score[i], i)), score


def test_neighbours_recall_and_scores(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    vectors, ids = np.stack(data.embedding).astype(float), data.vec_id.to_numpy()
    got = collections.defaultdict(list)
    for r in QUERIES["op4_nearest_neighbours"](spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hit = 0
    queries = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[queries].tolist())
    for q in queries:
        near, score = brute_near(vectors, ids, q, 20)
        rows = got[ids[q]]
        assert [r.rank for r in rows] == list(range(1, 21))
        assert all(r.score == score[r.vec_id] for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hit += len({r.vec_id for r in rows} & set(near))
    assert hit >= 0.9 * 20 * len(queries)


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 7)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0]), (62, [nan, 1.0]), (63, [inf, 1.0]),
            (64, [None, 1.0]), (65, [1.0]), (None, [1.0, 1.0]), (5, [1.0, 5.0])] + [(i, [2.0, 2.0]) for i in range(100, 180)]
    table = spark.createDataFrame([(*r, "leaf") for r in rows], "vec_id bigint, embedding array<float>, leaf string")
    fine = {i: v for i, v in rows if i is not None and v is not None and len(v) == 2 and None not in v
            and np.isfinite(v).all() and any(v)}
    vectors, ids = np.array(list(fine.values())), np.array(list(fine))
    got = collections.defaultdict(list)
    for r in kmeans_tree.search(table, F.col("vec_id") % 20 == 0, 20, target=1.0).collect():
        got[r.query_id].append(r)
    assert set(got) == {i for i in fine if i % 20 == 0}
    for q, i in enumerate(ids):
        if i % 20 == 0:
            assert [r.vec_id for r in sorted(got[i], key=lambda r: r.rank)] == brute_near(vectors, ids, q, 20)[0]
    assert kmeans_tree.search(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def brute_bm25(texts, queries, k):
    bags = {i: collections.Counter(bm25.WORD.findall((t or "").lower())) for i, t in texts.items()}
    n, size = len(bags), {i: sum(b.values()) for i, b in bags.items()}
    mean, held = sum(size.values()) / n, collections.Counter(w for b in bags.values() for w in b)
    out = {}
    for q in queries:
        score = {i: sum(math.log(1 + (n - held[w] + 0.5) / (held[w] + 0.5)) * b[w] * (bm25.K1 + 1)
                        / (b[w] + bm25.K1 * (1 - bm25.B + bm25.B * size[i] / mean)) for w in bags[q] if w in b)
                 for i, b in bags.items()}
        out[q] = heapq.nsmallest(k, ((-round(s, 6), i) for i, s in score.items() if s > 0))
    return out


@pytest.mark.parametrize("shard, words, step", [(bm25.SHARD, bm25.QUERY_TERMS, bm25.STEP), (100, 700, 64)])
def test_exact_search(spark, docs, monkeypatch, shard, words, step):
    monkeypatch.setattr(bm25, "SHARD", shard)
    monkeypatch.setattr(bm25, "QUERY_TERMS", words)
    monkeypatch.setattr(bm25, "STEP", step)
    texts = dict(list(docs.items())[:400]) | {1000: None, 1050: "", 1051: docs[0], 1052: docs[0]}
    rows = spark.createDataFrame([*texts.items(), (1051, docs[0]), (None, "x")], "doc_id bigint, text string")
    got = collections.defaultdict(list)
    for r in bm25.search(rows, F.col("doc_id") % 50 == 0, 10).collect():
        got[r.query_id].append((-round(r.score, 6), r.doc_id))
    want = brute_bm25(texts, [i for i in texts if i % 50 == 0], 10)
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert bm25.search(rows.limit(0), F.col("doc_id") % 50 == 0).collect() == []


def test_search_finds_every_text_of_an_id(spark):
    said = [(1, "alpha beta gamma delta zeta"), (1, "omega"), (1, "omega"), (1, "omega psi " * 20_000), (2, "omega alpha"), (3, "beta"),
            (50, "alpha beta"), (50, "psi"), (4, "psi"), (5, None), (6, "")]
    rows = spark.createDataFrame([(i, t, 7, "s", 8) for i, t in said], "doc_id bigint, text string, size int, slice string, k int")
    for k in (1, 2, 3, 10):
        got = [(r.rank, r.doc_id, r.score) for r in bm25.search(rows, F.col("doc_id") % 50 == 0, k).orderBy("rank").collect()]
        every = brute_bm25({n: t for n, (_i, t) in enumerate(dict.fromkeys(said))}, [5, 6], 100)
        ids, best = [i for i, _t in dict.fromkeys(said)], {}
        for score, n in every[5] + every[6]:
            best[ids[n]] = min(best.get(ids[n], 0), score)
        want = heapq.nsmallest(k, ((s, i) for i, s in best.items()))
        assert [(-round(s, 6), i) for _r, i, s in got] == want
        assert {1, 50} <= {i for _r, i, _s in got} or k < 3


URLS = [None, "", "no scheme/en/", "http://Example.COM/en/a", "https://www.example.com/en/", "http://a.www.example.com/en/x?y#z",
        "ftp://example.net/es/q", "http://net/fr/", "http://xnet/fr/", "http://example.com?x=/en/", "http://example.com",
        "http://a.com/x://b.net/es/", "http:///en/", "http://é.Ünet/es/", "http://.com/", "http://" + "a." * 5000 + "com/" + "p" * 9000]


def test_url_rules_against_a_walk(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block"), ("net", "/fr/", "allow"), (None, "/", "block")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x"), (None, URLS[6], "y")],
                                  "page_id bigint, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_rules.judged(pages, table, ["page_id"]).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is None:
            assert r.rule == "net/es/"
            continue
        url = URLS[r.page_id] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:][:min([rest[cut:].find(c) for c in "?#" if c in rest[cut:]], default=len(rest))]
        fits = sorted(((len(h + p), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h))
                       and path.startswith(p)))
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((fits[-1][2], fits[-1][1]) if fits else (None, "allow"))
    assert {r.verdict for r in url_rules.judged(pages, table.limit(0), ["page_id"]).collect()} == {"allow"}
    assert url_rules.judged(pages.limit(0), table, ["page_id"]).collect() == []


def test_preference_segments(spark):
    kind = "pair_id bigint, turn bigint, role string, text string, part string"
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "yes"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 5, None, None),
              (3, 0, "user", "alone"), (4, 0, "user", "same"), (4, 2000, "assistant", "same"), (None, 0, "user", "x"), (1, None, "user", "x")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (2, 0, "user", "b"), (4, 0, "user", "same"),
                (4, 2000, "assistant", "same"), (5, 0, "user", "alone")]
    sides = [spark.createDataFrame([(*r, "part") for r in rows], kind) for rows in (chosen, rejected)]
    got = {r.pair_id: r for r in preferences.assembled(preferences.segments(*sides)).collect()}
    assert set(got) == {1, 2, 4}
    one = got[1]
    assert one.prompt == "<|user|>\nq<|end|>\n" and one.chosen == "<|assistant|>\nyes<|end|>\n"
    assert one.rejected == "<|assistant|>\nno<|end|>\n<|user|>\nwhy<|end|>\n"
    assert [one.chosen[a:b] for a, b in one.chosen_spans] == ["yes<|end|>\n"]
    assert [one.rejected[a:b] for a, b in one.rejected_spans] == ["no<|end|>\n"]
    assert (got[2].prompt, got[2].rejected) == ("", "<|user|>\nb<|end|>\n")
    assert got[2].chosen == "<|user|>\na<|end|>\n<||>\n<|end|>\n" and got[2].chosen_spans == []
    assert got[4].prompt.count("same") == 2 and got[4].chosen == got[4].rejected == ""
    assert preferences.segments(*(s.limit(0) for s in sides)).collect() == []


def one_of_each(rows):
    """Smallest doc_id of each group of rows linked by a Jaccard similarity of 0.8 or more of their 5-word shingles."""
    sets, holders = {}, collections.defaultdict(list)
    for r in rows:
        words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
        sets[r.doc_id] = {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
        for shingle in sets[r.doc_id]:
            holders[shingle].append(r.doc_id)
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, own in sets.items():
        for j, n in collections.Counter(j for shingle in own for j in holders[shingle]).items():
            if i < j and 5 * n >= 4 * (len(own) + len(sets[j]) - n):
                low, high = sorted((top(i), top(j)))
                label[high] = low
    empty = sorted(i for i, own in sets.items() if not own)
    return sorted(i for i in sets if label[i] == i and i not in empty[1:])


def test_pipeline_against_brute_force(spark):
    """Each stage redone plainly on what the one before kept."""
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    texts = docs_of(spark, MIDDLE)
    quality, toxic, near, pack = (stage for _name, stage in corpus_pipeline.STAGES)
    kept = quality(spark, rows, MIDDLE).collect()
    assert all(texts[r.doc_id] == r.text for r in kept)
    wrong = [r.doc_id for r in kept if r.doc_id in labels and labels[r.doc_id].quality == 0]
    lost = {i for i, l in labels.items() if l.quality == 1} - {r.doc_id for r in kept}
    assert len(lost) <= 0.02 * len(labels) and len(wrong) <= 0.05 * len(labels)
    second = toxic(spark, spark.createDataFrame(kept, rows.schema), MIDDLE).collect()
    assert {r.doc_id for r in second} < {r.doc_id for r in kept}
    third = near(spark, spark.createDataFrame(second, rows.schema), MIDDLE).collect()
    assert sorted(r.doc_id for r in third) == one_of_each(second)
    packed = pack(spark, spark.createDataFrame(third, rows.schema), MIDDLE).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in third}
    run = corpus_pipeline.run(spark, MIDDLE).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(run) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_every_conversation_with_an_answer_is_a_pair(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (3, 0, "assistant", "d"),
            (9, 0, "assistant", "e"), (9, 1, "assistant", "f"), (20, 0, "user", "g"), (20, 1, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    chosen, rejected = preferences.other_endings(turns)
    assert sorted((r.pair_id, r.turn, r.text or "") for r in chosen.collect()) == sorted(
        (i, t, x or "") for i, t, _r, x in rows if i != 2)
    last = {r.pair_id: r.text for r in sorted(rejected.collect(), key=lambda r: r.turn)}
    assert last == {1: "d", 3: "f", 9: "", 20: "b"}
    assert preferences.other_endings(turns.limit(0))[1].collect() == []
