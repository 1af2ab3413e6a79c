"""Alignment against sets of byte offsets, with the tokenizers used plainly."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tagweave.llm import alignment
from tagweave.llm.queries import QUERIES, byte_bpe

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
FILES = {"model": MODEL, **byte_bpe()}
ODD = [(1, None), (2, ""), (3, " "), (4, "one"), (4, "one"), (4, "two words"), (None, "one"), (5, "a  b\n\tc "), (6, "▁"),
       (7, "<|endoftext|> <s> </s> <0x41> [UNK]"), (8, "日本 語\x00 é ｶﾞ ﬁ 😀"), (9, "x" * 60_000), (10, "word é " * 15_000)]


def token_bytes():
    a, b = Tokenizer.from_file(FILES["tokenizer"]), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    letters = {}
    for byte in range(256):  # the library's own way from bytes to characters
        letters.setdefault(byte, None)
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in kept} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in kept)}
    of_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, of_a, of_b


def plain(rows):
    a, b, of_a, of_b = token_bytes()
    made, pairs = [], collections.Counter()
    for doc, text in rows:
        ids = [[], []]
        if text:
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            spelt = [b"".join(map(of, i)) for of, i in zip((of_a, of_b), ids)]
            if spelt != [(" " + text).encode()] * 2:
                ids = [[], []]
        ends = [dict(zip(np.cumsum([len(of(i)) for i in side]).tolist(), range(len(side)))) for of, side in zip((of_a, of_b), ids)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(ids[0][ends[0][c]], ids[1][ends[1][c]]) for c in cuts]
        groups, at = [], [0, 0]
        for c in cuts:
            new = [e[c] + 1 for e in ends]
            groups.append("|".join(",".join(map(str, side[s:e])) for side, s, e in zip(ids, at, new)))
            at = new
        pairs.update(links)
        made.append((doc, *map(len, ids), links, groups))
    most = {}
    for (_a, b_id), n in pairs.items():
        most[b_id] = max(most.get(b_id, 0), n)
    return sorted(((doc, n_a, n_b, len(groups), len(links), sum(pairs[p] == most[p[1]] for p in links),
                    sum(pairs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
                   for doc, n_a, n_b, links, groups in made), key=repr)


def results(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                   for r in df.collect()), key=repr)


def test_query_against_sets_of_offsets(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert results(QUERIES["op13_tokenizer_alignment"](spark, SMALL)) == plain(rows)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in ODD], "doc_id bigint, text string, pair int, pairs string, count int")
    got = results(alignment.counted(rows, **FILES))
    assert got == plain(ODD)
    empty = {r[0] for r in got if r[1:] == (0, 0, 0, 0, 0, 0, "")}
    assert empty == {1, 2, 6}
    assert alignment.counted(rows.limit(0), **FILES).collect() == []


def test_links_of_texts(spark):
    text = "Unbelievable words, wörds"
    rows = spark.createDataFrame([(7, text, "kept"), (8, None, "kept")], "doc_id bigint, text string, links_of string")
    by = {r.doc_id: r for r in alignment.aligned(rows, ["doc_id", "links_of"], **FILES).collect()}
    a, b, of_a, of_b = token_bytes()
    assert (by[8].a_ids, by[8].b_ids, by[8].links) == ([], [], []) and by[8].links_of == "kept"
    for link in by[7].links:
        assert b"".join(map(of_a, by[7].a_ids[:link.a + 1])) == b"".join(map(of_b, by[7].b_ids[:link.b + 1]))
    assert b.decode(by[7].b_ids) == text and a.decode(by[7].a_ids) == " " + text


@pytest.mark.parametrize("lane", [1, 3, 1000])
def test_lockstep_on_random_ends(lane):
    rng = random.Random(lane)
    sizes = np.array([1, 2, 3, 4])
    for _ in range(200):
        sides = ([], [])
        for _doc in range(rng.randint(0, 6)):
            total = rng.choice([0, 1, 5, 40])
            for side in sides:
                ids, left = [], total
                while left:
                    ids.append(rng.randrange(min(4, left)))
                    left -= ids[-1] + 1
                side.append(np.array(ids, np.uint32))
        m = alignment.Merged(*sides, sizes, sizes, lane)
        ends_a, ends_b = np.cumsum(sizes[m.a]).tolist(), np.cumsum(sizes[m.b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        assert m.link_a.tolist() == [ends_a.index(e) for e in common] and m.link_b.tolist() == [ends_b.index(e) for e in common]
        assert m.first_link.tolist() == [sum(i < f for i in m.link_a) for f in m.first_a]
