"""Winnowing against all windows looked up plainly."""

import hashlib
import random
import re

import pytest

from tagweave.llm import decontamination

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(len(w) - min(len(w), 10) + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[s:s + min(len(w), 10)]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                got = windows.get(tuple(w[s:s + n]), set())
                found |= got
                hit |= set(range(s, s + n)) if got else set()
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    extra = "gram bigint, marks string, size int, digest string, spans string"
    return (spark.createDataFrame([(i, t, 1, "m", 2, "d", "s") for i, t in docs], f"doc_id bigint, text string, {extra}"),
            spark.createDataFrame([(i, t, 1, "m", 2, "d", "s") for i, t in items], f"item_id bigint, text string, {extra}"))


def results(rows):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("bits", [27, 6])  # as it is, and with a bitmap that lets nearly everything through
def test_against_all_windows(spark, monkeypatch, bits):
    monkeypatch.setattr(decontamination, "MOST", bits)
    monkeypatch.setattr(decontamination, "FEWEST", 6)
    rng = random.Random(4)
    said = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    few, many = "ab", "Ab bA c é, 日本-x 9y _ ÀB".split(" ")
    items = [(k, said(k % 16, rng.choice([few, many]))) for k in range(60)]
    items += [(3, "a a a a a a a a a a a a"), (3, "other words of the same id"), (None, "no id"), (70, None), (71, ""), (72, "?!")]
    items += [(100 + k, "the one passage of ten words that all items share " + said(5, many)) for k in range(40)]
    docs = [(k, said(rng.randint(0, 60), few if k % 2 else many)) for k in range(80)]
    docs += [(200 + k, f"{said(4, many)} The ONE passage of ten words; that all items share {said(4, many)}") for k in range(80)]
    docs += [(90, None), (91, ""), (92, " \n."), (None, docs[3][1]), (5, docs[5][1]), (5, "b"), (93, "x" * 300_000),
             (94, "word " * 30_000 + items[90][1]), (95, "no id")]
    got = results(decontamination.judged(*tables(spark, docs, items)))
    assert got == plain(docs, items)
    assert sum(r[-1] for r in got) > 80


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "a b"), (2, None)], [(1, "a")])
    assert decontamination.judged(docs.limit(0), items).collect() == []
    assert [r[1:5] for r in results(decontamination.judged(docs, items.limit(0)))] == [
        (2, 0, 0, hashlib.sha256(b"").hexdigest()), (0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_spans_and_carried_columns(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs, items = tables(spark, [(1, f"x {passage} y z {passage}"), (2, f"{passage} {passage}"), (3, "one two")],
                         [(10, passage), (9, "three four five six seven eight nine ten eleven twelve thirteen")])
    got = {r.doc_id: r for r in decontamination.contaminated(docs, items, ["doc_id", "gram", "size"]).collect()}
    assert [tuple(s) for s in got[1].spans] == [(1, 13), (15, 27)] and [tuple(s) for s in got[2].spans] == [(0, 24)]
    assert got[1].item_ids == ["10", "9"] and got[3].spans == [] and got[3].item_ids == [] and got[1].gram == 1


def test_long_spans_share_a_kept_gram():
    """The guarantee: of any equal runs of 10 words, both sides keep a k-gram inside at the same place."""
    rng = random.Random(8)
    for _ in range(50):
        shared = [rng.choice("abc") for _ in range(10)]
        kept = []
        for _side in range(2):
            before = [rng.choice("abc") for _ in range(rng.randint(0, 20))]
            w = decontamination.Words([" ".join(before + shared + [rng.choice("abc") for _ in range(9)])])
            kept.append({int(p) - len(before) for p in w.winnowed(10, 5)[0] if 0 <= p - len(before) <= 5})
        assert kept[0] & kept[1]
