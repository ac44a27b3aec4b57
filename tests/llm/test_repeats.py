"""Removal of repeated strings against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from wardcast.llm import repeats
from wardcast.llm.queries import op13_repeats

SCHEMA = "doc_id long, text string, copy string, doc int, entries string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def found(df, **more):
    got = repeats.repeats(df, **more)
    return sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def plain(rows, length=100):
    key = lambda r: (r[0] is None, r[0] or 0, int(hashlib.sha256((r[1] or "").encode()).hexdigest()[:15], 16))
    seen, out = set(), []
    for doc, text in sorted(rows, key=key):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                gone[at : at + length] = True
            seen.add(window)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def prose(draw, n):
    return "".join(draw.choice("abcdefgh é€") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(13)
    passages = [prose(draw, n) for n in (99, 100, 101, 140, 260, 700)]
    line = prose(draw, 60)
    rows = []
    for i in range(120):
        parts = []
        for _ in range(draw.randrange(5)):
            kind = draw.randrange(5)
            passage = draw.choice(passages)
            cut = draw.randrange(len(passage))
            parts.append([passage, passage[cut:], passage[:cut], prose(draw, draw.randrange(200)), line][kind])
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[i % 7][1]) for i in range(40)]  # exact copies
    rows += [(300 + i, rows[3][1] + passages[5] + line + prose(draw, 30)) for i in range(30)]  # a hot passage, then other text
    rows += [(400, "a" * 900), (401, "ab" * 400), (402, "b" + "ab" * 300), (403, "a" * 150)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk, parts", [(repeats.CHUNK, 1), (5, 6), (1, 3)])
def test_equals_all_windows(spark, corpus, chunk, parts):
    assert found(frame(spark, corpus).repartition(parts), chunk=chunk) == plain(corpus)


def test_awkward_rows(spark, corpus):
    text = corpus[0][1] + "x" * 120
    rows = [
        (1, None), (2, ""), (3, "short"), (4, text), (4, text), (4, text + "!"), (4, "other"), (None, text), (None, text[5:]), (5, "short"), (3, "short"),
        (6, "\x00" * 130 + "é€😀" * 40), (7, "é€😀" * 40), (-9, text[:150]),
    ]
    assert found(frame(spark, rows)) == plain(rows)
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, None), (2, "a")])) == plain([(1, None), (2, "a")])


def test_slices_and_broadcast(spark, corpus, monkeypatch):
    long = [(i, t * 4) for i, t in corpus[:60]]
    data = np.frombuffer("".join(t for _, t in long).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for _, t in long])
    covered = lambda: {s + k for s, w in zip(*repeats.phrases(data, ends)[:2]) for k in range(w)}
    whole = covered()
    monkeypatch.setattr(repeats, "SLICE", 512)
    assert covered() == whole and len(whole) > 1000
    monkeypatch.undo()
    monkeypatch.setattr(repeats, "BROADCAST_ENTRIES", 0)
    assert found(frame(spark, corpus)) == plain(corpus)


def test_suffix_ranks():
    draw = np.random.default_rng(2)
    data = draw.integers(0, 3, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    strings = [bytes(data[i : i + 100]) for i in range(2900)]
    rank = repeats.suffix_ranks(data)[:2900]
    order = sorted(set(strings))
    place = {s: k for k, s in enumerate(order)}
    assert (np.unique(rank, return_inverse=True)[1] == [place[s] for s in strings]).all()


def test_query_takes_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = op13_repeats(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_few_windows_go_on_by_their_hash(spark, monkeypatch):
    """Of a line in many documents slices go on, and of other triggers nothing, not a row for each window."""
    draw, written, stage = random.Random(5), {}, repeats.stage

    def kept(df, name, *more):
        written[name] = stage(df, name, *more)
        return written[name]

    monkeypatch.setattr(repeats, "stage", kept)
    line = prose(draw, 60)
    rows = [(i, prose(draw, 70) + line + prose(draw, 70)) for i in range(400)] + [(500 + i, prose(draw, 40) + line) for i in range(40)]
    assert found(frame(spark, rows).repartition(4), chunk=100) == plain(rows)
    assert written["dictionary"].filter("a IS NOT NULL").count() < 4_000
