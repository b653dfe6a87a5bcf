import random
import re

import numpy as np
import pyarrow as pa

from kgspark.llm import kernels, quality, suffix_dedup


def table(texts):
    return kernels.texts(pa.array(texts, pa.string()))


def test_texts_reads_slices_and_nulls():
    a = pa.array(["ab", None, "", "é", "xyz"]).slice(1)
    b, offs = kernels.texts(a)
    assert bytes(b) == "éxyz".encode() and offs.tolist() == [0, 0, 0, 2, 5]
    assert kernels.texts(pa.array([], pa.string()))[1].tolist() == [0]


def test_shingle_sets_are_those_of_words():
    r = random.Random(1)
    texts = [None, "", " ", "a", "A b", "a b c d", "a b c d e"] + [" ".join(r.choice("ab cd é \t\n X".split(" ")) for _ in range(r.randint(0, 60))) for _ in range(80)]
    h, at = kernels.shingles(*table(texts))
    seen = {}
    for k, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
        mine = h[at[k] : at[k + 1]]
        assert len(mine) == len(want) and (np.diff(mine.astype(object)) > 0).all()
        assert seen.setdefault(frozenset(want), mine.tobytes()) == mine.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_blocks_hold_every_row_once_and_little():
    batch = pa.record_batch([pa.array(list(range(50))), pa.array([("x" * (k % 7) * 10) if k % 5 else None for k in range(50)])], names=["i", "text"])
    out = list(kernels.blocks(iter([batch, batch]), "text", 100))
    assert [v for t in out for v in t.column("i").to_pylist()] == list(range(50)) * 2
    assert all(sum(len(x or "") for x in t.column("text").to_pylist()) <= 100 for t in out)
    big = pa.record_batch([pa.array(["y" * 500, "z"])], names=["text"])
    assert sum(t.num_rows for t in kernels.blocks(iter([big]), "text", 100)) == 2


def test_features_do_not_depend_on_neighbours():
    texts = ["one two two one", "", "a,b", "###", "one two two one"]
    c, at = quality.features(*table(texts))
    alone = [quality.features(*table([t]))[0].tolist() for t in texts]
    assert [c[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == alone and alone[0] == alone[4] and alone[1] == []


def test_every_window_has_one_anchor_that_its_bytes_decide():
    r = np.random.default_rng(3)
    for text in (bytes(r.integers(97, 100, 400, dtype=np.uint8)), b"ab" * 150, bytes(200), bytes(r.integers(0, 256, 300, dtype=np.uint8))):
        b = np.frombuffer(b"q" * 60 + text + b"zz" * 40, np.uint8)
        place, first, last, *_ = suffix_dedup.anchors(b, np.array([0, 60, 60 + len(text), len(b)]))
        mine = {s - 60: p - 60 for p, f, g in zip(place.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(f, g + 1) if 60 <= s < 60 + len(text)}
        assert sorted(mine) == list(range(len(text) - 49))
        for s, p in mine.items():
            alone = suffix_dedup.anchors(np.frombuffer(text[s : s + 50], np.uint8), np.array([0, 50]))[0]
            assert s <= p <= s + 30 and alone.tolist() == [p - s]
