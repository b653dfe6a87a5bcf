"""Online packing, the dataset manifest and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import manifest, online_packing, periodic
from kgspark.llm.common import Scratch


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# op11 ----------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(online_packing.default_vocabulary())


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, online_packing.END]


def holds(rows, docs, tokenizer, capacity):
    """Every id in one piece, sequences without gaps; returns what is padded."""
    want, got = defaultdict(list), defaultdict(list)
    for d, t in docs:
        want[d].append(whole(tokenizer, t))
    for r in rows:
        got[r["doc_id"]].append(r)
    assert set(want) == set(got)
    for d, texts in want.items():
        ids = {}
        for r in got[d]:  # rows that share a doc_id are told apart by their checksums
            fits = [k for k, x in enumerate(texts) if len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
            assert fits
            ids.setdefault((r["start"], r["length"], r["ids_crc32"]), []).append(fits)
        assert sum(r["length"] for r in got[d]) == sum(map(len, texts))
        if len(texts) == 1:
            spans = sorted((r["start"], r["length"]) for r in got[d])
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    padded = 0
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded, len(by)


def test_online_packing(spark, edge, tokenizer):
    docs = [tuple(r)[:2] for r in edge.select("doc_id", "text").collect()]
    rows = online_packing.pack(spark, edge.repartition(5)).collect()
    padded, n = holds(rows, docs, tokenizer, 2048)
    assert padded < online_packing.LEAST_PIECE * n


@pytest.mark.parametrize(("capacity", "most", "fanin", "parts"), [(64, 1, 2, 9), (64, 4, 2, 9), (256, 3, 64, 20), (2048, 32, 2, 3)])
def test_leftovers_of_many_partitions_are_merged(spark, tokenizer, capacity, most, fanin, parts):
    r = random.Random(capacity + most)
    docs = [(k, " ".join(r.choice(["alpha", "beta", "gamma\n", "d'or", "  ", "7.5"]) for _ in range(r.choice([0, 1, 5, 40, 300])))) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts, "doc_id")
    rows = online_packing.pack(spark, df, capacity=capacity, most=most, fanin=fanin).collect()
    padded, n = holds(rows, docs, tokenizer, capacity)
    assert padded < online_packing.LEAST_PIECE * n
    assert Counter(map(tuple, rows)) == Counter(map(tuple, online_packing.pack(spark, df, capacity=capacity, most=most, fanin=fanin).collect()))


def test_best_window_then_the_fullest(capsys):
    out = []
    w = online_packing.Windows(out.append, capacity=10, most=2, least=2)
    put = lambda d, n: w.place(d, 0, bytes(4 * n), n)
    put(1, 6)
    put(2, 7)
    put(3, 3)  # the tighter gap of 3, which fills a window
    assert [[(p[0], len(p[2]) // 4) for p in s] for s in out] == [[(2, 7), (3, 3)]]
    put(4, 9)
    put(5, 5)  # fits nowhere: the fullest (gap 1) is emitted as it is, then the document has a window of its own
    assert [[p[0] for p in s] for s in out][1:] == [[4]] and sorted(w.gaps) == [4, 5]
    put(6, 8)  # fits nowhere: the fullest (gap 4) takes the first four, the rest goes where it fits best
    assert [(p[0], p[1], len(p[2]) // 4) for p in out[2]] == [(1, 0, 6), (6, 0, 4)]
    assert [(p[0], p[1], len(p[2]) // 4) for h in w.held for p in h] == [(5, 0, 5), (6, 4, 4)]


def test_one_task_sees_few_leftovers(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("word " * 30).alias("text")).repartition(6)
    scratch = Scratch(spark, "t")
    rows = scratch.write(df.mapInArrow(online_packing._first(online_packing.default_vocabulary(), 2048, 4), online_packing.SCHEMA), "x")
    left = rows.where("ids is not null").groupBy("part").agg(F.countDistinct("sequence_id").alias("n")).collect()
    assert len(left) == 6 and all(r["n"] <= 4 for r in left)


def test_online_encoder_equals_the_tokenizer(tokenizer, sf):
    import pyarrow.parquet as pq

    enc, r = online_packing.Encoder(online_packing.default_vocabulary()), random.Random(5)
    bits = ["a", "Straße", " ", "  ", "\n", "\r\n", "\t", "'s", "'ll", "'T", "9", "½", "²", "×", "÷", "ª", "\xa0", "\x85", "\x1c", "\x1f", "\x00", "ɏ", "ɐ", "é", "é", "日本", "😀", " ", "​", "<|endoftext|>", "<|endof", ".", "...", "_", "Ǆ", "ŉ", "\x0b"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(20_000)]
    texts += [t or "" for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()]
    assert all(np.frombuffer(enc.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t in texts)


# op12 ----------------------------------------------------------------------------------------------------------------
def tree(nodes, arity):
    """(root, siblings of each node level by level, left and right) of a list of digests, a level at a time."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, path in enumerate(paths):
            lo = at[k] // arity * arity
            path.append((level[lo : at[k]], level[at[k] + 1 : lo + arity]))
            at[k] //= arity
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 80, 255, 256, 257, 300])
@pytest.mark.parametrize("arity", [2, 3, 16])
def test_traversal_gives_every_path(n, arity):
    leaves = [sha(str(k)) for k in range(n)]
    root, paths = tree(leaves, arity)
    levels = manifest.height(n, arity)
    assert list(manifest.traverse(leaves, levels, arity)) == paths and manifest.block_root(leaves, levels, arity) == root
    assert all(manifest.fold(a, p) == root for a, p in zip(leaves, paths, strict=True))
    assert manifest.read(manifest.spelled(paths[-1])) == [([*map("".join, [x])] if x else [], ["".join(y)] if y else []) for x, y in paths[-1]]


def test_treehash_memory_is_logarithmic():
    t = manifest.TreeHash(3, 4)
    for k in range(64):
        t.push(str(k))
        assert all(len(s) <= 4 for s in t.stack)


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def proofs(rows, arity):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows(doc_id, text, lang, source, n_chars)."""
    by = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        leaf = lambda t: sha("".join(map(enc, (doc_id, source, lang, n, t))))  # noqa: B023, E731
        low = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        changed = leaf(low) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else leaf(text)
        by[source].append((doc_id is not None, doc_id or 0, leaf(text), doc_id, changed))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: (sorted(by[s]), *tree([x[2] for x in sorted(by[s])], arity)) for s in sources}
    root, tops = tree([below[s][1] for s in sources], arity)
    out = Counter()
    for s, top in zip(sources, tops, strict=True):
        for (_, _, leaf, doc_id, changed), path in zip(below[s][0], below[s][2], strict=True):
            path = path + top
            at = changed
            for left, right in path:
                at = sha("".join([*left, at, *right]))
            out[(doc_id, leaf, below[s][1], root, sha("".join("".join([*a, *b]) for a, b in path)), at, at == root)] += 1
    return out


@pytest.mark.parametrize(("arity", "levels"), [(16, 2), (2, 1), (2, 3), (3, 2)])
def test_manifest_equals_brute_force(spark, edge, arity, levels):
    rows = [tuple(r) for r in edge.collect()]
    rows += [(k, f"Text {k}", "en", "hot", k) for k in range(100, 170)] + [(k, "T", "en", f"s{k}", k) for k in range(200, 220)] + [(5, "A", None, "é", 1), (10, None, None, "~", None), (10, "", None, "~", None)]
    df = spark.createDataFrame(rows, edge.schema).repartition(4)
    scratch = Scratch(spark, "m")
    got = manifest.Manifest(scratch, arity, levels).checked(manifest.leaves(df, scratch), "tampered", "doc_id")
    got = got.select("doc_id", "digest", "subroot", "root", "proof_sha256", "folded_root", F.expr("folded_root = root"))
    want = proofs(rows, arity)
    assert Counter(map(tuple, got.collect())) == want
    assert any(not k[-1] for k in want) and any(k[-1] for k in want)


def test_proofs_are_real_outputs(spark, edge):
    scratch = Scratch(spark, "m")
    got = manifest.Manifest(scratch, 2, 2).proofs(manifest.leaves(edge, scratch), "doc_id").collect()
    assert len(got) == edge.count()
    assert all(manifest.fold(r["digest"], manifest.read(r["proof"])) == r["root"] for r in got)


def test_equal_rows_are_ranked_over_parts(spark):
    df = spark.range(0, 2000, 1, 8).select(F.lit("s").alias("grp"), F.lit(1).alias("doc_id"), F.lit("same").alias("digest"))
    rows = manifest.ranked(df, Scratch(spark, "m"), "r", "grp", "doc_id", "digest")
    assert sorted(r["rank"] for r in rows.collect()) == list(range(2000)) and rows.where("n <> 2000").count() == 0
    biggest = Scratch(spark, "m2")
    manifest.ranked(df, biggest, "r", "grp", "doc_id", "digest")
    assert spark.read.parquet(f"{biggest.root}/r").groupBy("_part").count().agg(F.max("count")).first()[0] < 1000


# op13 ----------------------------------------------------------------------------------------------------------------
def all_runs(x, least=6, times=4):
    """Every period, then every stretch of it, from the definition."""
    n, out = len(x), {}
    for q in range(1, n // times + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and x[e] == x[e + q]:
                e += 1
            if e > s and e + q - s >= max(least, times * q):
                out.setdefault((s, e + q), q)
            s = max(e, s) + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def periodic_texts(seed):
    r = random.Random(seed)
    x = []
    for _ in range(r.randint(0, 6)):
        kind = r.randint(0, 3)
        if kind == 0:
            x += [r.randint(0, 2) for _ in range(r.randint(0, 30))]
        elif kind == 1:
            x += [r.randint(0, 1) for _ in range(r.randint(1, 9))] * r.randint(1, 9)
        elif kind == 2:
            inner = [r.randint(0, 1)] * r.randint(4, 8) + [r.randint(0, 3)]
            x += inner * r.randint(1, 7)
        else:
            x += [r.randint(0, 50) for _ in range(r.randint(1, 40))]
    return x


def test_runs_equal_the_definition():
    for seed in range(1500):
        x = periodic_texts(seed)
        got = periodic.find_runs(np.array([*x, -1], np.int64), np.array([len(x)]))
        assert got == all_runs(x), (seed, x)


def test_runs_do_not_cross_texts_and_stay_cheap():
    texts = [(1, "a a a"), (2, "a a a"), (3, None), (4, "a " * 30_000), (5, "b c " * 9000 + "d " * 9000), (6, " \n\t ")]
    runs, collapsed = periodic.runs_of_texts(texts, None, 6, 4)
    assert runs == [[], [], [], [(0, 30_000, 1)], [(0, 18_000, 2), (18_000, 27_000, 1)], []]
    assert collapsed == [b"a a a", b"a a a", b"", b"a", b"b c d", b""]


def test_z_function():
    for seed in range(200):
        x = periodic_texts(seed)
        assert periodic.z_function(x)[1:] == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(1, len(x))]


def test_fibonacci_words_and_nested_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    nested = ([0] * 8 + [1]) * 5
    for x in (b, nested, nested * 5, [0, 1] * 50 + [0] * 50 + [1, 0] * 50):
        assert periodic.find_runs(np.array([*x, -1], np.int64), np.array([len(x)])) == all_runs(x)


def brute(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in found), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(found), *top, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs(spark, edge, table_dir):
    rows = [tuple(r)[:2] for r in edge.select("doc_id", "text").collect() if len(r["text"] or "") < 20_000]
    rows += [(k, " ".join(map(str, periodic_texts(k)))) for k in range(1000, 1300)] + [(k, "x y z w " * 9) for k in (1, 2, 24)]
    out = periodic.op13(spark, table_dir(documents=spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert Counter(map(tuple, out.collect())) == Counter(brute(d, t) for d, t in rows)
