"""Merge replay, Merkle manifest and vector codes against brute-force versions, and their edge cases."""

import base64
import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from cairn.llm import byte_bpe, merkle, queries, vector_codes
from conftest import DATA

SF = str(DATA / "sf0.001")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def view(name):
    return duckdb.sql(f"select * from '{SF}/{name}.parquet'").fetchall()


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = sorted((tuple(r) for r in rel.select(*df.columns).fetchall()), key=repr)
    assert rows(df, *df.columns) == want


# --- byte-level BPE ---------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_the_library(spark, library):
    want = []
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = queries.op11_merge_replay(spark, SF)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_hostile_texts_equal_the_library(library):
    r, encoder = random.Random(7), byte_bpe.Encoder(RANKS, PATTERN)
    parts = ["a", "e", "th", "ing", " ", "  ", "\n", "\r\n", "'s", "'S", "é", "é", "日本", "!", "1", "½", "23", "\x1c", "\x85", "᠎", "​", "﻿", "\t", "aaaa", "　", "<|endoftext|>", "A", "-", "--", "🙂", "_", "\0", "ﬁ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(4000)] + ["a" * 20000, "ab" * 5000, "", " ", "  x ", "日" * 3000, "-" * 9999, " " * 5000]
    for k in range(0, len(texts), 700):
        block = texts[k : k + 700]
        ids, many = encoder.encode(pa.array(block))
        for text, got in zip(block, np.split(ids, np.cumsum(many)[:-1]), strict=True):
            assert got.tolist() == library.encode_ordinary(text)


def naive(ranks, word):
    """Least rank first, leftmost of equal ones, one merge at a time."""
    tokens = [bytes([b]) for b in word]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[t] for t in tokens]
        i = min(pairs)[1]
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


def test_merges_whose_ranks_go_back():
    """Tables in which a merge makes a pair of a lower rank, or two pairs make the same token."""
    r = random.Random(3)
    for _ in range(150):
        more = {"".join(r.choice("ab") for _ in range(r.randint(2, 5))).encode() for _ in range(12)}
        more = list(more)
        r.shuffle(more)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(more)}
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 25))).encode() for _ in range(40)]
        ids, ends = byte_bpe.Merges(ranks).replay(words)
        assert [part.tolist() for part in np.split(ids, ends[:-1])] == [naive(ranks, w) for w in words]


def test_what_a_worker_remembers_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "WORDS", 5)
    monkeypatch.setattr(byte_bpe, "PAIRS", 3)
    encoder, texts = byte_bpe.Encoder(RANKS, PATTERN), [t or "" for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet' limit 60").fetchall()]
    for _ in range(2):
        for text in texts:
            assert encoder.encode(pa.array([text]))[0].tolist() == library.encode_ordinary(text)


def test_encode_and_decode_keep_rows_and_bytes(spark):
    data = [(None, "no id"), (7, None), (7, ""), (8, "same"), (8, "same"), (9, " \n\t "), (10, "wörd " * 30000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("IDS", F.lit("clash")).withColumn("decoded", F.lit(1))
    got = byte_bpe.decode(byte_bpe.encode(df, "text", RANKS, PATTERN), "ids", RANKS)
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in got.collect()), key=repr) == sorted(((i, t or "") for i, t in data), key=repr)
    assert byte_bpe.round_trip(df.limit(0), "text", RANKS, PATTERN).count() == 0
    assert [r.n_tokens for r in byte_bpe.round_trip(df.where("text is null"), "text", RANKS, PATTERN).collect()] == [0]
    nothing = byte_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), "ids", RANKS)
    assert sorted((r.decoded for r in nothing.collect()), key=repr) == [None, b""] or {repr(r.decoded) for r in nothing.collect()} == {"None", repr(bytearray(b""))}


def test_a_table_without_all_bytes_is_refused(tmp_path):
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(tmp_path / "few"))


# --- Merkle manifest --------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
        i //= 16
    return out


def plain(docs):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text), straight from the definition."""

    def leaf(d, lower=False):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4]) if lower and d[4] is not None else d[4]
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*d[:4], text)))

    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[s] = tree([leaf(d) for d in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for k, s in enumerate(names):
        above = siblings(top, k)
        for i, d in enumerate(groups[s]):
            path = siblings(trees[s], i) + above
            x = leaf(d, d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0)
            for a, b in path:
                x = h(a, x, b)
            out.append((d[0], trees[s][0][i], trees[s][-1][0], root, h(*(a + b for a, b in path)), x, x == root))
    return sorted(out, key=repr)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
DOC = "doc_id long, source string, lang string, n_chars long, text string"


def of_table(docs):
    tampered = [merkle.lowered(c) if c == "text" else F.col(c) for c in merkle.COLUMNS]
    claimed = F.when(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0), merkle.leaf(tampered))
    return merkle.manifest(docs, "doc_id", "source", merkle.COLUMNS, {"claimed": claimed})


def test_manifest_query_equals_its_sql_and_brute_force(spark):
    same_as_sql(spark, "op12_merkle_manifest")
    docs = duckdb.sql(f"select doc_id, source, lang, n_chars, text from '{SF}/documents.parquet'").fetchall()
    assert rows(queries.op12_merkle_manifest(spark, SF), *NAMES) == plain(docs)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 300, 4096])
def test_traversal_gives_each_leaf_its_siblings(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = tree(leaves)
    nodes = [x.encode() for x in leaves]
    assert merkle.root_of(nodes, merkle.height(n)).decode() == levels[-1][0]
    for i, sides in enumerate(merkle.traversal(nodes, merkle.height(n))):
        assert [(a.decode(), b.decode()) for a, b in sides] == siblings(levels, i)


def test_stacks_stay_logarithmic():
    stack, most = merkle.Treehash(6), 0
    for i in range(70_000):
        stack.push(b"%064d" % i)
        most = max(most, sum(map(len, stack.runs)))
    assert most <= merkle.ARITY * 6


def test_groups_of_one_and_of_many_blocks(spark):
    """A source of three blocks (the last of one leaf), a lone leaf, a null source, forty sources, equal and null ids, odd texts."""
    big = [(i, "big", None, 1, "T") for i in range(2 * merkle.BLOCK + 1)]
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, None, "en", 0, ""), (None, "ß", "en", 3, "ÄÖÜabcXYZ"), (5, "", "en", 1, "Ab\0\n:-"), (5, "", "en", 1, "Aa"), (-3, "Z", "", -1, "x" * 100_000)]
    docs = big + odd + [(100 + i, f"s{i}", "en", i, "One Leaf") for i in range(40)]
    df = spark.createDataFrame(docs, DOC).withColumn("path", F.lit("clash")).withColumn("pos", F.lit(0)).withColumn("node", F.lit("x"))
    made = of_table(df)
    assert rows(merkle.folded(made, "claimed"), *NAMES) == plain(docs)
    whole = merkle.proofs(made).where("grp = 'big' and pos in (0, 4096, 8192)").collect()
    leaves = {r.pos: r.node for r in made.leaves.where("grp = 'big'").collect()}
    for r in whole:
        x = leaves[r.pos]
        for p in r.path:
            x = h(p.left, x, p.right)
        assert x == made.root


def test_an_empty_table_has_no_root(spark):
    made = of_table(spark.createDataFrame([], DOC))
    assert made.root == "" and merkle.folded(made, "claimed").count() == 0


# --- vector codes -----------------------------------------------------------


def brute(data, parts=4, entries=256, rounds=4):
    """Codes straight from the definition, in Python's integers; data: (vec_id, vector, label)."""
    kept = [d for d in data if d[1] is not None and all(x is not None and math.isfinite(x) for x in d[1])]
    width = -(-max((len(d[1]) or 1 for d in kept), default=1) // parts) * parts
    w = width // parts
    whole = [[math.floor(1024 * Fraction(x)) for x in (*d[1], *[0.0] * (width - len(d[1])))] for d in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, list(kept[i][1])))[:entries]
    books = [[whole[i][p * w : p * w + w] for i in first] for p in range(parts)]

    def nearest(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            at = {}
            for x in whole:
                x = x[p * w : p * w + w]
                at.setdefault(nearest(p, x)[0], []).append(x)
            books[p] = [[sum(c) // len(at[e]) for c in zip(*at[e])] if e in at else c for e, c in enumerate(books[p])]
    out, by = [], {}
    for d, x in zip(kept, whole):
        found = [nearest(p, x[p * w : p * w + w]) for p in range(parts)]
        out.append((d[0], "".join(f"{e:02x}" for e, _ in found), sum(f for _, f in found), d[2]))
        by[d[2]] = by.get(d[2], 0) + out[-1][2]
    listed = ",".join(str(x) for p in books for c in p for x in c)
    top = (1 << 63) - 1
    return sorted(((i, c, min(e, top), min(by[label], top)) for i, c, e, label in out), key=repr), hashlib.sha256(listed.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<double>, label int"


def coded(df, **more):
    out, books = vector_codes.compressed(df, "vec_id", "embedding", "label", **more)
    return rows(vector_codes.label_errors(out), "vec_id", "code", "error", "label_error"), books


def test_codes_query_equals_its_sql_and_brute_force(spark):
    same_as_sql(spark, "op13_vector_codes")
    data = duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet'").fetchall()
    want, digest = brute(data)
    got = queries.op13_vector_codes(spark, SF)
    assert rows(got, "vec_id", "code", "error", "label_error") == want
    assert {r[0] for r in got.select("codebooks_sha256").distinct().collect()} == {digest}


def test_more_vectors_than_entries_blocks_and_rounds(spark):
    r = np.random.default_rng(5)
    data = [(i, (r.normal(size=8) * 3 + 10 * (i % 7)).tolist(), None if i % 5 == 0 else i % 3) for i in range(700)]
    df = spark.createDataFrame(data, VECTORS).repartition(7)
    for rounds in (0, 1, 4):
        want, digest = brute(data, entries=32, rounds=rounds)
        got, books = coded(df, entries=32, rounds=rounds)
        assert got == want and books.digest() == digest


def test_odd_vectors(spark):
    """Nulls, non-finite components, ties, repeated rows, other lengths, empty vectors, sizes beyond 32 and 64 bits."""
    inf, nan = float("inf"), float("nan")
    data = [(3, None, 1), (4, [1.0, None, 2.0, 3.0], 1), (5, [inf, 0.0, 0.0, 0.0], 1), (6, [nan, 0.0, 0.0, 0.0], None), (7, [0.1, -0.1, 0.5, -0.5, 1.0], None), (7, [0.1, -0.1, 0.5, -0.5, 1.0], None), (None, [0.2], 2), (7, [0.0], 2), (9, [], 2), (2, [-0.0001] * 7, 3)]
    for more in ([], [(20, [1e6, -1e6, 0.0, 3e6], 4)], [(20, [1e30, -1e200, 1e308, 0.0], 4), (21, [-1e308] * 4, 4), (22, [1e15] * 4, None)]):
        want, digest = brute(data + more, entries=4)
        df = spark.createDataFrame(data + more, VECTORS).withColumn("salt", F.lit(1)).withColumn("data", F.lit("clash"))
        got, books = coded(df, entries=4)
        assert got == want and books.digest() == digest


def test_no_vector_no_row(spark):
    for data in ([], [(1, None, 1)], [(1, [float("nan")], 1)]):
        got, books = coded(spark.createDataFrame(data, VECTORS))
        assert got == [] and books.digest() == hashlib.sha256(b"").hexdigest()
    got, books = coded(spark.createDataFrame([(1, [], None)], VECTORS))
    assert got == [(1, "00000000", 0, 0)]


def test_labels_too_many_to_broadcast(spark, monkeypatch):
    data = [(i, [float(i % 11), float(i % 5)], None if i % 2 else i % 50) for i in range(300)]
    df = spark.createDataFrame(data, VECTORS)
    want, _ = brute(data, entries=8)
    monkeypatch.setattr(vector_codes, "small", lambda sums: sums)
    assert coded(df, entries=8)[0] == want


def test_a_code_stands_for_a_vector(spark):
    data = [(i, [i / 4, -i / 4, 0.5, 2.0], 0) for i in range(8)]
    out, books = vector_codes.compressed(spark.createDataFrame(data, VECTORS), "vec_id", "embedding", "label")
    for r in out.collect():
        assert np.allclose(books.decode(r.code), data[r.vec_id][1], atol=1 / 1024)


def test_distances_are_exact_at_every_size():
    r = random.Random(1)
    for top in (100, 1 << 20, 1 << 40, 10**30):
        part = np.array([[r.randint(-top, top) for _ in range(300)] for _ in range(3)], object)
        entries = np.array([[r.randint(-top, top) for _ in range(9)] for _ in range(3)], object)
        kind = np.int64 if top < 1 << 62 else object
        which, far = vector_codes.nearest(part.astype(kind), entries.astype(kind))
        for j in range(300):
            d = [sum((int(part[i, j]) - int(entries[i, e])) ** 2 for i in range(3)) for e in range(9)]
            assert which[j] == d.index(min(d)) and int(far[j]) == min(d)
