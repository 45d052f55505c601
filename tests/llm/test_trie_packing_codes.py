"""The conversation trie, packing and vector codes against brute force, and their handling of awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import conversation_trie, packing, queries, vector_codes

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))

    def order(v):
        return v[0] is not None, v[0] or 0, hashlib.md5(f"{len(v[1].encode())}:{v[1]}{v[2]}".encode()).hexdigest()

    own = {c: [v[1:] for v in sorted(vs, key=order)] for c, vs in convs.items()}
    nodes, kids = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        turns = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), ([], []))[0].append(c)
        nodes[tuple(turns)][1].append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, (members, _) in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(
        (
            (min(m), len(k), min(nodes[k[:-1]][0]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest())
            for k, (m, e) in nodes.items()
        ),
        key=repr,
    )


def turns(seed=4):
    rng, rows = random.Random(seed), []
    for c in range(-7, 40):
        for t in range(rng.choice([1, 2, 5, 40, 90 if c % 7 == 0 else 3])):
            role = rng.choice(["user", "assistant", None]) if t > 3 else "ua"[t % 2]
            rows.append((c, None if t == 0 and c % 3 == 0 else t, role, rng.choice(["x", "é", "hello", None]) if t > 2 else "same"))
    return rows + rows[:40] + [(None, 1, "u", "x")] * 3


@pytest.mark.parametrize("height", [3, 16])
def test_trie_equals_brute_force(spark, height):
    rows = turns()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")
    got = sorted((tuple(r[c] for c in NODE) for r in conversation_trie.rebuilt_trie(df, height).collect()), key=repr)
    assert got == plain_trie(rows)


def test_trie_sql_equals_brute_force():
    con, rows = duckdb.connect(), turns(5)
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.execute(f"SELECT {','.join(NODE)} FROM ({queries.ORACLE_SQL['op11_conversation_trie']})").fetchall(), key=repr) == plain_trie(rows)


def test_trie_without_turns_and_with_many_equal_conversations(spark, monkeypatch):
    assert conversation_trie.rebuilt_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    monkeypatch.setattr(conversation_trie, "CHUNK", 7)  # a list of members in several rows
    rows = [(5 * c, t, "u", "hi") for c in range(120) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert sorted((tuple(r[c] for c in NODE) for r in conversation_trie.rebuilt_trie(df).collect()), key=repr) == plain_trie(rows)


def test_plan_fills_bins():
    rng = random.Random(2)
    for n in (1, 50, 3000):
        lengths = [rng.choice([rng.randint(1, 2048), rng.randint(1, 200), 1500, 2048]) for _ in range(n)]
        counts = {k: lengths.count(k) for k in set(lengths)}
        bins, used = packing.plan(counts), dict.fromkeys(counts, 0)
        for times, pieces in bins:
            assert sum(k * m for k, m in pieces) <= 2048
            for k, m in pieces:
                used[k] += times * m
        assert used == counts
        assert sum(t for t, _ in bins) <= 1.002 * max(-(-sum(lengths) // 2048), sum(k > 1024 for k in lengths)) + 1


def test_fullest_equals_every_combination():
    rng = random.Random(3)
    for _ in range(300):
        pieces = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room, sums = rng.randint(0, 60), {0}
        for p in pieces:
            sums |= {s + p for s in sums}
        counts = {k: pieces.count(k) for k in set(pieces)}
        found = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert all(found[k] <= counts[k] for k in found)
        assert sum(k * n for k, n in found.items()) == max(s for s in sums if s <= room)


def test_word_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 9)
    path = public_tokenizers.path(queries.WORDS)
    library, words, rng = Tokenizer.from_file(path), packing.Words(path), random.Random(1)
    some = [*"abcXYZ'sted 09\n\t .,!  é́ΣςİŁ漢字🙂‍\x1c\x85ǅﬁ", "<|endoftext|>", " ", "  ", "'s", "the "]
    assert words.plain
    for k in range(6000):
        text = "".join(rng.choice(some) if k % 2 else chr(rng.randint(0x20, 0x260)) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(b"".join(words.text(text)), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_of_documents(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    library, total, sequences, ids_of = Tokenizer.from_file(public_tokenizers.path(queries.WORDS)), 0, {}, {}
    for r in queries.QUERIES["op12_packing"](spark, small).collect():
        ids_of.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in docs.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert sorted(ids_of.pop(doc_id)) == [(k, 2048 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
        total += len(ids)
    assert not ids_of
    for places in sequences.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


def test_packing_of_awkward_rows(spark):
    rows = [(1, None, 9), (None, "", 9), (2, "a b", 9), (2, "a b", 9), (3, "wörd " * 3000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(3)
    packed = packing.pack(docs, queries.WORDS, with_ids=True)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    found = packing.sequences(packed).collect()
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORDS))
    want = {}
    for r in sorted(packed.collect(), key=lambda r: (r.doc_id or 0, r.piece)):
        want.setdefault(r.doc_id, []).extend(r.ids)
    assert want[1] == [0] and want[None] == [0] and want[2] == [*library.encode("a b", add_special_tokens=False).ids, 0] * 2
    assert want[3] == [*library.encode("wörd " * 3000, add_special_tokens=False).ids, 0]
    assert sum(len(r.ids) for r in found) == sum(map(len, want.values()))
    for r in found:
        assert all(s.offset + s.length <= len(r.ids) for s in r.spans)
    assert packing.pack(docs.limit(0), queries.WORDS).count() == 0


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(1)
    for n, k, d, scale in ((1, 1, 4, 10), (5, 3, 2, 3), (700, 64, 4, 60), (2047, 61, 3, 5), (2000, 200, 1, 300), (900, 9, 2, 4)):
        parts, entries = (np.floor(rng.normal(size=(m, d)) * scale).astype(np.int64) for m in (n, k))
        entries[-1] = entries[0]
        parts[n // 2 :] = parts[n // 2]  # whole nodes of equal parts
        tree, book = vector_codes.Tree.build(parts, 8), vector_codes.Tree.build(entries, 1)
        want = ((parts[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (vector_codes.codes(tree, book) == want).all()
        count, sums = vector_codes.totals(tree, book)
        assert (count == np.bincount(want, minlength=k)).all()
        assert all((sums[:, j] == np.bincount(want, weights=parts[:, j], minlength=k)).all() for j in range(d))
        if k == 64:  # a leaf for each entry
            assert vector_codes.assign(tree, book)[0]


@pytest.mark.parametrize("block", [64, 4096])
def test_codes_equal_sql(spark, small, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    con, columns = duckdb.connect(), "vec_id, code, error, label_error, codebooks_sha256"
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op13_vector_codes']})").fetchall())
    assert sorted(map(tuple, queries.QUERIES["op13_vector_codes"](spark, small).select(*columns.split(", ")).collect())) == want


def test_codes_of_awkward_vectors(spark):
    one, nan = [1.0] * 16, float("nan")
    rows = [(3, one, None), (3, [0.5] * 16, 1), (None, [0.1] * 16, 1), (1, None, 1), (2, [], 1), (4, [*one[1:], None], 1), (5, [nan] * 16, 1), (6, [1e30] * 16, None), (7, one * 2, 2), (3, one, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string")
    found = vector_codes.compress(df)
    got = vector_codes.with_label_errors(found).collect()
    assert sorted((r.vec_id or 0, r.code[:2], r.error, r.label_error) for r in got) == [(0, "04", 0, 0), (3, "00", 0, 0), (3, "01", 0, 0), (3, "01", 0, 0), (6, "03", 0, 0)]
    near = {(r.id, round(r.decoded[0], 2)) for r in found.decoded().collect()}
    assert near == {(None, 0.1), (3, 0.5), (3, 1.0), (6, 65536.0)}
    assert vector_codes.with_label_errors(vector_codes.compress(df.limit(0))).collect() == []
