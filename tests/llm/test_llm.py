"""The operators for training text against plainer versions, on small tables with awkward rows."""

import collections
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hearthlens.llm import (components, fingerprints, id_files, language, linear, minhash, packing, queries, tokens, token_counts,
                            topk, toxicity, transducer, warc)
from hearthlens.session import fresh_path

FOLDER = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "One two three four five six.", "One two three four five six.", "  double  spaces \n\n and\ttabs ",
         "don't it's.'s 'll é à 日本 語 ♥", "word " * 4000, "x" * 3000, "\x00 null \x1c", "<|endoftext|> plain", "ONE TWO THREE FOUR FIVE SIX."]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", 0), (None, "no key here", None, 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, kept int")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(JSON)
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, FOLDER).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cursor.fetchall()))


def test_units_give_the_ids_of_whole_texts(library):
    random.seed(2)
    texts = [t or "" for t in TEXTS] + ["".join(random.choice("ab.'- \n1é") for _ in range(random.randint(0, 30))) for _ in range(3000)]
    flat, counts = (np.concatenate(part) for part in zip(*tokens.encoder(JSON).encode(pa.array(texts))))
    got = np.split(flat, np.cumsum(counts)[:-1])
    assert [list(g) for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_transducer_equals_the_library_and_decodes():
    import tiktoken

    ranks = transducer.read_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    texts = [t or "" for t in TEXTS] + ["".join(random.choice("theanding érß'. ") for _ in range(random.randint(0, 60))) for _ in range(2000)]
    codec = transducer.Codec(ranks, public_tokenizers.PATTERN)
    codec.transducer.max_transitions = 500  # states are dropped and made anew on the way
    flat, counts = (np.concatenate(part) for part in zip(*codec.encode(pa.array(texts))))
    got = np.split(flat, np.cumsum(counts)[:-1])
    assert [list(g) for g in got] == [encoding.encode_ordinary(t) for t in texts]
    assert ["".join(codec.decode(g.astype("<u4").tobytes(), 2)) for g in got] == texts
    stream = transducer.Utf8Stream()
    broken = bytes([0x41, 0xE6, 0x97, 0x41, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xC3])
    assert "".join(stream.feed(bytes([b])) for b in broken) + stream.close() == broken.decode("utf-8", "replace")


def test_encoding_in_spark(spark, awkward, empty):
    rows = transducer.encode(awkward, RANKS, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted((r.doc_id is None, r.decoded) for r in rows) == sorted((r.doc_id is None, r.text or "") for r in awkward.collect())
    again = transducer.decode(transducer.encode(awkward, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(r.text for r in again) == sorted(r.decoded for r in rows)
    assert transducer.encode(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_token_counts_are_those_of_the_best_segmentation(spark, awkward, empty):
    scores = {bytes([b]): -5.0 for b in range(256)} | {b"ab": -6.0, b"abc": -6.5, b"bc": -9.0, b"cab": -10.0}
    trie = token_counts.ForwardTrie(scores, max_nodes=40)

    def best(word):
        table = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            table.append(max((table[s][0] + scores[word[s:end]], table[s][1] - 1) for s in range(end) if word[s:end] in scores))
        return -table[-1][1]

    random.seed(5)
    for _ in range(300):
        word = bytes(random.choice(b"abcd") for _ in range(random.randint(0, 12)))
        assert trie.insert(word) == best(word)
    rows = token_counts.token_counts(awkward, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == awkward.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
    assert len({(r.n_pretokens, r.n_tokens) for r in rows if r.doc_id in (4, 5)}) == 1
    assert token_counts.token_counts(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_packing(spark, awkward, empty, library):
    rows = packing.pack(packing.text_pieces(awkward, JSON, 1, 256), 256, group_pieces=8).collect()
    want = collections.Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in awkward.collect())
    places, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[(r.doc_id, r.start)].append(np.frombuffer(r.ids, "<u4").tolist())
    for parts in places.values():
        assert sum(n for _, n in parts) <= 256
        assert sorted(o for o, _ in parts) == [sum(n for o, n in sorted(parts)[:i]) for i in range(len(parts))]
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    for (key, ids), n in want.items():
        if n == 1 and key is not None:
            assert [i for start in sorted(s for k, s in pieces if k == key) for i in pieces[(key, start)][0]] == list(ids)
    assert packing.pack(packing.text_pieces(empty, JSON, 1, 256), 256).collect() == []
    again = packing.pack(packing.token_pieces(tokens.tokenised(awkward, JSON, 1), 256), 256).collect()
    assert sum(r.length for r in again) == sum(r.length for r in rows)


def test_pieces_of_one_key_are_dealt_to_all_tasks(spark):
    docs = spark.range(600, numPartitions=3).select(F.when(F.col("id") < 300, 7).alias("doc_id"), F.lit("the same text again").alias("text"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        rows = packing.pack(packing.text_pieces(docs, JSON, 1, 256), 256, group_pieces=8).collect()
    finally:
        spark.conf.set(setting, before)
    tasks = collections.Counter((r.doc_id, r.sequence_id >> 44) for r in rows)
    assert all(sum(name == key for name, _ in tasks) > 1 and max(n for (name, _), n in tasks.items() if name == key) < 200 for key in (7, None))
    assert collections.Counter(r.doc_id for r in rows if r.start == 0) == {7: 300, None: 300}


def test_first_fit_decreasing_equals_a_plain_search():
    random.seed(6)
    sizes = [random.randint(0, 100) for _ in range(400)]
    room, bins = [], []
    for i in sorted((i for i in range(400) if sizes[i]), key=lambda i: (-sizes[i], i)):
        at = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
        if at is None:
            room.append(100)
            bins.append([])
            at = len(room) - 1
        room[at] -= sizes[i]
        bins[at].append(i)
    assert packing.first_fit_decreasing(sizes, 100) == bins
    plan = packing.plan(sizes, 100, 10)
    assert sum(n for b in plan for _, _, n in b) == sum(sizes) and all(sum(n for *_, n in b) <= 100 for b in plan)


def test_id_files(spark, awkward, empty, library):
    path = fresh_path(spark, "ids")
    id_files.write_ids(awkward, path, JSON, 2, shard_bytes=600)
    rows = sorted(id_files.layout(id_files.read_ids(spark, path)).collect(), key=lambda r: (r.key is not None, r.key or 0, r.start))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = collections.Counter()
    for r in awkward.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        want[(r.doc_id, len(ids) // 4, zlib.crc32(ids))] += 1
    assert collections.Counter((r.key, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert sorted(r.key for r in id_files.fetch(spark, path, [4, 7, 99, -1]).collect()) == [4, 4, 7]
    assert id_files.fetch(spark, path, [None]).count() == 2
    none = fresh_path(spark, "ids")
    id_files.write_ids(empty, none, JSON, 2)
    assert id_files.layout(id_files.read_ids(spark, none)).collect() == []


def test_index_is_minimal_and_perfect():
    keys = np.random.default_rng(1).choice(1 << 60, 5000, replace=False).astype("<i8")
    first, second = id_files.key_hashes(keys, np.zeros(len(keys), "u1"))
    pilots, where = id_files.build_index(first, second)
    assert sorted(where) == list(range(5000))
    assert all(id_files.slot_of(int(s), int(pilots[int(f) % len(pilots)]), 5000) == w for f, s, w in zip(first, second, where))


def test_warc_round_trip(spark):
    big = "ab" * 30000
    pages = [(1, "http://a/é b", "same"), (2, None, "same"), (3, "http://c", None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "0\r\n\r\nWARC/1.1\r\n\r\n"),
             (7, "u", "0\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "keyless")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = fresh_path(spark, "warc")
    warc.write_warc(df, path, segment_bytes=1000, file_records=7)
    assert all(r.problem is None for r in warc.read_warc(spark, path).collect())
    rows = warc.resolved(warc.read_warc(spark, path)).collect()
    got = sorted((r.key or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    top = {"same": 2, "": 4, big: 6, pages[6][2]: 7, "keyless": None}
    want = sorted((k or 0, len(h or ""), warc.digest_text((h or "").encode()), "response" if k == top[h or ""] else "revisit",
                   None if k == top[h or ""] else top[h or ""]) for k, _, h in pages)
    assert got == want
    records = warc.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() == 60
    lost = [tuple(r) for r in records.collect() if not (r.record_type == "continuation" and r.segment == 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in sorted(lost, key=lambda r: (r[2] or r[0], r[3] or 0))], t)
                                        for i, (_, t) in enumerate(warc._RECORD_TYPES)], [n for n, _ in warc._RECORD_TYPES])
    problems = [p for b in warc._reassembled([batch]) for p in b.column(5).to_pylist() if p]
    assert problems == ["a segment is missing or repeated"]
    none = fresh_path(spark, "warc")
    warc.write_warc(df.limit(0), none)
    assert warc.read_warc(spark, none).collect() == []
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def test_edited_fingerprints(spark, awkward, empty):
    for size in (2048, 3):
        rows = fingerprints.edited_fingerprints(awkward, bucket_rows=size).collect()
        texts = sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=lambda r: -(r[0] if r[0] is not None else -1))
        assert len(rows) == len(texts)
        first = texts[0][1]
        for i, (key, text) in enumerate(texts[:-2]):
            after = texts[i + 1][1] if i + 1 < len(texts) else first
            half = len(text) // 2
            want = hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()
            if key not in (4, 0):  # repeated, or followed by rows without a key in an order of hashes
                assert [(r.n_chars, r.edited_sha256) for r in rows if r.doc_id == key] == [(len(text), want)]
        prints = {r.doc_id: r.fingerprint for r in rows if r.doc_id is not None}
        assert prints[4] == prints[5] != prints[7] and prints[0] == prints[1] == "0" * 32
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.edited_fingerprints(empty).collect() == []
    assert fingerprints.near_counts(fingerprints.edited_fingerprints(empty)).collect() == []


def test_radius_search_finds_all(spark):
    random.seed(7)
    prints = [(random.getrandbits(63), random.getrandbits(63)) for _ in range(60)]
    for f0, f1 in prints[:30]:
        for bits in range(1, 6):
            for place in random.sample(range(126), bits):
                f0, f1 = (f0 ^ 1 << place, f1) if place < 63 else (f0, f1 ^ 1 << place - 63)
            prints.append((f0, f1))
    df = spark.createDataFrame(prints + prints[:5], "f0 long, f1 long")
    far = lambda a, b: bin(a[0] ^ b[0]).count("1") + bin(a[1] ^ b[1]).count("1")
    for radius, blocks in ((3, None), (2, 5)):
        got = [tuple(r) for r in fingerprints.within_radius(df, df.limit(40), radius, blocks).collect()]
        asked = {tuple(r) for r in df.limit(40).collect()}
        assert sorted(got) == sorted((*q, *p, far(q, p)) for q in asked for p in set(prints) if far(q, p) <= radius)


def test_near_copies_are_counted(spark):
    """Copies with one to four of 200 words changed."""
    random.seed(11)
    rows, changed = [], []
    for i in range(40):
        text = [f"w{random.randrange(5000)}" for _ in range(200)]
        rows.append((50 * i, " ".join(text)))
        for place in random.sample(range(200), 1 + i % 4):
            text[place] = f"new{i}x{place}"
        rows.append((50 * i + 1, " ".join(text)))
    prints = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r.n_near for r in fingerprints.near_counts(prints).collect()}
    assert all(found[50 * i] == 1 for i in range(40)) and all(found[50 * i + 1] is None for i in range(40))
    assert fingerprints.radius_for(0.8, 0.95) == 26 and fingerprints.radius_for(1.0, 0.95) == 0


def test_wide_radius_search_finds_all(spark):
    random.seed(12)
    prints = [(random.getrandbits(64) - (1 << 63), random.getrandbits(64) - (1 << 63)) for _ in range(30)]
    for f0, f1 in prints[:30]:
        for bits in (2, 20, 26, 27, 40):
            mask = sum(1 << place for place in random.sample(range(128), bits))
            prints.append((int(np.int64(f0) ^ np.array(mask & (1 << 64) - 1, np.uint64).view(np.int64)), int(np.int64(f1) ^ np.array(mask >> 64, np.uint64).view(np.int64))))
    far = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
    df = spark.createDataFrame(prints, "f0 long, f1 long")
    for radius, blocks in ((26, None), (20, 7), (1, None), (0, 2), (3, 5)):
        got = [tuple(r) for r in fingerprints.within_radius(df, df, radius, blocks).collect()]
        assert sorted(got) == sorted((*q, *p, far(q, p)) for q in prints for p in prints if far(q, p) <= radius)


def _near(rows, words, percent):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    found = {key: key for key in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    found[a] = found[b] = min(found[a], found[b])
    return {key: (len(sets[key]), found[key]) for key in sets}


def test_near_duplicates_equal_all_pairs(spark, awkward, empty):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(6):
        base = [random.choice(vocabulary) for _ in range(120)]
        for _ in range(12):  # copies with edits around the threshold, and chains of them
            copy = list(base)
            for _ in range(random.randint(0, 7)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append(" ".join(copy))
            base = copy if group % 2 else base
    rows = [(i, t) for i, t in enumerate(rows + rows[:4] + [None, "", "  ", "a b", "A  b", "a b c"])]
    for words, percent in ((4, 80), (5, 80), (3, 70)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, words, percent).collect()}
        assert got == _near(rows, words, percent)
    found = minhash.near_duplicates(awkward, 4).collect()
    assert len(found) == awkward.count() and all(r.kept for r in found if r.doc_id is None)
    assert {r.component_id for r in found if r.doc_id in (4, 5, 12)} == {4}
    assert minhash.near_duplicates(empty, 4).collect() == []


def test_blocks_join_all_components():
    random.seed(9)
    sets = [np.unique(np.array([random.randrange(30) for _ in range(25)], dtype=np.int64)) for _ in range(40)]
    rows = [(i % 2, i, i, s) for i, s in enumerate(sets)]
    links = minhash._block_links(rows, 60)
    root = list(range(40))
    want = [(i, j) for i in range(0, 40, 2) for j in range(1, 40, 2)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]

    def classes(pairs):
        label = list(root)
        for _ in range(40):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert classes(links) == classes(want) and want and set(links) <= set(want)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50, 90)] + [(7, 3), (3, 7), (5, 5), (9, 3), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 50 for i in range(50, 91)}, 3: 3, 7: 3, 9: 3}
    assert components.components(links.limit(0)).collect() == []


def test_top_k_equals_brute_force(spark):
    random.seed(10)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)] + [(500, None), (501, [1.0, None] + [0.0] * 6), (520, [float("nan")] * 8), (540, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    whole = {k: [int(np.floor(64 * x)) for x in v] + [0] * (8 - len(v)) for k, v in rows
             if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (k for k in whole if k % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q)[:20]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    got = topk.top_k(df, pivots=6, block_rows=32).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(topk.top_k(df.where("vec_id < 3")).collect()) == 2
    assert topk.top_k(df.limit(0)).collect() == []


def test_top_k_keeps_long_vectors(spark):
    random.seed(13)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, [random.gauss(0, 1) * 10.0 ** (3 + i % 3) for _ in range(8)]) for i in range(100)]
    rows += [(400 + i, [3e6 + i % 3, 1.0] + [0.0] * 6) for i in range(30)] + [(500, [0.0] * 7 + [1e9])]
    whole = {k: [int(np.floor(64 * x)) for x in v] for k, v in rows}
    want = []
    for q in (k for k in whole if k % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q)[:20]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    assert max(abs(row[3]) for row in want) > 1 << 55
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, pivots=6, block_rows=32).collect())) == sorted(want)
    apart = spark.createDataFrame([(20, [1e30, 0.0, 2.0]), (21, [0.0, 1e40, 3.0])], "vec_id long, embedding array<double>")
    assert list(map(tuple, topk.top_k(apart).collect())) == [(20, 1, 21, 64 * 64 * 6)]
    for rows in ([(20, [1e9]), (21, [1e9])], [(20, [1e308]), (21, [1.0])]):
        with pytest.raises(Exception, match="does not fit 64 bits|beyond 2\\^500"):
            topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def test_language_on_rows_not_learned_from(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert {r.held_out for r in rows} == {True} and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    few = language.identify(awkward).collect()
    assert len(few) == awkward.count() and {r.lang_pred for r in few} <= {"en", "und"}
    assert {(r.lang_pred, r.score) for r in few if r.doc_id in (0, 1, 2)} == {("und", 0.0)}
    assert language.identify(empty).collect() == []
    unlabelled = language.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_ftrl_separates_and_is_sparse():
    random.seed(11)
    lengths, columns, labels = [], [], []
    for i in range(600):
        y = i % 3
        found = [0, 1 + y] + [4 + random.randrange(200) for _ in range(5)]
        lengths.append(len(found))
        columns += found
        labels.append(y)
    rows = linear.Rows(np.array(lengths), np.array(columns), np.ones(len(columns)))
    weights = linear.train_ftrl(rows, np.array(labels), 204, 3, l1=5.0)
    assert (rows.times(weights).argmax(axis=1) == labels).mean() > 0.99
    assert (weights[4:] == 0).mean() > 0.9 and np.abs(weights[1:4]).max() > 1


def test_toxicity(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = F.col("text").rlike(r"(?i)\b(idiot|moron|disgusting|trash|worthless|scum|clown|pathetic|stupid|loser)\b")
    rows = toxicity.score(docs, labels).join(docs.where("lang = 'en'").select("doc_id", known.alias("known")), "doc_id").join(
        labels, "doc_id", "left_anti").collect()
    assert sum(r.toxic for r in rows if r.known) > 0.9 * sum(r.known for r in rows)
    assert sum(r.toxic for r in rows if not r.known) < 0.01 * len(rows)
    few = toxicity.score(awkward, labels.limit(0)).collect()
    assert len(few) == awkward.count() and not any(r.toxic for r in few)
    some = spark.createDataFrame([(4, 1, None), (5, None, 1), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(toxicity.score(awkward, some).collect()) == awkward.count()
    assert toxicity.score(empty, labels).collect() == []


def test_pipeline(spark, tmp_path, awkward):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and {r.doc_id for r in rows} < {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    columns = awkward.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, FOLDER)
        assert out.columns == columns, name
        assert stage(spark, awkward.limit(0), FOLDER).collect() == []
    kept = corpus_pipeline.dedup_stage(spark, awkward, FOLDER).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert sum(r.doc_id is None for r in kept) == 2
    packed = corpus_pipeline.packing_stage(spark, awkward, FOLDER).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0) and {r.doc_id for r in packed} == {r.doc_id for r in awkward.collect()}
    assert corpus_pipeline.packing_stage(spark, awkward.limit(0), FOLDER).collect() == []
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py" and len(corpus_pipeline.STAGES) == 4


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    long = " ".join(f"w{i}" for i in range(400))
    near = long.replace("w7 ", "v7 ")
    rows = [(1, "one two three four five six", "en", 0), (1, "seven eight nine ten eleven twelve", "en", 0), (1, None, "en", 0), (1, long, "en", 5),
            (1, long, "en", 5), (1, long, "de", 6), (2, near, "en", 0), (3, near, "en", 0), (None, long, None, None), (None, long, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, number int")
    out = [corpus_pipeline.dedup_stage(spark, part, FOLDER).collect() for part in (docs, docs.repartition(5))]
    assert [sorted((r.doc_id, r.text or "") for r in found if r.doc_id is not None) for found in out] == 2 * [
        sorted([(1, ""), (1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (1, long)])]
    assert sorted(map(repr, out[0])) == sorted(map(repr, out[1])) and sum(r.doc_id is None for r in out[0]) == 2


def test_copies_are_in_the_training_sample_once(spark):
    """A big group of copies changes neither the chain nor the number of rows that one task trains on."""
    rows = [(i, f"plain words {i % 7} of text {chr(97 + i % 11)}", i % 2, i % 3 == 0) for i in range(60)]
    labelled = spark.createDataFrame(rows, "key long, text string, low_quality int, toxic boolean")
    copies = spark.range(100, 2100).select(F.col("id").alias("key"), F.lit(rows[0][1]).alias("text"), F.lit(rows[0][2]).alias("low_quality"),
                                           F.lit(rows[0][3]).alias("toxic"))
    one, many = (toxicity.fit(df, ["low_quality", "toxic"], training_rows=10_000, key="key") for df in (labelled, labelled.unionByName(copies)))
    assert one.columns == many.columns
    assert all((a == b).all() for a, b in zip(one.weights, many.weights))
