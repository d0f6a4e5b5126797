"""Periodic runs, secrets and spelling variants against plain loops, with awkward rows."""

import base64
import collections
import hashlib
import itertools
import operator
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlens.llm import periodic, queries, secret_scan, spelling
from hearthlens.plans.registry import table

FOLDER = "/root/testdata/sf0.001"
LONG = "la " * 30_000 + " ".join(f"w{i}" for i in range(30_000)) + " tra la la" * 9_000
TEXTS = [None, "", " \t\n", "a", "to be " * 20, "to be " * 20, "x y " * 30, LONG, "password = hunter22 deadbeef" * 3, "\x1c a \x85 b" * 30]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "src", i) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "src", 0), (None, "to be " * 20, None, 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, __h string, runs int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, word string")


def plain_runs(words, least=24, periods=3):
    """Every lag, every place."""
    found = {}
    for lag in range(1, len(words) // periods + 1):
        i = 0
        for same, group in itertools.groupby(map(operator.eq, words, words[lag:])):
            j = i + len(list(group))
            if same and j - i + lag >= max(least, periods * lag):
                found.setdefault((i, j + lag), lag)
            i = j
    return sorted((a, b - a, lag) for (a, b), lag in found.items())


def test_runs_are_those_of_a_plain_scan():
    random.seed(1)
    total = 0
    for _ in range(1000):
        letters = "abcdefghijklmnopqrstuvwxyz0123456789"[:random.choice([1, 2, 3, 5, 30])]
        words = [random.choice(letters) for _ in range(random.randint(0, 150))]
        for _ in range(random.randint(0, 3)):
            if words:
                at, size = random.randrange(len(words)), random.randint(1, 50)
                words = words[:at] + words[at:at + size] * random.randint(2, 6) + words[at + size:]
        texts = [" ".join(words).encode(), None, " ".join(words[::-1]).encode()]
        for text, (n, runs, rest) in zip(texts, periodic.find_runs(texts)):
            own = (text or b"").split()
            want = plain_runs(own)
            gone = {i for s, l, p in want for i in range(s + p, s + l)}
            assert (n, runs) == (len(own), want) and rest == b" ".join(w for i, w in enumerate(own) if i not in gone)
            total += len(want)
    assert total > 1000


def test_long_lags_and_splits():
    random.seed(2)
    block = [b"%d" % random.randint(0, 60) for _ in range(700)]
    words = [b"once"] + block * 4 + [b"twice"] + block[:300] * 3
    assert next(periodic.find_runs([b" ".join(words)]))[1] == [(1, 2800, 700), (2802, 900, 300)]
    codes = np.array([0, 1, 2] * 10 + [3] + [4] * 20 + [0, 1] * 2)
    assert periodic.surviving(codes, np.zeros(len(codes), dtype=int)) == [(0, 30)]
    assert periodic.surviving(codes, np.arange(len(codes)) // 20) == []
    # the first round cuts at 9 and loses a 0 before it, which makes the zeros of the rest rare in the next
    chain = np.array([0, 9] + [1, 2, 3] * 9 + [0, 0] + [4] * 30)
    assert periodic.surviving(chain, np.zeros(len(chain), dtype=int)) == [(2, 29), (31, 61)]


def test_periodic_query_equals_plain_loops(spark):
    rows = {r.doc_id: r for r in queries.op11_periodic(spark, FOLDER).collect()}
    docs = table(spark, FOLDER, "documents").collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows.values())
    for doc in docs:
        words = re.findall("[^\x20\x09-\x0D]+", doc.text or "")
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = sorted(plain_runs(words), key=lambda run: (run[0], run[2]))
        gone = {i for s, l, p in runs for i in range(s + p, s + l)}
        best = min(runs, key=lambda run: (-run[1] / run[2], run[0], run[2]), default=(None,) * 3)
        row = rows[doc.doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{l},{p}\n" for s, l, p in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def test_periodic_runs_of_awkward_rows(spark, awkward, empty):
    planted = periodic.with_planted_runs(awkward)
    assert planted.columns == awkward.columns and planted.where("__h = 'src'").count() == awkward.where("__h = 'src'").count()
    rows = periodic.periodic_runs(planted).collect()
    assert len(rows) == awkward.count()
    assert all(r.n_words == 0 and not r.runs and r.collapsed == "" for r in rows if r.doc_id in (0, 1, 2))
    plain = {r.doc_id: r for r in periodic.periodic_runs(awkward.where("doc_id is not null")).collect()}
    assert [tuple(r) for r in plain[4].runs] == [(0, 40, 2)] and plain[4].collapsed == "to be"
    assert plain[6].n_words == 30 and plain[9].n_words == 91, "only the white space of ASCII parts words"
    assert [tuple(r) for r in plain[7].runs] == [(0, 30_000, 1), (60_000, 27_000, 3)]
    assert periodic.periodic_runs(periodic.with_planted_runs(empty)).collect() == []
    best = spark.createDataFrame([([(5, 30, 2), (0, 60, 4), (9, 45, 3)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] and tuple(r[0]) for r in best.select(periodic.strongest(F.col("runs"))).collect()] == [(0, 60, 4), None]


ASSIGN = re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
                    "[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def spans(text):
    return [(f["kind"], f["start"], f["end"], f["detail"]) for f in secret_scan.scan_text(text.encode())]


def test_patterns_equal_plain_expressions():
    random.seed(4)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "=", ":", " ", "  ", '"', "'", "abc", "é", "ſ", "K", "AKIA",
             "ABCDEFGHIJKL9", "deadbeef", "0123456789abcdef", "\n", "日", "/", ".", "x" * 9, "-----", "toKen"]
    for _ in range(20_000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        got = [(start, secret_scan.KINDS.index(kind), end) for kind, start, end, _ in spans(text) if kind in secret_scan.KINDS[:3]]
        assert got == plain_secrets(text)


def tlv(tag, content):
    size = len(content)
    if size < 128:
        return bytes([tag, size]) + content
    width = (size.bit_length() + 7) // 8
    return bytes([tag, 0x80 | width]) + size.to_bytes(width) + content


def key_bytes():
    random.seed(6)
    number = lambda size: tlv(2, b"\x01" + random.randbytes(size))
    field = lambda content: len(content).to_bytes(4) + content
    yield "der", "rsa", tlv(0x30, tlv(2, b"\0") + b"".join(number(63) for _ in range(8)))
    yield "der", "dsa", tlv(0x30, tlv(2, b"\0") + b"".join(number(40) for _ in range(5)))
    yield "der", "ec", tlv(0x30, tlv(2, b"\1") + tlv(4, random.randbytes(32)) + tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))))
    yield "der", "pkcs8", tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, bytes.fromhex("2b6570"))) + tlv(4, tlv(4, random.randbytes(32))))
    yield "der", "pkcs8 encrypted", tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")) + tlv(0x30, b"")) + tlv(4, random.randbytes(64)))
    yield "openssh", "openssh none", (b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4)
                                      + field(random.randbytes(51)) + field(b"abcdabcd" + random.randbytes(120)))


@pytest.mark.parametrize("kind, detail, key", list(key_bytes()), ids=lambda v: v if isinstance(v, str) else "")
def test_keys_are_confirmed_by_their_lengths(kind, detail, key):
    own = lambda text: [f for f in spans(text) if f[0] in secret_scan.KINDS[3:]]
    text = base64.b64encode(key).decode()
    url = base64.urlsafe_b64encode(key).rstrip(b"=").decode()
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(text[i:i + 64] for i in range(0, len(text), 64)) + "\n-----END PRIVATE KEY-----"
    assert own(f"é {text} end") == [(kind, 2, 2 + len(text), detail)]
    assert own(f"k=/keys/{text}") == [(kind, 8, 8 + len(text), detail)]
    for whole in (text, url, key.hex(), key.hex().upper(), pem, pem.replace("\n", "\\n"), base64.b64encode(pem.encode()).decode()):
        assert own(whole) == [(kind, 0, len(whole), detail)]
    damaged = [text[:-8] + "=", text[4:], text.rstrip("=") + "AAAA", key.hex()[:-2], pem[:70] + "x" + pem[70:],
               base64.b64encode(key[:-1]).decode(), base64.b64encode(key[:3] + bytes([key[3] ^ 1]) + key[4:]).decode()]
    for broken in damaged:
        assert own(broken) == []


def test_tokens_are_confirmed_by_their_parts():
    url = lambda content: base64.urlsafe_b64encode(content).rstrip(b"=").decode()
    token = url(b'{"alg":"HS256","typ":"JWT"}') + "." + url(b'{"sub":"1"}') + "." + url(bytes(range(32)))
    own = lambda text: [f for f in spans(text) if f[0] == "token"]
    assert own(f"日 {token} y") == [("token", 2, 2 + len(token), "HS256")]
    assert own(f"a.b.{token}.") == [("token", 4, 4 + len(token), "HS256")]
    assert [f[:3] for f in spans(f"Token={token}")] == [("assign", 0, 6 + len(token)), ("token", 6, 6 + len(token))]
    bare = url(b'{"alg":"none"}') + "." + url(b"{}") + "."
    assert own(bare) == [("token", 0, len(bare), "none")]
    sealed = ".".join([url(b'{"alg":"dir","enc":"A128GCM"}'), url(b"k" * 9), url(b"i" * 12), url(b"c" * 20), url(b"t" * 16)])
    assert own(sealed) == [("token", 0, len(sealed), "dir")]
    for broken in (token[3:], token.rsplit(".", 1)[0], token.replace(".", ".."), url(b'{"typ":"JWT"}') + token[token.index("."):],
                   url(b'{"alg":"HS256"}') + ".bm90anNvbg." + url(b"s" * 32), url(b'[{"alg":1}]') + ".e30.AAAA"):
        assert own(broken) == []


def test_secrets_query_and_awkward_rows(spark, awkward, empty):
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
        rows = queries.op12_secrets(spark, folder).collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = plain_secrets(texts[r.doc_id])
            line = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want)
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
            assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
            assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    rows = secret_scan.scan(awkward).collect()
    assert len(rows) == awkward.count() and all(r.found == [] for r in rows if r.doc_id in (None, 0, 1, 2, 3, 4, 5, 7))
    assert len([r for r in rows if r.doc_id == 8][0].found) == 3
    assert secret_scan.scan(empty).collect() == []


def plain_variants(counts, least=3):
    words = {w: n for w, n in counts.items() if n >= least}

    def holes(word):
        return {word[:i] + word[i + 1:] for i in range(len(word))}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return (b in holes(a)) if len(a) == len(b) + 1 else a in holes(b) if len(b) == len(a) + 1 else False

    rows, forms = {}, {}
    for word, n in words.items():
        near = [o for o in words if o != word and abs(len(o) - len(word)) <= 1 and apart(word, o)]
        best = min(near, key=lambda o: (-words[o], o), default=None)
        forms[word] = best if best is not None and words[best] >= 2 * n else None
        rows[word] = (n, len(near))
    out = set()
    for word, (n, near) in rows.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        out.add((word, forms[word], root, n, near, words.get(forms[word])))
    return out


def plain_words(docs, least=5):
    counts = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if key is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                counts[run] += 1
    return counts


def test_occurrences_are_those_of_a_plain_count(spark, awkward, empty):
    texts = ["Ñandú ÀÉÿ×÷ straße Straße STRASSE Ābcdef ﬀabcde word_word a1bcdefg" * 9, "Hello hello HELLO hellp" * 200]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 30)] + [(None, texts[0])], "doc_id long, text string").unionByName(
        awkward.select("doc_id", "text"))
    got = {r.word: r.n for r in spelling.occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    assert got == plain_words([(r.doc_id, r.text) for r in docs.collect()])
    assert spelling.occurrences(empty).collect() == []


@pytest.mark.parametrize("letters_of_a_cell", [spelling.CELL_LETTERS, 12])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, letters_of_a_cell):
    monkeypatch.setattr(spelling, "CELL_LETTERS", letters_of_a_cell)
    random.seed(8)
    counts = collections.Counter()
    for _ in range(700):
        word = "".join(random.choice("eatoé") for _ in range(random.randint(1, 7)))
        counts[word] += random.choice([1, 2, 3, 5, 9, 20, 70])
    counts |= {"banana" + "x" * 3000: 5, "banana" + "x" * 2999: 30, "xanana" + "x" * 2999: 30, "a": 9, "b": 50}
    rows = [(w, n) for w, n in counts.items()] + [(None, 5), ("", 9), ("once", 2)]
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()
    assert {tuple(r) for r in got} == plain_variants(counts) and len(got) == len({r.word for r in got})


def test_variants_of_ties_repeats_and_nothing(spark, empty):
    rows = [("aaaaa", 3), ("aaaab", 3), ("aaaab", 3), ("aaaac", 6), ("zzzzz", 1), ("zzzzz", 1)]
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {("aaaaa", "aaaab", "aaaab", 3, 2, 6), ("aaaab", None, "aaaab", 6, 2, None), ("aaaac", None, "aaaac", 6, 2, None)}
    none = spelling.variants(spark.createDataFrame([], "word string, n long"))
    assert none.columns == ["word", "form", "root", "n", "n_near", "form_n"] and none.collect() == []
