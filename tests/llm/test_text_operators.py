"""Operators on whole texts against brute force, with the awkward rows of every table."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("veilwright.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from veilwright.llm import near_copies, piece_counts, piece_text, repeated_passages, suffix_levels, token_files  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string, fingerprint string, chunk int, size int"
LONG = " ".join(f"w{i * 7919 % 1013}" for i in range(30_000))
RUN = " ".join(f"v{i}" for i in range(60))
AWKWARD = [
    (5, None), (5, ""), (None, None), (None, RUN), (7001, RUN + " x"), (7001, RUN + " x"), (7002, " \t\n"),
    (7003, "a " * 100), (7004, "A B c"), (7005, "a\tb\x0bc"), (7006, "ñ" * 70), (7007, "it's <|endoftext|>  it's"),
    (7008, "͸ unassigned"), (7009, "x y　z ''s 're'll"), (7010, LONG), (7011, "a" * 300),
]


@pytest.fixture(scope="module")
def docs(spark):
    """A small table with awkward rows, and columns whose names clash with the operators' own."""
    more = spark.createDataFrame([(d, t, "f", 1, 2) for d, t in AWKWARD], SCHEMA)
    own = spark.read.parquet(DOCS).select("doc_id", "text", *[F.lit(None).cast(k).alias(n) for n, k in (("fingerprint", "string"), ("chunk", "int"), ("size", "int"))])
    return own.unionByName(more).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_pieces_are_the_librarys():
    tokenizer = piece_text.load_tokenizer(BPE)
    draw = random.Random(1)
    texts = ["".join(draw.choice("a b1'  \n\t'stmdrevl!é’ 一😀x\x00") for _ in range(draw.randint(0, 14))) for _ in range(20_000)]
    found = piece_text.Pieces(texts)
    assert not found.hard
    per = [[] for _ in texts]
    for doc, piece in zip(found.doc.tolist(), found.of.tolist()):
        per[doc].append(found.distinct[piece])
    for text, pieces in zip(texts, per):
        assert pieces == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_token_counts(docs, rows, none):
    encode = piece_text.load_tokenizer(BPE).encode
    want = [(d, len(t.encode()), n := len(encode(t, add_special_tokens=False).ids), n > 512) for d, t in rows]
    same(piece_counts.count_tokens(docs, BPE), want)
    same(piece_counts.count_tokens(none, BPE), [])


def test_token_counts_over_many_chunks(docs, rows, monkeypatch):
    parts = piece_counts._split(BPE, 5)
    monkeypatch.setattr(piece_counts, "CHUNK_CHARS", 1000)
    assert parts  # the limit is read when a task runs
    encode = piece_text.load_tokenizer(BPE).encode
    got = piece_counts.count_tokens(docs, BPE).agg(F.sum("n_tokens")).first()[0]
    assert got == sum(len(encode(t, add_special_tokens=False).ids) for _, t in rows)


def test_token_files(spark, docs, rows, none):
    encode = piece_text.load_tokenizer(BPE).encode
    ids = [(d, [*encode(t, add_special_tokens=False).ids, 0]) for d, t in rows]
    got = token_files.token_files(docs, BPE).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((d, len(x), crc(x)) for d, x in ids), key=str)
    start, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and (r.doc_id is None or r.doc_id >= last)
        start, last = start + r.n_tokens, last if r.doc_id is None else r.doc_id
    same(token_files.token_files(none, BPE), [])


def test_known_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_PIECES", 50)
    texts = [" ".join(f"w{i * k}x" for i in range(40)) + " the end" for k in range(1, 12)]
    for _ in range(2):
        for text in texts:
            assert token_files.token_arrays(BPE, [text])[0].tolist() == piece_text.whole_ids(BPE, text)
    known = token_files._cache(BPE)
    assert len(known.young) <= 50 and len(known.old) <= 50 and known.ids(" the") is known.young[" the"]


def test_token_files_round_trip(spark, docs, rows, tmp_path):
    encode = piece_text.load_tokenizer(BPE).encode
    token_files.write_token_files(docs, BPE, str(tmp_path / "ids"), block_ids=500)
    back = token_files.read_token_files(spark, str(tmp_path / "ids"))
    want = [(d, [*encode(t, add_special_tokens=False).ids, 0]) for d, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in back.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("top", [1, 200, 256, 70_000, 20_000_000])
def test_codes_round_trip(top):
    ids = np.random.default_rng(top).integers(0, top, 1003).astype(np.uint32)
    assert (token_files.decode_ids(len(ids), *token_files.encode_ids(ids)) == ids).all()
    assert len(token_files.decode_ids(0, *token_files.encode_ids(ids[:0]))) == 0


def test_codes_use_all_widths():
    ids = np.concatenate([np.arange(70_000), np.zeros(9, int)]).astype(np.uint32)
    ranked, control, data = token_files.encode_ids(ids)
    assert (token_files.decode_ids(len(ids), ranked, control, data) == ids).all()
    assert len(data) == 9 + 256 + 2 * (65_536 - 256) + 3 * (70_000 - 65_536)


def fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def test_near_copies(docs, rows, none):
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints) <= 4, 1))
    label = near_copies.forest(len(rows), a, b)
    low = collections.defaultdict(list)
    for (d, _), root in zip(rows, label):
        low[root] += [d] if d is not None else []
    same(near_copies.near_copies(docs), [(d, f"{int(p):016x}", min(low[root], default=None)) for (d, _), p, root in zip(rows, prints, label)])
    same(near_copies.near_copies(none), [])


@pytest.mark.parametrize("memory", [2000, 6_000_000])
def test_ball_links_find_every_near_pair(monkeypatch, memory):
    monkeypatch.setattr(near_copies, "IN_MEMORY", memory)
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(60)]
    values = set(base)
    for centre in base[:20] + base[:1] * 30:  # and one large group
        for _ in range(10):
            v = centre
            for i in draw.sample(range(64), draw.randint(1, 7)):
                v ^= 1 << i
            values.add(v)
    values = np.array(sorted(values), np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values) <= 4, 1))
    want = near_copies.forest(len(values), a, b)
    start = (values, np.arange(len(values)), np.zeros(len(values), np.uint64), 0, 2)
    other, first = near_copies._link_values(*start)
    got = near_copies.forest(len(values), np.searchsorted(values, first), np.searchsorted(values, other))
    assert (got == want).all()
    other, first = near_copies._link_values(*start, forests=2)
    assert (np.bitwise_count(other ^ first) <= 4).all()
    got = near_copies.forest(len(values), np.searchsorted(values, first), np.searchsorted(values, other))
    assert (got == want).all()


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (260, 261)], "a long, b long")
    want = {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(200, 260)}, 261: 260}
    assert {r.node: r.root for r in near_copies.components(links).collect()} == want


def test_one_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(100)]
    near = words[:50] + ["changed"] + words[51:]
    far = words[:50] + [f"o{i}" for i in range(50)]
    texts = [(3, " ".join(words)), (2, " ".join(near)), (None, " ".join(words)), (9, " ".join(far)), (9, " ".join(far)), (4, None), (6, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, ROW_ID string")
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 9]
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_copies_of_equal_word_sets_are_compared(spark):
    words = [f"w{i}" for i in range(100)]
    text = " ".join(words)
    texts = [(1, " ".join(reversed(words))), (2, text), (3, text.upper().replace(" ", "  ")), (4, text + " w0")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == [1, 2]


def test_near_copies_match_brute_force(spark):
    draw = random.Random(8)
    new = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    line, texts = new(30), []
    for i in range(24):
        base = new(draw.choice([12, 100, 300])) + line * (i % 2)
        texts.append(base)
        for share in (0.05, 0.1, 0.17, 0.2, 0.24, 0.27):
            n = max(1, int(len(base) * share))
            at = draw.randrange(len(base))
            texts += [base + new(n), new(n) + base, base[n * 4 // 5 :], base[:at] + new(n) + base[at:]]
            texts.append([w if draw.random() > share / 9 else f"c{at}" for w in base])
    texts += [line + new(k) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9) for _ in range(5)] + [new(k) for k in range(8)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    sets = [near_copies.shingle_set(t, 5) for _, t in rows]
    close = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if close(sets[i], sets[j])]
    label = near_copies.forest(len(rows), *np.array(pairs).T)
    want = {}
    for (d, _), root in zip(rows, label.tolist()):
        want[root] = min(d, want.get(root, d))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == sorted(want.values())


def without_windows(rows, width):
    texts = [t.encode().split() for _, t in rows]
    times = collections.Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    for (d, _), words in zip(rows, texts):
        keep = np.ones(len(words), bool)
        for i in range(len(words) - width + 1):
            if times[tuple(words[i : i + width])] > 1:
                keep[i : i + width] = False
        left = [w for w, k in zip(words, keep) if k]
        yield d, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


@pytest.mark.parametrize("chunk_bytes", [100_000, 16_000_000])
def test_repeated_passages(docs, rows, chunk_bytes):
    same(repeated_passages.remove_repeated_passages(docs, chunk_bytes=chunk_bytes), list(without_windows(rows, 35)))


def test_repeated_passages_of_nothing(none):
    same(repeated_passages.remove_repeated_passages(none), [])


def test_factors_name_their_source(spark):
    body = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(body)), (2, " ".join(["x", *body[10:60], "y"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.start, r.n_words) for r in repeated_passages.repeated_factors(docs).collect()}
    assert found == {(1, 10, 50), (2, 1, 50)}


def without_strings(rows, length):
    rank = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in rows:
        data = t.encode()
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(first.get(s, rank(d)), rank(d))
    for d, t in rows:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < rank(d):
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        yield d, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("chunk_bytes", [60_000, 8_000_000])
def test_repeated_bytes(docs, rows, chunk_bytes):
    same(suffix_levels.remove_repeated_bytes(docs, chunk_bytes=chunk_bytes), list(without_strings(rows, 50)))


def test_repeated_bytes_of_nothing(none):
    same(suffix_levels.remove_repeated_bytes(none), [])


def test_levels_merge_geometrically():
    data = np.random.default_rng(0).integers(0, 4, 40_000).astype(np.uint8)
    family = suffix_levels.SuffixFamily(data, 12)
    seen = {}
    for doc, at in enumerate(range(0, 39_000, 300)):
        places = np.arange(at, at + 300)
        hashes = suffix_levels.suffix_hashes(data, places[:1], np.array([300]), 12)
        found = family.add(hashes, places, np.full(300, doc))
        want = [seen.setdefault(data[p : p + 12].tobytes(), doc) < doc for p in places]
        assert found.tolist() == want
    sizes = [len(level[0]) for level in family.levels]
    assert len(sizes) <= 9 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_neighbouring_suffixes_share_their_bytes(monkeypatch):
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(draw.choices(words, k=600)) for _ in range(20)]
    texts[7:9] = [texts[3][100:900], "short"]
    n = len(texts)
    rows = pa.table({"doc_id": range(n), "row_id": range(n), "chunk": [0] * n, "text": texts})
    chunk = suffix_levels.Texts(rows, 50)
    lows, _ = chunk.lows()
    hashed, known = [], suffix_levels.window_hashes
    monkeypatch.setattr(suffix_levels, "window_hashes", lambda data, length: hashed.append(len(data)) or known(data, length))
    chunk.take(np.ones(len(lows), bool))
    assert len(chunk.at) == sum(max(0, len(t) - 49) for t in texts)
    assert sum(hashed) <= 1.1 * sum(map(len, texts))  # not the 49 bytes after each run again
    joined, first = "".join(texts), {}
    for at in chunk.at.tolist():
        first.setdefault(joined[at : at + 50], at)
    doc = np.searchsorted(np.cumsum([len(t) for t in texts]), chunk.at, side="right")
    of_first = np.searchsorted(np.cumsum([len(t) for t in texts]), [first[joined[a : a + 50]] for a in chunk.at], side="right")
    assert chunk.found.tolist() == (of_first < doc).tolist() and chunk.found.any()
