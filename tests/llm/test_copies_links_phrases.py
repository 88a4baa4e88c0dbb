"""Exact copies, aligned tokens and collocations against brute force, with the awkward rows of every table."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("veilwright.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from veilwright.llm import alignment, exact_copies, phrases  # noqa: E402
from veilwright.llm.common import with_row_id  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string, lang string, run int, digest string, row_id int, chunk int, kind int"
LONG = " ".join(f"w{i * 7919 % 1013}" for i in range(60_000))
TEXTS = [
    (5, None, None), (5, "", "en"), (None, None, "en"), (None, "a b", ""), (9001, "a b", "en"), (9001, "a b", "en"),
    (9002, "a  b", "en"), (9000, "a \tb", "en"), (9003, " \t\n\x0b\x0c\r", "fr"), (9004, "A b", None), (9005, LONG, "en"),
    (9006, "ñ 一 😀 ﬁ", "fr"), (9007, "it's <|endoftext|> <s> </s> <0x41>", "en"), (9008, "a▁b", "en"), (9009, "͸ unassigned", "en"),
    (9010, "Red fox. red FOX! red fox ran; red fox ran, red fox ran away", "en"), (9011, "x. x y x y x y: x y\tx y", "und"),
    (9012, "tail  ", "en"), (9013, "  head", "en"), (9014, "a\n\nb \n c", "en"), (9015, "\x00", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    more = spark.createDataFrame([(d, t, g, 1, "d", 2, 3, 4) for d, t, g in TEXTS], SCHEMA)
    own = spark.read.parquet(DOCS).select("doc_id", "text", "lang")
    return own.unionByName(more, allowMissingColumns=True).repartition(23).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


# --- exact copies --------------------------------------------------------------


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text)


def groups_of(rows):
    groups = collections.defaultdict(list)
    for doc_id, text, _ in rows:
        groups[bare(text)].append((-len(text), doc_id is None, doc_id or 0))
    out = []
    for text, members in groups.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        for place, (_, nameless, doc_id) in enumerate(members):
            out.append((None if nameless else doc_id, keep, len(members), place == 0, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("fan", [2, 16, 64])
def test_copies(docs, rows, fan, monkeypatch):
    monkeypatch.setattr(exact_copies, "FAN", fan)
    named, key = with_row_id(docs, "test")
    same(exact_copies.copy_groups(named, key).drop(key), groups_of(rows))


def test_copies_of_a_hot_text(spark):
    many = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(" hot ")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text")
    ).repartition(40)
    named, key = with_row_id(many, "test")
    found = exact_copies.copy_groups(named, key)
    assert found.where("kept").count() == 2001
    hot = found.where("group_size = 1000")
    assert hot.count() == 1000 and [tuple(r) for r in hot.select("keep_id").distinct().collect()] == [(0,)]


def test_copies_dropped(docs, rows, none):
    kept = exact_copies.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[3] for r in groups_of(rows))
    assert exact_copies.drop_copies(none).count() == 0
    named, key = with_row_id(none, "test")
    assert exact_copies.copy_groups(named, key).count() == 0


# --- aligned tokens ------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes(both, text):
    """[(id, bytes)] of A and of B by the libraries alone."""
    a, b = both
    table = {v: k for k, v in alignment.SYMBOLS.items()}
    ids = a.encode(" " + text, add_special_tokens=False).ids
    first = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in ids]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return first, second


def aligned_by_hand(both, rows):
    found = []
    for doc_id, text, _ in rows:
        a, b = token_bytes(both, text)
        want = (" " + text).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            found.append((doc_id, [], [], None))
            continue
        groups, links, i, j, end_a, end_b, own = [], [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                own[0].append(a[i][0])
                end_a += len(a[i][1])
                i += 1
            else:
                own[1].append(b[j][0])
                end_b += len(b[j][1])
                j += 1
            if end_a == end_b:
                groups.append(own)
                links.append((own[0][-1], own[1][-1]))
                own = ([], [])
        found.append((doc_id, groups, links, (len(a), len(b))))
    count = collections.Counter(x for _, _, links, _ in found for x in links)
    highest = collections.defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc_id, groups, links, sizes in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if sizes else ""
        best = sum(count[x] == highest[x[1]] for x in links)
        out.append((doc_id, *(sizes or (0, 0)), len(groups), len(links), best, sum(count[x] for x in links), digest))
    return out


def test_aligned_tokens(docs, rows, both, none):
    per_doc, pairs = alignment.align_tokens(docs, A, B)
    same(per_doc, aligned_by_hand(both, rows))
    assert pairs.where("is_best").select("b").distinct().count() == pairs.select("b").distinct().count()
    assert alignment.align_tokens(none, A, B)[0].count() == 0


def test_segments_are_the_models(both):
    draw = random.Random(7)
    parts = ["a", "th", "e", " ", "  ", "\n", "é", "一", "😀", "<", ">", "0x41", "tion", ".", "\t", "'s", "▁", "<|endoftext|>", "\x00"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    for text, got in zip(texts, alignment.both_ids(A, B, texts)):
        a, b = token_bytes(both, text)
        want = (" " + text).encode()
        spelled = text and b"".join(x for _, x in a) == want and b"".join(x for _, x in b) == want
        assert (got is not None) == bool(spelled), text
        if got is not None:
            assert (got[0].tolist(), got[1].tolist()) == ([i for i, _ in a], [i for i, _ in b]), text


def test_groups_spell_the_same_bytes(docs, both):
    some = docs.where("doc_id in (9006, 9010, 9014)")
    groups = collections.defaultdict(list)
    for r in alignment.aligned_groups(some, A, B).collect():
        groups[r.doc_id].append(r)
    of_a, of_b = alignment._byte_level(A)[0].tokens, alignment._sentence_pieces(B)[0].tokens
    for r in some.collect():
        own = sorted(groups[r.doc_id], key=lambda g: g.group)
        spelled = [b"".join(of_a[i] for i in g.a) for g in own]
        assert spelled == [b"".join(of_b[i] for i in g.b) for g in own]
        assert b"".join(spelled) == (" " + r.text).encode() and own[-1].byte_end == len(b"".join(spelled))


# --- collocations --------------------------------------------------------------


def phrases_by_hand(rows, least, top):
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = collections.defaultdict(int)
        for p, c in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], c)
        scored = []
        for p, a in candidates.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


@pytest.mark.parametrize("least, top, fan", [(2, 5000, 3), (3, 7, 24)])
def test_collocations(docs, rows, least, top, fan, monkeypatch):
    monkeypatch.setattr(phrases, "FAN", fan)
    same(phrases.collocations(docs, least, top), phrases_by_hand(rows, least, top))


def test_no_collocations(none, docs):
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(docs.where("doc_id = 5")).count() == 0


def test_tiles_count_like_a_dictionary():
    draw = np.random.default_rng(5)
    left = np.concatenate([draw.integers(0, 500, 60_000), draw.integers(0, 1 << 33, 900)])
    right = np.concatenate([draw.integers(0, 500, 60_000), draw.integers(0, 1 << 33, 900)])
    n = draw.integers(1, 9, len(left))
    want = collections.Counter()
    for a, b, k in zip(left.tolist(), right.tolist(), n.tolist()):
        want[a, b] += k
    got = phrases.tile_counts(left, right, n)
    assert dict(zip(zip(got[0].tolist(), got[1].tolist()), got[2].tolist())) == dict(want)
    assert len(got[0]) == len(want)
    found = phrases.looked_up(left, right, got)
    assert found.tolist() == [want[x] for x in zip(left.tolist(), right.tolist())]
    assert phrases.looked_up(left + (1 << 40), right, got).max() == -1


@pytest.mark.parametrize("top", [0, 200, 254, 255, 256, 70_000, 1 << 24, 1 << 40, (1 << 62)])
def test_packed_numbers_come_back(top):
    numbers = np.random.default_rng(3).integers(-1, top + 1, 500)
    numbers[0] = top
    assert phrases.unpack(phrases.pack(numbers)).tolist() == numbers.tolist()
    assert len(phrases.unpack(phrases.pack(numbers[:0]))) == 0
