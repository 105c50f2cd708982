"""Alignment of two tokenizers against both libraries on whole texts and plain dictionaries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.llm import alignment
from ragspark.llm.queries import tokenizer_path

FILES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
random.seed(11)
ODD = ["a", "The", " ", "  ", "\n", "\t ", "é", "é", "日本語", "😀", "\x00", "\x1c", "\x85", "\xa0", " ", "ﬁ", "٣", "12", "don't",
       "<s>", "<0x41>", "<|endoftext|>", "...", "ß", "​", "Straße", "of", "token", "-", "'", "\r\n", "﻿", "ÿ"]
TEXTS = ([None, "", " ", "  ", "\n", "x", " x", "x ", " x  y ", "a▁b", "▁", "clean ▁ no tokens", "<|endoftext|> <s> </s> <unk> <0x41>",
          "y" * 30_000, "word " * 5_000, "The quick brown fox  jumps\n\n over the lazy dog's 123 tails. " * 40]
         + ["".join(random.choice(ODD) for _ in range(random.randrange(1, 30))) for _ in range(400)])


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(TEXTS), (None, "The token of The"), (5, TEXTS[5]), (5, TEXTS[5])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    plain = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    return plain.select("*", F.lit("p").alias("pair"), F.lit(1).alias("n"), F.lit(2).alias("part"), F.lit(3).alias("n_a"))


def whole(rows):
    """Groups of every whole text by the libraries themselves, and the counts of all linked pairs."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=FILES[1])
    groups, counts = [], Counter()
    for _, text in rows:
        found = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            a_raw = [alignment.byte_level_bytes(first.id_to_token(i)) for i in a]
            b_raw = [alignment.piece_bytes(second.id_to_piece(i)) for i in b]
            if b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
                a_end, b_end = np.cumsum([*map(len, a_raw)]).tolist(), np.cumsum([*map(len, b_raw)]).tolist()
                i = j = 0
                for end in sorted(set(a_end) & set(b_end)):
                    k, m = a_end.index(end, i) + 1, b_end.index(end, j) + 1
                    found.append((a[i:k], b[j:m]))
                    i, j = k, m
        groups.append(found)
        counts.update((x[-1], y[-1]) for x, y in found)
    return groups, counts


def test_alignment(docs, rows):
    groups, counts = whole(rows)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = []
    for (i, _), found in zip(rows, groups):
        links = [(x[-1], y[-1]) for x, y in found]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        want.append((i, sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), len(links),
                     sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links),
                     hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    assert sum(not g for g in groups) >= 4 and sum(counts.values()) > 10_000
    got = alignment.align(docs, *FILES, with_groups=True).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_counts_of_pairs(docs, rows):
    _, counts = whole(rows)
    found = alignment.count_links(docs, *FILES)
    got = {divmod(k, found.b_size): n for k, n in zip(found.hashed.keys.tolist(), found.counts.tolist())}
    assert got == counts
    known = alignment.Tokenizers(*FILES)
    assert all(known.a_bytes[a].endswith(known.b_bytes[b]) or known.b_bytes[b].endswith(known.a_bytes[a]) for a, b in counts)
    assert len(counts) < known.most_pairs() < 1_000_000


def test_remembering_less_changes_nothing(docs, rows):
    known = alignment.Tokenizers(*FILES)
    groups, _ = whole(rows)
    together = alignment.Aligner(known, with_groups=True)
    numbers, ends = together.cut([t for _, t in rows])
    for (_, text), found, start, end in zip(rows, groups, ends, ends[1:]):
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        assert "".join(together.groups[n] for n in numbers[start:end])[:-1] == want
        single = alignment.Aligner(known, with_groups=True)
        assert "".join(single.groups[n] for n in single.cut([text])[0])[:-1] == want


def test_perfect_hash_is_minimal_and_verified():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 100_000):
        keys = np.unique(r.integers(0, 1 << 40, n))
        hashed = alignment.PerfectHash(keys)
        assert sorted(hashed.find(keys).tolist()) == [*range(len(keys))]
        other = np.setdiff1d(r.integers(0, 1 << 40, 5000), keys)
        assert (hashed.find(other) == -1).all()


def test_tree_sum_over_many_tasks(spark):
    keys = np.arange(0, 3000, 3)
    rows = spark.range(0, 20_000, 1, 40).selectExpr("(id * 7 % 1000) * 3 as pair", "id % 5 as n", "'x' as part")
    hashed = alignment.PerfectHash(keys)
    got = alignment.tree_sum(rows, hashed, fan_in=3)
    want = Counter()
    for i in range(20_000):
        want[i * 7 % 1000 * 3] += i % 5
    assert {int(k): int(n) for k, n in zip(hashed.keys, got)} == {k: want[k] for k in keys.tolist()}


def test_empty(docs):
    got = alignment.align(docs.where("false"), *FILES)
    assert got.count() == 0 and got.columns == ["doc_id", *alignment.STATS, "groups_sha256"]
    blank = alignment.align(docs.where("coalesce(length(text), 0) = 0"), *FILES).collect()
    assert [(r.doc_id, r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in sorted(blank)] == [(0, 0, 0, 0, ""), (1, 0, 0, 0, "")]
