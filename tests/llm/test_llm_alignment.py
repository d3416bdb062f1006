"""Alignment against a plain walk over byte ranges, and counts against loops over all documents."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import llm_cases
import numpy as np
import public_tokenizers
import pytest

from incidentry.llm import alignment
from incidentry.llm.queries import QUERIES

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def decoded(name):
    """A byte-level entry as bytes, by the published mapping of bytes to printable characters."""
    own = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    rest = [b for b in range(256) if b not in own]
    return bytes(ord(c) if ord(c) in own else rest[ord(c) - 256] for c in name)


@pytest.fixture(scope="module")
def plain():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PATHS[1])

    def tokens(text):
        """(id, bytes) of both sides, or none."""
        if not text:
            return [], []
        data = (" " + text).encode()
        left = [(i, decoded(a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.encode().replace("▁".encode(), b" ")))
        if b"".join(x for _, x in left) != data or b"".join(x for _, x in right) != data:
            return [], []
        return left, right

    def rows(texts):
        found, held = [], Counter()
        for text in texts:
            left, right = tokens(text)
            spans = []
            for side in (left, right):
                at, out = 0, []
                for i, data in side:
                    out.append((i, at, at + len(data)))
                    at += len(data)
                spans.append(out)
            cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
            parts = [([], []) for _ in cuts]
            for k, side in enumerate(spans):
                for i, _, e in side:
                    parts[bisect_left(cuts, e)][k].append(str(i))
            groups = ["|".join(map(",".join, part)) for part in parts]
            owners = [[(k, i) for k, (i, s, e) in enumerate(side) for _ in range(s, e)] for side in spans]  # of every byte
            links = [(i, j) for (_, i), (_, j) in dict.fromkeys(zip(*owners))]
            held.update(set(links))
            found.append((len(left), len(right), len(cuts), links, ";".join(groups)))
        best = {}
        for (i, _), n in held.items():
            best[i] = max(best.get(i, 0), n)
        return [
            (n_a, n_b, n_g, len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), groups)
            for n_a, n_b, n_g, links, groups in found
        ]

    return rows


def walked(a, b):
    found, i, j = [], 0, 0
    while i < len(a):
        if a[i] == b[j]:
            found.append(alignment.BOTH)
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            found.append(alignment.A_ON)
            i += 1
        else:
            found.append(alignment.B_ON)
            j += 1
    return found


def test_run_skipping_gives_what_a_walk_gives():
    pick = random.Random(1)
    for _ in range(1500):
        n, p, q = pick.randrange(0, 300), pick.random(), pick.random()
        a = [x for x in range(n) if pick.random() < p] + [n]
        b = [x for x in range(n) if (x in a and pick.random() < 0.95) or pick.random() < q / 5] + [n]
        assert alignment.steps(np.array(a), np.array(b)).tolist() == walked(a, b)
    assert alignment.steps(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
    long = np.arange(1, 100_001)
    assert (alignment.steps(long, long) == alignment.BOTH).all()


def test_table_against_plain_version(spark, plain):
    given = spark.read.parquet(f"{llm_cases.FOLDER}/documents.parquet").limit(70).select("doc_id", "text").collect()
    docs = spark.createDataFrame(given, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, *PATHS, most=20_000).collect()}
    assert found == {r["doc_id"]: row for r, row in zip(given, plain([r["text"] for r in given]))}


def test_query_columns(spark):
    rows = QUERIES["op12_alignment"](spark, llm_cases.FOLDER)
    assert rows.columns == ["doc_id", *COLUMNS[:-1], "groups_sha256"]
    assert {kind for name, kind in rows.dtypes if name != "groups_sha256"} == {"bigint"}
    assert rows.count() == spark.read.parquet(f"{llm_cases.FOLDER}/documents.parquet").count()


TEXTS = [
    None,
    "",
    " ",
    "  ",
    "a",
    "A plain line, with words.",
    " leading and trailing ",
    "two  spaces\n\nand lines\tand tabs\r\n",
    " no-break space",
    "▁ a lower block ▁x",
    "naïve café ́ combining",
    "<|endoftext|> and </s> and <s><unk> <0x41>",
    "漢字かな交じり文 🙂👍🏽 emoji ﻿",
    "\x00 \x01 control",
    "ﬁ ligature ① ²",
    "supercalifragilisticexpialidocious " * 40,
    "x" * 3000,
    "\n",
    "word\nword",
    "A plain line, with words.",
]


def test_texts_of_all_kinds(spark, plain):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)
    rows = alignment.align(docs, *PATHS).collect()
    expected = plain(TEXTS)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == expected[r["doc_id"]], TEXTS[r["doc_id"]]
    digests = {r["doc_id"]: r["groups"] for r in alignment.align(docs, *PATHS, as_text=False, keep_text=False).collect()}
    assert digests == {i: hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "" for i, row in enumerate(expected)}


def test_words_remembered_or_not(monkeypatch):
    texts = [text or "" for text in TEXTS]
    whole = alignment.Aligner(*PATHS)
    whole.b.by_word = False
    sizes = [len(text.encode()) for text in texts]
    expected = [(*told, pairs.tolist()) for *told, pairs in whole.aligned(texts, sizes, True)]
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 0)
    tool = alignment.Aligner(*PATHS)
    for _ in range(2):
        assert [(*told, pairs.tolist()) for *told, pairs in tool.aligned(texts, sizes, True)] == expected
    assert not tool.b.known


def test_awkward_and_empty_tables(spark, plain):
    docs = llm_cases.awkward(spark)
    for name in ["chunk", "uses", "keys", "held", "n_a", "count_sum", "c0", "pos"]:
        docs = docs.selectExpr("*", f"'old' AS {name}")
    rows = alignment.align(docs, *PATHS)
    assert rows.columns == [c for c in docs.columns if c not in ("n_a", "count_sum")] + COLUMNS
    got, given = rows.collect(), docs.collect()
    expected = Counter(zip([(r["doc_id"], r["text"]) for r in given], plain([r["text"] for r in given])))
    assert Counter(((r["doc_id"], r["text"]), tuple(r[c] for c in COLUMNS)) for r in got) == expected
    assert {r["chunk"] for r in got} == {"old"}
    assert alignment.align(llm_cases.empty(spark), *PATHS).count() == 0
