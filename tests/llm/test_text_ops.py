"""Token counts, byte-level BPE, benchmark passages, substrings: against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fleetstats.llm import byte_bpe, decontaminate, substring_dedup, token_counts

TEXTS = [
    None, "", " ", "one", "  two  words\n\n", "it's we'll I'm 123 4567 x1y2", "naïve café ñandú über straße",
    "日本語 テキスト 🙂🙂", "a b c\t\r\n d", "<unk> ▁x \x00 \x1c end", "same same same", "same same same",
    "word " * 3000,
]
DOCS = "doc_id bigint, text string, ids string, id int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if t == "one" else n, t, "clash", 7) for n, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.read_ranks()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_rank_encoder(docs, reference):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(docs).collect()}
    want = set()
    for n, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        want.add((None if t == "one" else n, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_decoding_gives_the_bytes_back(docs):
    back = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for t in TEXTS)


def test_random_texts_encode_alike(reference):
    ranks = byte_bpe.read_ranks()
    codec = byte_bpe.Codec(byte_bpe.model_bytes(ranks), sorted(ranks, key=ranks.get), public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cdé'\n\tñ9.日🙂Ω_-") for _ in range(rng.randrange(60))) for _ in range(500)]
    assert list(codec.encode(texts)) == [reference.encode_ordinary(t) for t in texts]


def test_ranks_with_holes_are_refused():
    ranks = byte_bpe.read_ranks()
    ranks[b"surely not there"] = len(ranks) + 5
    with pytest.raises(ValueError):
        byte_bpe.model_bytes(ranks)


def plain_count(word: bytes, scores) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores))
    return -best[-1][1]


def test_token_counts_are_those_of_a_forward_pass_for_each_word(docs):
    import regex

    scores = token_counts.unigram_scores(byte_bpe.read_ranks())
    assert math.isclose(sum(map(math.exp, scores.values())), 1.0)
    got = sorted((r.n_pretokens, r.n_tokens) for r in token_counts.count(docs).collect())
    want = []
    for t in TEXTS:
        words = [w.encode() for w in regex.findall(public_tokenizers.PATTERN, t or "")]
        want.append((len(words), sum(plain_count(w, scores) for w in words)))
    assert got == sorted(want)


def test_shared_prefixes_do_not_change_counts():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12))) for _ in range(400)})
    scores = {w: -rng.random() * 5 for w in words[::7] + [b"a", b"b", b"c"]}
    assert token_counts.Trie(scores).terminals(words) == [plain_count(w, scores) for w in words]


def distance_in(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j - 1] + (a != b), last[j] + 1, row[-1] + 1))
    return min(row)


def edited(text: str, edits: int, rng) -> str:
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(1, len(chars) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcde")
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("xyz"))
    return "".join(chars)


def test_passages_within_the_budget_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(n, text(25)) for n in range(6)] + [(6, None), (7, ""), (None, "xx"), (8, "Tiny")]
    rows = []
    for n in range(40):
        item = items[n % 6][1]
        rows.append((n, text(20) + "  \n" + edited(item, n % 11, rng).upper() + " " + text(20)))
    rows += [(100, None), (101, ""), (102, "a tiny one"), (None, items[0][1]), (103, text(80)), (103, text(80))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("m", F.lit(1))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for d, t in rows:
        for i, item in items:
            if item and i is not None:
                budget = len(decontaminate.normal(item)) * decontaminate.EDITS_PER_MILLE // 1000
                k = distance_in(decontaminate.normal(item), decontaminate.normal(t))
                if t and k <= budget:
                    want.add((d, i, k))
    got = decontaminate.leaks(docs, table)
    assert {(r.doc_id, r.item_id, r.edits) for r in got.collect()} == want
    assert any(k for _, _, k in want)
    texts = {d: decontaminate.normal(t) for d, t in rows}
    for r in got.collect():
        passage = texts[r.doc_id][r.start:r.end]
        assert distance_in(decontaminate.normal(dict(items)[r.item_id]), passage) == r.edits
    small = decontaminate.leaks(docs, table, block_chars=200)
    assert {(r.doc_id, r.item_id, r.edits) for r in small.collect()} == want
    kept = decontaminate.clean(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _, _ in want}


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    none = docs.where("false")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(docs, items).count() == 0
    assert decontaminate.leaks(none, docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert byte_bpe.digests(none).count() == 0 and token_counts.count(none).count() == 0
    assert substring_dedup.spans(none).count() == 0


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def test_long_repeats_are_cut_and_short_ones_stay(spark):
    rng = random.Random(5)
    passage, short = words_of(rng, 51), words_of(rng, 15)
    first, second, third = words_of(rng, 80), words_of(rng, 90), words_of(rng, 70)
    rows = [
        (1, " ".join(first[:40] + passage + first[40:])), (2, " ".join(second[:33] + passage + second[33:])),
        (3, " ".join(third[:20] + short + third[20:])), (4, " ".join(short + words_of(rng, 60))),
        (5, None), (6, ""), (7, " \n "), (8, " ".join(words_of(rng, 30))), (9, " ".join(words_of(rng, 5))),
        (None, " ".join(first[:40] + passage + first[40:])), (8, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as doc", "'x' as gone", "2 as t")
    got = {(r.doc, r.first_doc): (r.start, r.end, r.n_words) for r in substring_dedup.spans(docs).collect()}
    assert set(got) == {(2, 1), ((1 << 63) - 1, 1)}
    start, end, n = got[2, 1]
    assert n >= 20 and rows[1][1][start:end].strip() in " ".join(passage)
    out = substring_dedup.dedup(docs)
    assert out.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(d, t) for d, t in rows]
    want[1] = (2, rows[1][1][:start] + rows[1][1][end:])
    want[9] = (None, "")
    assert texts == sorted(want, key=str)


def test_repeats_between_rows_of_one_id_are_found(spark):
    rng = random.Random(16)
    passage = words_of(rng, 80)
    for doc in (7, -7, None):
        rows = [(doc, " ".join(words_of(rng, 40) + passage + words_of(rng, 40))) for _ in range(3)]
        docs = spark.createDataFrame(rows + rows[:1], "doc_id bigint, text string")
        got = substring_dedup.spans(docs).collect()
        assert len(got) == 2 and len({r.t for r in got}) == 2
        assert all(r.first_doc == (doc if doc is not None else (1 << 63) - 1) and r.n_words >= 20 for r in got)


def test_insertions_do_not_shift_chunks():
    rng = random.Random(6)
    text = words_of(rng, 400)
    before = {bytes(d) for d in substring_dedup.chunk(" ".join(text))[3]}
    after = substring_dedup.chunk(" ".join(words_of(rng, 7) + text[:200] + ["new"] + text[200:]))[3]
    assert sum(bytes(d) not in before for d in after) <= 6
    borders, chars, words, _ = substring_dedup.chunk("é " + " ".join(text))
    assert words.sum() == 401 and max(words) <= substring_dedup.WINDOW and chars[-1] == len("é " + " ".join(text))


def test_text_function_takes_texts_in_parts_and_keeps_nulls(spark):
    from fleetstats.llm.common import ROWS, text_function

    rows = [(i, None if i % 5 == 0 else "x" * (i % 7)) for i in range(3 * ROWS + 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    size = text_function(lambda t: [] if t is None else [{"n": len(t)}], "array<struct<n: int>>")
    got = docs.select("doc_id", size(docs["text"]).alias("s")).collect()
    assert {r.doc_id: [x.n for x in r.s] for r in got} == {i: [] if t is None else [len(t)] for i, t in rows}
    assert docs.where("false").select(size(docs["text"])).count() == 0
