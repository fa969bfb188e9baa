"""The text operators against exact round trips, brute force and held-out labels."""

from __future__ import annotations

import base64
import random
from collections import Counter
from datetime import datetime, timezone

import numpy as np
import pytest

from aforetime.llm import abuse, bpe, leaks, queries
from aforetime.llm.text import plain, words

DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, source string, ids string"


@pytest.fixture(scope="module")
def ranks():
    return bpe.encoder(queries.tokenizer_path("byte_bpe_50k.tiktoken")).ranks


@pytest.fixture(scope="module")
def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


ODD = [
    None, "", " ", "\n\n ", "a\x1cb \x1d c", "x\t \n y", "  a  b\n\n", "\x85 q", "<|endoftext|>", "日本語 テスト", "'s don't I'LL we've",
    "é́", "x​ y﻿", "  x", "a" * 3000, "ab" * 2000, "!?" * 500, "\U0001f600\U0001f600", "12345678901234567890 " * 50,
]


def test_ids_equal_the_library_on_odd_and_random_texts(ranks, reference):
    draw = random.Random(1)
    texts = [*ODD, *("".join(draw.choice("ab \n\t'sé日1.  -") for _ in range(draw.randint(1, 200))) for _ in range(300))]
    encoder = bpe.Encoder(ranks)
    for text in texts:
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == reference(text or "")


def test_ids_of_a_table_round_trip(spark, ranks):
    rows = [(i, t, "s", "clash") for i, t in enumerate(ODD)] + [(1, "same id", "s", None)]
    found = bpe.encode_corpus(
        spark.createDataFrame(rows, DOCUMENTS), queries.tokenizer_path("byte_bpe_50k.tiktoken")
    ).collect()
    token = {rank: piece for piece, rank in ranks.items()}
    got = sorted((r["doc_id"], b"".join(token[i] for i in r["ids"]).decode()) for r in found)
    assert got == sorted((i, t or "") for i, t, _, _ in rows)


def test_a_cleared_cache_changes_nothing(ranks, monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    encoder = bpe.Encoder(ranks)
    text = "one two three four five six one two three " * 3
    assert np.frombuffer(encoder.encode(text), np.int32).tolist() == reference(text)


def test_words_see_through_wrapping():
    wanted = ["the", "red", "fox", "said", "hi"]
    for text in (
        "The *red* fox\\nsaid \\\"hi\\\"", "<p>the <b>red</b> fox said&nbsp;hi</p>", "# The RED\n# fox, said: 'hi'",
        "\\u0074he red​ fox said hi"
    ):
        assert words(plain(text)) == wanted
    assert plain("a\\ud83d\\ude00b \ud800") == "a\U0001f600b �"


def test_alignment_score_matches_full_recursion():
    draw = random.Random(2)
    for _ in range(40):
        a, b = ([draw.randint(1, 5) for _ in range(draw.randint(1, 14))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = leaks.MATCH if a[i - 1] == b[j - 1] else leaks.MISMATCH
                table[i, j] = max(
                    0, table[i - 1, j - 1] + same, table[i - 1, j] + leaks.GAP, table[i, j - 1] + leaks.GAP
                )
        matched, score = leaks.align(np.array(a), np.array(b))
        assert score == table.max() and all(x < y for x, y in zip(matched, matched[1:], strict=False))


@pytest.mark.parametrize("cells", [10**6, 1])
def test_long_gaps_and_few_kept_rows(monkeypatch, cells):
    monkeypatch.setattr(leaks, "CELLS_AT_ONCE", cells)
    draw = random.Random(4)
    for _ in range(30):
        item = [draw.randint(1, 30) for _ in range(draw.randint(10, 25))]
        cut = draw.randint(3, len(item) - 3)
        document = [*item[:cut], *[0] * draw.randint(0, 60), *item[cut:]]
        table = np.zeros((len(document) + 1, len(item) + 1), dtype=int)
        for i in range(1, len(document) + 1):
            for j in range(1, len(item) + 1):
                same = leaks.MATCH if document[i - 1] == item[j - 1] else leaks.MISMATCH
                table[i, j] = max(
                    0, table[i - 1, j - 1] + same, table[i - 1, j] + leaks.GAP, table[i, j - 1] + leaks.GAP,
                    table[:i, j].max() - leaks.LONG_GAP
                )
        matched, score = leaks.align(np.array(document), np.array(item))
        assert score == table.max() and all(x < y for x, y in zip(matched, matched[1:], strict=False))
        bridged = 2 * cut > leaks.LONG_GAP < 2 * (len(item) - cut)
        assert not bridged or len(matched) == len(item)


def test_scattered_words_are_no_leak_and_nine_lines_of_prose_may_be(spark, monkeypatch):
    words_of = [f"word{i}" for i in range(90)]
    prose = "\n".join(" ".join(words_of[k : k + 10]) for k in range(0, 90, 10))
    other = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam"
    scattered = " ".join(f"word{i} lorem ipsum dolor" for i in range(25))
    texts = [scattered, " ".join(words_of[:4]) + " " + scattered, f"sit {' '.join(words_of[20:52])} amet", prose, prose * 3]
    df = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)], DOCUMENTS)
    items = spark.createDataFrame([(0, prose), (1, other)], "item_id long, text string")

    def run(table):
        return sorted(tuple(r) for r in leaks.leak_scores(df, table).where("item_id = 0").collect())

    both = leaks.leaks(leaks.leak_scores(df, items)).select("doc_id", "item_id").collect()
    assert sorted(tuple(r) for r in both) == [(2, 0), (3, 0), (4, 0)]
    scores = run(items)
    assert run(items.where("item_id = 0")) == scores
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 1)
    assert run(items) == scores


def test_passage_repeated_without_end(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, (passage + "\n") * 20_000, "s", "x")], DOCUMENTS)
    items = spark.createDataFrame([(0, passage)], "item_id long, text string")
    found = leaks.leaks(leaks.leak_scores(df, items)).collect()
    assert [(r["doc_id"], r["span"]) for r in found] == [(1, 40)]


def test_long_attributes_are_no_words():
    tag = '<a href="' + "x/" * 400 + '" class="' + "wide " * 100 + '">'
    assert words(plain(f"red {tag}fox</a>")) == ["red", "fox"]


def test_leaks_of_edited_wrapped_and_split_passages(spark):
    draw = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(60))) for i in range(6)]
    code = "\n".join(f"def name{i}(arg{i}, other{i}):\n    return arg{i} + {i}" for i in range(6))
    items.append((6, code))
    noise = lambda n: " ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    whole = items[0][1].split()
    edited = [w if k % 9 else "changed" for k, w in enumerate(whole[5:40])]
    documents = [
        (1, f"{noise(50)} {items[0][1].upper()} {noise(20)}"),
        (2, noise(30) + " " + ", ".join(edited) + noise(30)),
        (
            3,
            '{"source": ["' + "\\n".join(whole[10:25]) + '"], "cell_type": "code"}, {"source": ["' + " ".join(whole[25:45]) + '"]}'
        ),
        (4, noise(30) + " " + " ".join(whole[:8]) + " ..."),
        (5, "\n".join("# " + line for line in code.split("\n")[1:10])),
        (6, "\n".join(code.split("\n")[:3])),
        (7, None), (8, ""), (9, noise(5000) + items[1][1] + noise(5000)), (9, items[1][1]),
    ]
    rows = [(i, t, "s", "x") for i, t in documents] + [(100 + i, noise(40), "s", "x") for i in range(40)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    item_table = spark.createDataFrame([*items, (7, None), (8, "too short")], "item_id long, text string")
    found = leaks.leaks(leaks.leak_scores(df, item_table)).select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in found} == {(1, 0), (2, 0), (3, 0), (5, 6), (9, 1)}
    assert leaks.leak_scores(df.where("false"), item_table).count() == 0
    assert leaks.leak_scores(df, item_table.where("false")).count() == 0


def test_leaks_of_a_popular_part(spark):
    words_of = [f"word{i}" for i in range(120)]
    copy, whole = " ".join(words_of[:40]), " ".join(words_of)
    texts = [f"word{i % 7} {copy} tail" for i in range(20)] + [copy] * 20 + [whole] + ["other text"] * 20
    df = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)], DOCUMENTS)
    items = spark.createDataFrame([(0, whole), (1, " ".join(words_of[80:]))], "item_id long, text string")
    found = leaks.leaks(leaks.leak_scores(df, items)).select("doc_id", "item_id").collect()
    assert sorted(tuple(r) for r in found) == [*((i, 0) for i in range(41)), (40, 1)]


def test_pieces_of_a_long_stretch_lose_no_alignment():
    draw = random.Random(5)
    for _ in range(20):
        item = np.arange(1, 7)
        document = np.array([draw.randint(1, 9) for _ in range(300)])
        pieces = leaks._pieces(0, len(document), len(item))
        assert len(pieces) > 1
        best = max(leaks.align(document[a:b], item)[1] for a, b in pieces)
        assert best == leaks.align(document, item)[1]


def test_item_blocks_give_the_same_pairs(spark, monkeypatch):
    path = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    whole = {
        tuple(r) for r in leaks.leaks(
            leaks.leak_scores(path("documents"), path("eval_item"))
        ).select("doc_id", "item_id").collect()
    }
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 100)
    parts = {
        tuple(r) for r in leaks.leaks(
            leaks.leak_scores(path("documents"), path("eval_item"))
        ).select("doc_id", "item_id").collect()
    }
    assert whole == parts


def test_spelling_is_normalised():
    for text in ("You STUPIIIID fооl", "you stup1d f00l", "yóu s-t-u-p-i-d fo​ol"):
        assert abuse.tokens(plain(text)) == ["you", "stupid", "fol"]
    assert abuse.tokens("you f*ck") == ["you", "*fck"]


def toy_corpus(seed: int, n: int):
    draw = random.Random(seed)
    nasty = [
        "you are a {} idiot and everybody hates you", "crawl back to your hole you {} worm",
        "i will {} find you and break your legs"
    ]
    fine = [
        "the {} filter drops the outliers", "this notebook keeps the {} readings", "we plot the {} series again",
        "kill the {} worker process"
    ]
    rows = []
    for i in range(n):
        bad = draw.random() < 0.2
        lines = [
            draw.choice(fine).format(draw.choice(["old", "new", "rare", "daily"])) for _ in range(draw.randint(3, 12))
        ]
        if bad:
            lines.insert(
                draw.randint(0, len(lines)),
                draw.choice(nasty).format(draw.choice(["sad", "rotten", "filthy", "dull"]))
            )
        rows.append((i, "\n".join(lines), "s", "x", bad))
    return rows


def test_model_holds_out_with_mistaken_labels(spark):
    train, test = toy_corpus(1, 400), toy_corpus(2, 300)
    draw = random.Random(4)
    labels = [
        (
            i, "none" if (draw.random() < 0.1) ^ (not bad) and not (bad and draw.random() < 0.8) else "abusive",
            datetime.now(timezone.utc)
        ) for i,
        _, _, _, bad in train
    ]
    label_table = spark.createDataFrame(
        [*labels, (None, "none", None), (5, None, None)], "doc_id long, label string, labelled_at timestamp"
    )
    documents = spark.createDataFrame([r[:4] for r in train], DOCUMENTS)
    model = abuse.fit_reviewed(documents, label_table)
    held_out = spark.createDataFrame(
        [*(r[:4] for r in test), (900, None, "s", "x"), (901, "", "s", "x"), (902, "...", None, "x")], DOCUMENTS
    )
    scores = {r["doc_id"]: r["score"] for r in abuse.score(held_out, model, keep=("source",)).collect()}
    right = sum((scores[i] >= abuse.THRESHOLD) == bad for i, _, _, _, bad in test)
    assert right / len(test) > 0.95
    assert scores[900] == scores[901] == scores[902] == 0


def test_no_confirmed_label_scores_nothing(spark):
    documents = spark.createDataFrame([r[:4] for r in toy_corpus(1, 10)], DOCUMENTS)
    model = abuse.fit_reviewed(documents, spark.createDataFrame([], "doc_id long, label string"))
    assert {r["score"] for r in abuse.score(documents, model).collect()} == {0.0}


def test_long_unbroken_text_is_read_to_its_end(spark):
    train = toy_corpus(1, 400)
    labels = spark.createDataFrame(
        [(i, "abusive" if bad else "none") for i, _, _, _, bad in train], "doc_id long, label string"
    )
    model = abuse.fit_reviewed(spark.createDataFrame([r[:4] for r in train], DOCUMENTS), labels)
    text = "the old filter drops the outliers and then " * 2000 + "you are a rotten idiot and everybody hates you"
    found = abuse.score(spark.createDataFrame([(1, text, "s", "x")], DOCUMENTS), model).collect()
    assert found[0]["score"] >= abuse.THRESHOLD


def test_a_single_word_is_scored(spark):
    rows = toy_corpus(1, 400)
    # in every other toxic document the word is all there is
    plainly = "the old filter drops the outliers\n"
    train = [
        (i, (plainly if bad and i % 2 else text + "\n") + ("blackguard!" if bad else "worker"), s, x) for i, text, s, x, bad in rows
    ]
    labels = spark.createDataFrame([(r[0], "abusive" if r[4] else "none") for r in rows], "doc_id long, label string")
    model = abuse.fit_reviewed(spark.createDataFrame(train, DOCUMENTS), labels)
    single = ["blackguard!", "x = 1\n'b l a c k g u a r d'\n", "'bl4ckgu4rd'", "worker", "x"]
    found = abuse.score(spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(single)], DOCUMENTS), model).collect()
    assert [r["score"] >= abuse.THRESHOLD for r in sorted(found)] == [True, True, True, False, False]
    assert abuse.segments_of("馬鹿") == ["馬鹿"]


def test_all_segments_of_a_reviewed_document_are_fitted(spark, monkeypatch):
    lines = [f"aa{chr(97 + a)}{chr(97 + b)}{chr(97 + c)} words" for a in range(20) for b in range(20) for c in range(20)]
    text = "\n".join([*lines, "you are a rotten idiot"])
    seen = {}
    monkeypatch.setattr(abuse, "fit", lambda positive, unlabelled: seen.update(positive=positive))
    documents = spark.createDataFrame([(1, text, "s", "x"), (2, "some fine words", "s", "x")], DOCUMENTS)
    labels = spark.createDataFrame([(1, "abusive"), (2, "none")], "doc_id long, label string")
    abuse.fit_reviewed(documents, labels)
    assert len(abuse.segments_of(text)) > 5_000
    assert seen["positive"] == [abuse.segments_of(text)]


def test_a_huge_document_does_not_use_up_the_sample(spark, monkeypatch):
    rows = toy_corpus(1, 100)
    labels = spark.createDataFrame([(r[0], "abusive" if r[4] else "none") for r in rows], "doc_id long, label string")
    huge = {r[0] for r in rows[:40]}
    documents = spark.createDataFrame(
        [(r[0], r[1] + "".join(f"\nfiller {chr(97 + k % 26) * 3}q{chr(97 + k // 26)}" for k in range(600)) if r[0] in huge else r[1], "s", "x") for r in rows], DOCUMENTS
    )
    seen = {}
    monkeypatch.setattr(abuse, "DOCUMENT_AT_MOST", 2_000)
    monkeypatch.setattr(abuse, "fit", lambda positive, unlabelled: seen.update(n=len(positive) + len(unlabelled)))
    abuse.fit_reviewed(documents, labels)
    assert seen["n"] == len(rows) - len(huge)


def test_sample_is_bounded_and_holds_unreviewed_documents(spark, monkeypatch):
    documents = spark.createDataFrame([*(r[:4] for r in toy_corpus(1, 400)), (None, "x y", "s", "x")], DOCUMENTS)
    labels = spark.createDataFrame(
        [*((i, "abusive" if i % 4 == 0 else "none") for i in range(200)), (4, "none"), (None, "hateful")], "doc_id long, label string"
    )
    whole = {r["doc_id"]: r["kind"] for r in abuse.sample(documents, labels).collect()}
    assert whole == {i: "corpus" if i >= 200 else "reviewed" if i % 4 else "confirmed" for i in range(400)}
    monkeypatch.setattr(abuse, "SAMPLE_AT_MOST", 30)
    few = Counter(r["kind"] for r in abuse.sample(documents, labels).collect())
    assert set(few) == {"confirmed", "reviewed", "corpus"} and max(few.values()) <= 30 and min(few.values()) > 10
    seen = {}
    monkeypatch.setattr(abuse, "fit", lambda positive, unlabelled: seen.update(n=len(positive) + len(unlabelled)))
    monkeypatch.setattr(abuse, "CHARACTERS_AT_MOST", 2_000)
    abuse.fit_reviewed(documents, labels)
    assert 0 < seen["n"] < sum(few.values())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() >= 0
