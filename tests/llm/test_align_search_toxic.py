"""Token alignment and ranked search against plain versions, toxicity by held-out cases; nulls, ties, repeats, empty tables."""

import math
import os
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from greenledger.llm import alignment, common as C, langid, mixing, ranked_search, toxicity, url_rules, winnowing
from greenledger.llm.line_index import LineIndex
from greenledger.session import shared_dir

NONE = C.NO_ID


def aligned_by_hand(docs):
    from tokenizers import Tokenizer
    import sentencepiece

    a_model = Tokenizer.from_file(alignment.A_FILE)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    letters = alignment.byte_letters()
    out = []
    for doc_id, text in docs:
        want = b" " + (text or "").encode()
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a, b, a_bytes, b_bytes = [], [], [], []
        a_ends, b_ends = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
        links = [(x, y) for x, p in zip(a, a_ends) for y, q in zip(b, b_ends) if p == q] if len(a) < 3000 else [(a[a_ends.index(e)], b[b_ends.index(e)]) for e in sorted({*a_ends} & {*b_ends})]
        groups, last = [], 0
        for end in sorted({*a_ends} & {*b_ends}):
            groups.append(",".join(str(x) for x, e in zip(a, a_ends) if last < e <= end) + "|" + ",".join(str(x) for x, e in zip(b, b_ends) if last < e <= end))
            last = end
        out.append((NONE if doc_id is None else doc_id, a, b, links, ";".join(groups)))
    counts = Counter(pair for row in out for pair in row[3])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [(i, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), g) for i, a, b, links, g in out]


def test_alignment_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Größe", "naïve", "the", "<|endoftext|>", "日本", "x1y22", "…", "🙂", "don't", "<0x41>", "<s>"]
    docs = [(i if i % 9 else 4, rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(40)]
    docs += [(None, "alpha"), (None, "alpha"), (50, None), (51, ""), (52, "a▁b"), (53, " " * 5000 + "x"), (54, "q" * 4000), (55, " lead and trail "), (56, "\x00﻿")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_blk", F.lit("x")).withColumn("pair", F.lit(1)).repartition(3)
    blocks = alignment.align(frame, block_bytes=700)
    got = [tuple(r) for r in alignment.link_scores(blocks).collect()]
    assert sorted(got) == sorted(aligned_by_hand(docs))
    for row in alignment.alignments(blocks).collect():
        assert sum(row.a_sizes) == len(row.a_ids) and sum(row.b_sizes) == len(row.b_ids) and len(row.a_sizes) == len(row.b_sizes)
    assert alignment.link_scores(alignment.align(frame.limit(0))).collect() == []


def test_packed_rows_are_small_and_blocks_are_summed_once(spark):
    docs = [(i, f"line {i % 7} of a longer text, " * 180) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    blocks = alignment.align(frame)
    size = {i: len(t) for i, t in docs}
    rows = blocks.collect()
    assert max(sum(size[i] for i in alignment.Block(r.asDict()).ids.tolist()) for r in rows) <= 1 << 18
    assert len({r["_blk"] for r in rows}) == 1  # 2 MB of text: one block, so a pair is one row
    asked, _ = alignment.pair_counts(blocks)
    assert asked.count() == asked.select("_blk", "pair").distinct().count()
    got = {r["_id"]: tuple(r)[1:] for r in alignment.link_scores(blocks).collect()}
    few = {r["_id"]: tuple(r)[1:5] for r in alignment.link_scores(alignment.align(frame.limit(7))).collect()}
    assert len(got) == 400 and all(got[i] == got[i % 7] and got[i][:4] == few[i % 7] for i in got)


def test_alignment_of_bytes_that_are_no_text(spark):
    frame = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF62' as string)").alias("text"))
    assert [tuple(r) for r in alignment.link_scores(alignment.align(frame)).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_either_encoder_gives_the_same_ids():
    from pathlib import Path

    a = alignment.ByteLevel(Path(alignment.A_FILE).read_text())
    assert a.fast is not None
    for text in ["", " a  b\t\n c", "I'll 12 don't!!", " é́ ﬁ", "x" * 3000, " <|endoftext|> ", "🙂🙂 日本"]:
        assert a.encode(text).tolist() == a.fast.encode_ordinary(text) == a.slow.encode(text, add_special_tokens=False).ids


def ranked_by_hand(docs, items, k):
    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in low).split(" ")

    rows = [(NONE if i is None else i, [t for t in terms(x) if t]) for i, x in docs]
    held = [r for r in rows if r[1]]
    n, length = len(held), sum(len(t) for _, t in held)
    df = Counter(t for _, ts in held for t in set(ts))
    asked = {}
    for i, x in items:
        if i is not None:
            asked.setdefault(i, set()).update(t for t in terms(x) if t)
    out = []
    for item, query in asked.items():
        scored = []
        for i, ts in held:
            tf, m = Counter(ts), 50 + 50 * len(ts) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in query if tf[t])
            if s > 0:
                scored.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("window,short_part", [(2048, 32), (16, 4), (16, 10**6), (64, 1)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, window, short_part):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(rng.randint(0, 400), " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for _ in range(500)]
    docs += [(i, "w1 W2, w3") for i in range(900, 1000)] + [(None, "w5 w59 w59"), (None, "w5 w59 w59"), (7, None), (8, "... "), (9, "w2 " * 5000), (10, "ÄÖ w3 é")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)] + [(3, "w1 w2"), (None, "w1"), (40, None), (41, "zzz"), (42, "w1 w2 w3 w3"), (43, "äö")]
    monkeypatch.setattr(ranked_search, "search_block", lambda a, b, c, d, f=ranked_search.search_block: f(a, b, c, d, window))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("ids", F.lit(1)).repartition(3)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(0))
    index = ranked_search.build_index(frame, block_bytes=3000)
    got = sorted(tuple(r) for r in ranked_search.search(index, queries, k=7, short_part=short_part, slice_bytes=200).collect())
    assert got == ranked_by_hand(docs, items, 7)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    empty = ranked_search.build_index(docs.limit(0))
    assert ranked_search.search(empty, items).collect() == []
    assert ranked_search.search(ranked_search.build_index(docs), items.limit(0)).collect() == []


def test_probing_lists_propose_nothing():
    """Once the floor is above their bounds, long lists are read only where the others point."""
    best = ranked_search.Best(2)
    ids = np.arange(4096)
    rare, common = (np.array([3, 5, 4000]), np.array([900, 800, 1000])), (ids, np.full(4096, 10))
    asked = []
    whole = ranked_search.Walk.window
    ranked_search.Walk.window = lambda self, high: asked.append(len(self.docs)) or whole(self, high)
    try:
        ranked_search.search_block([rare, common], ids, best, short=8)
    finally:
        ranked_search.Walk.window = whole
    assert best.scores.tolist() == [1010, 910] and best.ids.tolist() == [4000, 3]
    assert asked == [4096, 3, 3] or asked == [3, 4096, 3]


def test_disguises_are_folded():
    words = lambda text: " ".join(toxicity.fold(text))
    assert words("You 1D10T, m0r0n; p@thetic $cum!") == "you idiot moron pathetic scum"
    assert words("тhе ѕtupіd сlown, l.o.s.e.r and i-d-i-o-t") == "the stupid clown loser and idiot"
    assert words("ｃｌｏｗｎ cl​own") == "clown clown"
    assert words("Привет мир 2024 at 10:30 for $100!! the end!") == "привет мир 2024 at 10 30 for 100 the end"
    assert words("e.g. U.S. réeux") == "e g u s réeux"


def toxic_corpus(n=600):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ba", "ko", "ri", "mu", "te") for b in ("la", "nor", "sti", "ven", "dop")]
    bad, docs, labels = ["zorgle", "frump", "snarkol", "snarkot", "snarkim"], [], []
    for i in range(n):
        words, toxic = rng.choices(plain, k=rng.randint(20, 120)), int(i % 4 == 0)
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        if not toxic and i % 15 == 1:
            words.insert(5, "frump stew")
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_on_rows_it_has_not_seen(spark):
    docs, labels = toxic_corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("_toxic", F.lit(7)).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = C.remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(frame, marks.filter(~held))
    assert {"frump stew"} <= set(model.exceptions) and " zorgle " in model.weights and any(e.startswith(" snarko") or e == " snark" for e in model.weights)
    found = {r._id: r for r in toxicity.score_texts(frame, model).collect()}
    truth = dict(labels)
    unseen = [r.doc_id for r in marks.filter(held).collect()]
    assert sum(found[i].predicted == truth[i] for i in unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    extra = [(1, None), (1, ""), (None, "z0rgle sn@rkol frump"), (None, "z0rgle sn@rkol frump"), (2, "bala konor frump stew"), (3, "bala " * 300000 + "zorgle"), (4, "12 !!")]
    seen = [(r._id, r.predicted, r.hits) for r in toxicity.score_texts(spark.createDataFrame(extra, "doc_id long, text string"), model).collect()]
    assert [s[:2] for s in seen] == [(1, 0), (1, 0), (NONE, 1), (NONE, 1), (2, 0), (3, 0), (4, 0)]
    assert seen[2][2] == ["zorgle", "snark", "frump"] or seen[2][2][0] == "zorgle" and seen[4][2] == []


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "frump"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    for labels in (marks, marks.limit(0)):
        model = toxicity.train(docs, labels)
        assert [(r.score, r.predicted) for r in toxicity.score_texts(docs, model).collect()] == [(0.0, 0)] * 2
    assert toxicity.score_texts(docs.limit(0), model).collect() == []


def test_sample_is_bounded_and_merges_rows(spark):
    marks = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    marks = marks.union(marks.filter("doc_id % 7 = 0").withColumn("toxic", F.lit(1)))
    some = toxicity.labelled(marks, "doc_id", "toxic", 300)
    count = {r._toxic: r["count"] for r in some.groupBy("_toxic").count().collect()}
    assert 200 < count[0] < 400 and 200 < count[1] < 400 and some.filter("_id % 7 = 0 AND _toxic = 0").count() == 0


CLASHES = ["language", "lines", "found", "draw", "filter", "copy", "copies", "items", "text_", "_doc"]


def test_columns_of_any_name_ride_along(spark):
    """A struct an operator adds takes a free name; the given columns keep their values."""
    rows = [(1, "the old house is on the hill", "en", "a", 28), (2, "das alte haus steht am berg", "de", "b", 27), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).withColumn("url", F.concat(F.lit("http://h.example/"), F.col("doc_id").cast("string")))
    items = spark.createDataFrame([(7, "old house is")], "item_id long, text string")
    added = [
        (langid.identify(docs, langid.train(docs)), "language_"), (LineIndex.empty(spark).insert(docs).clean(docs), "lines_"), (winnowing.contamination(docs, items), "found_"),
        (mixing.mix(docs), "draw_"), (url_rules.judge(docs, url_rules.mine(docs.select("url", F.lit(True).alias("label"))), [("net/", "block")]), "filter_"),
    ]
    for frame, name in added:
        assert frame.columns == [*docs.columns, name]
        for row in frame.collect():
            assert all(row[c] == f"own {c}" for c in CLASHES)
    assert C.free_name(docs, "Found".lower()) == "found_" and C.free_name(docs.withColumn("FOUND_", F.lit(0)), "found") == "found__"


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"eine zeile von text nummer {'abcdefghij'[i % 10] * 3} und noch ein wort {i}", "de", "s", 40) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "something else entirely")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = shared_dir(spark).removeprefix("file:")
    kept = {d for d in os.listdir(folder) if d.startswith("rows-")}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {d for d in os.listdir(folder) if d.startswith("rows-")} == kept  # a stage leaves no table behind
    assert any(os.listdir(os.path.join(folder, d)) == ["mix"] for d in os.listdir(folder) if d.startswith("corpus-"))
    assert out.columns == [*docs.columns, "copy_", "copies_"]
    assert all(row[c] == f"own {c}" for row in out.collect() for c in CLASHES)
