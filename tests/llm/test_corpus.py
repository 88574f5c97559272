"""The corpus operators against plain versions on small fixtures with nulls, ties, repeated rows and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from greenledger.llm import common as C, langid, mixing, near_dedup, pii, posting_ann, ppm, suffix_dedup, url_rules, winnowing
from greenledger.llm.cuckoo import CuckooFilter
from greenledger.llm.line_index import LineIndex

NONE = C.NO_ID


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def nid(i):
    return NONE if i is None else i


def test_cover_meets_every_shift():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


def test_packed_arrays_round_trip():
    a = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (C.unpack_sorted(C.pack_sorted(a)) == a).all() and len(C.unpack(C.pack(a[:0]))) == 0
    assert (C.unpack_bits(C.pack_bits(a % 3 == 0)) == (a % 3 == 0)).all()


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "bé", "of", "the ", "xyzzy", "löw", " q"]
    base = ["".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    docs = []
    for i in range(60):
        b, a = rng.choice(base), rng.randint(0, 40)
        docs.append((i if i % 17 else 51, b[a : a + rng.randint(20, 200)] + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80)))))
    docs += [(None, base[0]), (None, base[0]), (7, None), (8, ""), (9, "x" * 400), (10, "x" * 49), (11, "x" * 50)]
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], NONE), nid(i))
    want = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < nid(i):
                gone[p : p + 50] = [True] * 50
        want.append((nid(i), len(b), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), bytes(c for c, g in zip(b, gone) if not g)))
    for size in (1500, 1 << 20):
        got = [(r._id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame(spark, docs), block_bytes=size).collect()]
        assert sorted(got) == sorted(want)
    assert suffix_dedup.remove_repeats(frame(spark, docs).limit(0)).collect() == []


def test_cuckoo_filter_forgets_only_what_is_deleted():
    keys = np.random.default_rng(0).integers(0, 2**63, 20000, dtype=np.uint64)
    held = CuckooFilter(10)
    for i in range(0, len(keys), 3000):
        held.insert(keys[i : i + 3000])
    assert held.contains(keys).all()
    held.delete(keys[:5000])
    held = CuckooFilter.from_bytes(held.to_bytes())
    assert held.contains(keys[5000:]).all() and held.contains(keys[:5000]).mean() < 0.01


def lines_by_hand(docs):
    key = lambda line: low(line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(nid(i))
    out = []
    for i, t in docs:
        parts = (t or "").split("\n")
        kept = [p for p in parts if not (len(holders.get(key(p), ())) > 1 and nid(i) > min(holders[key(p)]))]
        out.append((nid(i), len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_index_is_exact_and_reversible(spark):
    rng = random.Random(5)
    pool = ["Hello World line %d" % i for i in range(9)] + ["short", "", "  ", "é" * 10, "é" * 9, "\tHELLO world LINE 3 \r", "x" * 10]
    docs = [(i if i % 13 else 39, "\n".join(rng.choice(pool) if rng.random() < 0.6 else str(rng.random()) for _ in range(rng.randint(0, 7)))) for i in range(60)]
    docs += [(None, "Hello World line 1\nabc"), (None, "Hello World line 1\nabc"), (900, None), (901, ""), (902, "\n\n"), (904, "Hello World line 2\n")]
    df = frame(spark, docs).withColumn("lines", F.lit(1)).drop("lines")
    see = lambda d: sorted((nid(r.doc_id), r.lines.n_lines, r.lines.n_dropped, r.lines.kept or "") for r in d.collect())
    whole = LineIndex.empty(spark).insert(df)
    assert see(whole.clean(df, refs=whole.refs)) == lines_by_hand(docs)
    odd, even = [d for d in docs if d[0] is None or d[0] % 2], [d for d in docs if d[0] is not None and d[0] % 2 == 0]
    both = LineIndex.empty(spark, shards=4).insert(frame(spark, odd)).insert(frame(spark, even))
    assert see(both.clean(df)) == lines_by_hand(docs)
    rest = both.delete(frame(spark, odd).select("doc_id"))
    assert see(rest.clean(frame(spark, even))) == lines_by_hand(even)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def groups_by_hand(docs, width, percent):
    sets, up = [shingles(t, width) for _, t in docs], list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), NONE), nid(d))
    return sorted((nid(d), len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


def near_docs():
    rng = random.Random(2)
    words, docs = ["w%d" % i for i in range(300)], []
    for _ in range(10):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60]))]
        for _ in range(rng.choice([1, 2, 12])):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append((len(docs), "  ".join(t)))
    return docs + [(None, docs[3][1]), (None, "solo text of its own words here"), (None, "solo text of its own words here"), (700, None), (701, ""), (703, "one"), (704, "ONE"), (5, docs[7][1])]


def test_near_groups_equal_brute_force(spark, monkeypatch):
    docs = near_docs()
    see = lambda w, p: sorted((r._id, r.n_shingles, r._id if r.component is None else r.component.id) for r in near_dedup.near_groups(frame(spark, docs), width=w, percent=p).collect())
    assert see(3, 85) == groups_by_hand(docs, 3, 85)
    monkeypatch.setattr(near_dedup, "CROWD", 2)  # the way of crowded families gives the same
    monkeypatch.setattr(near_dedup, "TILE", 3)
    assert see(5, 80) == groups_by_hand(docs, 5, 80)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(6)
    words = ["w%d" % i for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 12, 13, 20, 40])))) for i in range(12)] + [(90, None), (91, " ,.;"), (None, "w1")]
    docs = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        piece = (rng.choice(items)[1] or "").split()
        cut = rng.randint(0, len(piece))
        docs.append((i, " ".join(t + piece[max(0, cut - 16) : cut + 16]).upper() + ("\n" if i % 2 else "!")))
    docs += [(None, items[0][1]), (100, None), (101, ""), (102, "é w1 É")]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    want = []
    for i, t in docs:
        w, hit, held = find(t), set(), set()
        for item, it in items:
            x = find(it)
            n = min(13, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x and item is not None else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    held.add(item)
        want.append((nid(i), len(w), len(hit), sorted(held)))
    bench = frame(spark, items, "item_id long, text string")
    for size in (1 << 24, 400):
        found = winnowing.contamination(frame(spark, docs), bench, slice_bytes=size).collect()
        got = [(nid(r.doc_id), r.found.n_words, sum(x.end - x.start for x in r.found.ranges), list(r.found["items"])) for r in found]
        assert sorted(got) == sorted(want)
    assert winnowing.contamination(frame(spark, docs), bench.limit(0)).filter("size(found.items) > 0").count() == 0


def test_ppm_equals_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["the", "Of", "löw", "ab c", "x\x0by", "q"]) for _ in range(rng.randint(0, 25)))) for i in range(40)]
    docs += [(None, "hello q"), (None, "hello q"), (500, None), (501, ""), (503, "ÿ\x00")]
    learns = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    line = lambda t: bytes([0xFE] * 4) + (t or "").encode() + b"\xff"
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]
    seen, counts = defaultdict(Counter), Counter()
    for i, t in docs:
        if learns(i):
            counts.update(words(t))
            for p in range(4, len(line(t))):
                for k in range(5):
                    seen[line(t)[p - k : p]][line(t)[p]] += 1
    total, vocabulary, want = sum(counts.values()), len(counts), {}
    for i, t in docs:
        s, score = line(t), 0.0
        for p in range(4, len(s)):
            out = set()
            for k in range(4, -1, -1):
                live = {a: n for a, n in seen.get(s[p - k : p], {}).items() if a not in out}
                whole = sum(live.values()) + len(live)
                if s[p] in live:
                    score += math.log10(live[s[p]] / whole)
                    break
                if whole:
                    score += math.log10(len(live) / whole)
                out |= set(seen.get(s[p - k : p], {}))
            else:
                score -= math.log10(256 - len(out))
        c = [counts[w] for w in words(t)]
        want[nid(i)] = (len(c), sum(x > 0 for x in c), total, sum(math.log10((x + 0.1) / (total + 0.1 * (vocabulary + 1))) for x in c), score)
    for size in (300, 1 << 20):
        for r in ppm.score_texts(frame(spark, docs), train=C.remainder(F.col("doc_id"), 10) != 0, block_bytes=size).collect():
            n, known, tokens, base, score = want[r._id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens)
            assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-3
    assert ppm.score_texts(frame(spark, docs).limit(0)).collect() == []


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_by_hand(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits)))
            if (kind == "email" or kind == "ip" and all(int(x) < 256 for x in m.group().split(".")) or kind == "card" and 13 <= len(digits) <= 19 and total % 10 == 0 or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(4)
    parts = ["@", "a", "Z9", ".", "-", "12", "1.2.3.4", "4111 1111 1111 1111", "+", "(", ")", " ", "+44 20 7946 0958", "x@y.co", "é", "256", "4111-1111-1111-1111", "%", "\n", "(555) 123-4567"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(800)] + [(9001, None), (9002, ""), (None, "a@b.cc")]
    found = {r._id: r.spans for r in pii.find_personal(frame(spark, docs)).collect()}
    for i, t in docs:
        assert [(s.kind, s.start, s.end) for s in found[nid(i)] if s.base] == base_by_hand(t)


def test_personal_data_beyond_base_formats_is_added(spark):
    rng = random.Random(14)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    prose = lambda: " ".join(rng.choice(["lorum", "ipsa", "dolor", "amet", "magna", "velit"]) for _ in range(4))

    def card(good):
        n = digits(15)
        last = next(c for c in "0123456789" if pii.luhn(n + c))
        return n + (last if good else str((int(last) + 1) % 10))

    dotted = lambda n: ".".join(n[i : i + 4] for i in (0, 4, 8, 12))
    octet = lambda: str(rng.randint(1, 255))
    cue = lambda word: rng.choice([word, ""])
    base = [lambda: f"{cue('phone ')}+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{cue('mail ')}jo.{digits(2)}@mail{digits(1)}.example.com", lambda: cue("host ") + ".".join(octet() for _ in range(4)), lambda: f"{cue('card ')}{card(True)}"]
    refused = [lambda: "version 1.2.300." + digits(3), lambda: f"number {card(False)}", lambda: f"2024-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"id 2024.{rng.randint(10, 12)}{rng.randint(10, 28)}.{digits(4)}", lambda: f"version v10.200.{digits(4)}", lambda: "12:30:45:10"]
    planted = [
        ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"), ("email", lambda: f"jo.{digits(2)} at mail dot example dot com"),
        ("ip", lambda: ":".join(f"{rng.randint(4096, 65535):x}" for _ in range(8))), ("card", lambda: dotted(card(True))),
    ]
    docs, want = [], {}
    for i in range(900):
        if i % 3 == 2:
            kind, make = planted[i // 3 % len(planted)]
            said = make()
            text = f"{prose()} {said} {prose()}"
            want[i] = [(kind, text.index(said), text.index(said) + len(said))]
        else:
            text = f"{prose()} {(base, refused)[i % 3][i // 3 % len((base, refused)[i % 3])]()} {prose()}"
            want[i] = []
        docs.append((i, text))
    found = {r._id: r.spans for r in pii.find_personal(frame(spark, docs)).collect()}
    added = {i: [(s.kind, s.start, s.end) for s in spans if not s.base] for i, spans in found.items()}
    assert [i for i, _ in docs if i % 3 != 2 and added[i]] == []
    assert sum(added[i] == want[i] for i in want if want[i]) >= 0.9 * 300 and {s[0] for i in added for s in added[i]} == set(pii.KINDS)


def test_personal_data_learns_from_all_spans(spark):
    """Counted rows teach what the rows themselves do, and no span is left out: here the few that tell sit behind thousands of others."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, size=(400, pii.FEATURES)).astype(np.float64)
    y, kinds, held = (x[:, 2] > 0).astype(float), np.zeros(400, int), np.arange(400) % 5 == 4
    cuts = [np.array([0.0, 1.0])] * pii.FEATURES
    times = rng.integers(1, 4, 400)
    many = pii.fit(np.repeat(x, times, 0), np.repeat(y, times), np.repeat(kinds, times), 0.9, held=np.repeat(held, times), cuts=cuts)
    once = pii.fit(x, y, kinds, 0.9, times.astype(float), held, cuts)
    assert np.allclose(many.score(x), once.score(x)) and np.allclose(many.thresholds, once.thresholds)
    row = lambda i, label, v: (i, [(0, 0, 9, label == pii.POSITIVE, label, [float(v)] + [0.0] * (pii.FEATURES - 1))])
    spans = [row(i, pii.NEGATIVE, 1) for i in range(6000)] + [row(9000 + i, pii.POSITIVE, 2) for i in range(3000)]
    model = pii.learn(spark.createDataFrame(spans, f"_id long, spans array<{pii.SPAN}>"), 0.9)
    assert abs(model.start - np.log(0.5)) < 0.1  # the share of all 9,000, not of 5,000 and 3,000


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    model = pii.fit(x, y, np.zeros(600, int), 0.95)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.97 and pii.fit(x, y * 0, np.zeros(600, int), 0.9) is None


def test_redaction_joins_overlaps(spark):
    spans = F.expr("array(named_struct('kind', 'ip', 'start', 6, 'end', 9), named_struct('kind', 'email', 'start', 3, 'end', 8))")
    assert spark.range(1).select(pii.redact(F.lit("ab x@y.co z"), spans).alias("t")).first().t == "ab [email] z"


def test_language_is_learned_and_letters_are_needed(spark):
    rng = random.Random(8)
    words = {"aa": ["lorum", "ipsa", "dolor"], "bb": ["zwx", "kqy", "wzzk"]}
    docs = [(i, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    odd = [(900, None, "aa"), (901, "", None), (902, "12 !!", "bb"), (None, "ipsa dolor lorum", None)]
    df = frame(spark, docs + odd, "doc_id long, text string, lang string")
    model = langid.train(df, learn=F.col("doc_id") < 100)
    got = {r.doc_id: r.language for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected for i, _, lang in docs)
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902)) and got[None].lang_pred == "aa"
    assert langid.train(df.limit(0)) is None and langid.identify(df, None).filter("language.lang_pred <> 'und'").count() == 0


def test_gibberish_is_rejected_and_clean_documents_stay(spark):
    rng = random.Random(21)
    words = {lang: ["".join(rng.choice(c) + rng.choice(v) for _ in range(rng.randint(1, 3))) for _ in range(60)] for lang, c, v in (("aa", "bdg", "ae"), ("bb", "kpt", "iy"), ("cc", "lmn", "ou"), ("dd", "fsv", "äö"))}
    clean = [(i, " ".join(rng.choice(words[lang]) for _ in range(1 if i % 40 < 4 else rng.randint(5, 80))), lang) for i, lang in enumerate(list(words) * 250)]
    junk = [(5000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(10, 80))), None) for i in range(100)]
    df = frame(spark, clean + junk, "doc_id long, text string, lang string")
    got = {r.doc_id: r.language for r in langid.identify(df, langid.train(df, learn=F.col("doc_id") < 800)).collect()}
    assert sum(got[i].rejected for i, _, _ in junk) >= 95
    assert sum(got[i].rejected for i, _, _ in clean) <= 30 and sum(got[i].lang_pred == lang for i, _, lang in clean) >= 980


def test_mix_reaches_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(df, {"a": 1.0, "b": 1.0, "": 2.0}).groupBy("source").count().collect()}
    assert abs(n["a"] - 5000) < 350 and abs(n["b"] - 5000) < 350 and abs(n[None] - 10000) < 500
    assert mixing.mix(df, {"b": 1.0}).filter("source <> 'b' OR source IS NULL").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0
    again = mixing.mix(df, {"a": 1.0}).select("doc_id", "draw.copy")
    assert again.exceptAll(mixing.mix(df.repartition(7), {"a": 1.0}).select("doc_id", "draw.copy")).count() == 0


def test_mix_query_returns_whole_documents(spark, tmp_path):
    """Text (by hash), language and length come from behind the shuffle; rows given twice and rows of nulls are mixed like others."""
    import hashlib

    from greenledger.llm import queries

    docs = [(i, f"text {i} " * 50, "aa", "hot" if i % 10 else "cold", 1) for i in range(300)] + [(7, "text 7 " * 50, "aa", "hot", 1), (None, None, None, None, None)]
    frame(spark, docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op2(spark, str(tmp_path)).collect()
    known = {d[0]: (hashlib.sha256((d[1] or "").encode()).hexdigest(), d[2], d[3] or "", d[4]) for d in docs}
    assert rows and all(known[r.doc_id] == (r.text_sha256, r.lang, r.source, r.n_chars) and 1 <= r.copy <= r.copies for r in rows)
    times = Counter((r.doc_id, r.copy) for r in rows)
    assert all(n == (2 if i == 7 else 1) for (i, _), n in times.items())


def test_url_parts_rules_and_mined_rules(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'fine'}.example.org/en/{i}", bool(i % 2)) for i in range(60)]
    odd = [(100, None, None), (101, "no scheme", None), (102, "HTTP://A.Net/x?y#z", None), (103, "http://m.example.net/en/7", None), (104, "http://example.com/de/1", None), (105, "http://x.org/fr/", None), (106, "http://a.net", None)]
    df = frame(spark, rows + odd, "page_id long, url string, label boolean")
    listed = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    mined = url_rules.mine(df, min_urls=5)
    got = {r.page_id: r["filter"] for r in url_rules.judge(df, mined, listed).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") and got[i].rule is None for i in range(60))
    assert (got[100].host, got[100].path, got[101].host, got[100].verdict) == ("", "", "", "allow")
    assert (got[102].host, got[102].path, got[102].rule, got[102].verdict) == ("a.net", "/x", "net/", "block")
    assert [got[i].rule for i in (103, 104, 105, 106)] == ["example.net/en/", "example.com/de/", "org/fr/", None]
    assert url_rules.mine(df.limit(0)).count() == 0


def test_neighbours_have_recall_and_order(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] * 8), (2080, [1.0]), (None, [1.0] * 16), (3, x[3].tolist())]
    found = posting_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("_id") % 20 == 0).collect()
    by = defaultdict(list)
    for r in found:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 20))
    hit, v = 0, x.astype(float)
    for q, answers in by.items():
        score = (v * v[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -score))[:20]
        answers.sort()
        assert [a[0] for a in answers] == list(range(1, 21)) and all(abs(s - score[i]) < 1e-9 for _, i, s in answers)
        assert answers == sorted(answers, key=lambda a: (-a[2], a[1]))
        hit += len(set(best.tolist()) & {a[1] for a in answers})
    assert hit / (20 * len(by)) >= 0.9
    few = posting_ann.search(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>"), F.col("_id") % 20 == 0)
    assert few.count() == 3


def test_tied_neighbours_go_by_id(spark, monkeypatch):
    """Different 0/1 vectors with few different scores: ids must be those of brute force."""
    rng = np.random.default_rng(11)
    x = np.unique((rng.random((900, 12)) < 0.4).astype(float), axis=0)
    x = x[(x.sum(1) > 0)]
    ids = rng.permutation(len(x) * 3)[: len(x)]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(int(ids[0]) + 100000, x[0].tolist()), (int(ids[0]), x[0].tolist())]
    monkeypatch.setattr(posting_ann, "LIST_SIZE", 128)
    found = posting_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("_id") % 20 == 0, k=20, ratio=100.0).collect()
    all_ids, all_x = np.array([r[0] for r in rows[:-1]]), np.array([r[1] for r in rows[:-1]])
    want = []
    for i, v in zip(all_ids, all_x):
        if i % 20 == 0:
            score = (all_x * v).sum(1)
            order = [j for j in np.lexsort((all_ids, -score)) if all_ids[j] != i][:20]
            want += [(int(i), r, int(all_ids[j]), float(score[j])) for r, j in enumerate(order, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted(want)


def test_neighbours_have_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(posting_ann, "LIST_SIZE", 4)  # 1000 lists
    x = np.random.default_rng(6).normal(size=(4000, 32)).astype(np.float32)
    found = posting_ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("_id") % 80 == 0).collect()
    by, hit = defaultdict(set), 0
    for r in found:
        by[r.query_id].add(r.vec_id)
    for q in range(0, 4000, 80):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hit += len(by[q] & set(np.argsort(-score)[:20].tolist()))
    assert hit / (20 * 50) >= 0.9
    graph = posting_ann.Graph(x[:1000])
    row, lists = posting_ann.reach(graph, x[3000:3050], 1.3, np.ones(1000, int), 1)
    d = np.sqrt(posting_ann.distances(x[3000:3050], x[:1000]))
    near = {(i, j) for i, j in np.argwhere(d <= 1.3 * d.min(1, keepdims=True) * (1 - 1e-5)).tolist()}
    assert len(near & set(zip(row.tolist(), lists.tolist()))) >= 0.99 * len(near)


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = ["lorum", "ipsa", "dolor", "amet", "magna", "velit", "porro", "nemo"] + ["syl%s" % chr(97 + k) for k in range(20)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(40)
    docs = [(i, prose(60), "aa", "s%d" % (i % 3), 1) for i in range(40)]
    docs += [(50, docs[3][1] + " tail", "aa", "s0", 1), (51, "12 34", "aa", "s0", 1), (52, None, "aa", "s0", 1), (53, item, "aa", "s1", 1), (54, prose(30) + "\n" + docs[4][1], "aa", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in out.collect()}
        assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 51 not in kept["language"] and 52 not in kept["language"] and set(range(40)) <= set(kept["language"])
    assert "\n" not in kept["lines"][54] and 50 in kept["lines"]
    assert 50 not in kept["near_copies"] and 3 in kept["near_copies"]
    assert 53 not in kept["decontaminate"] and len(kept["decontaminate"]) >= 40
    assert set(kept["mix"]) <= set(kept["decontaminate"])
