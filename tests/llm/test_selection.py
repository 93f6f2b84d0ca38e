"""Importance resampling, license scans and the source audit against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaledger.llm import byte_words, importance, license_scan, ranks, source_audit

LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def test_words_of_bytes_equal_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aZ09 _-\n\t\0\x7fé日🙂[`{@/:") for _ in range(rng.randrange(60)))
        for table, pattern in ((byte_words.LETTERS, LETTERS), (byte_words.LETTERS_AND_DIGITS, WORDS)):
            got = [w.decode() for part in byte_words.word_blocks(text.encode(), table, block=rng.choice((1, 7, 1000))) for w in part]
            assert got == re.findall(pattern, lower(text))
    assert list(byte_words.word_blocks(None, byte_words.LETTERS)) == list(byte_words.word_blocks(b" \n", byte_words.LETTERS)) == []


def grams(text, longest):
    words = re.findall(WORDS, lower(text))
    return words, [" ".join(words[i: i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest", (1, 2, 4))
def test_run_hashes_across_blocks(monkeypatch, longest):
    monkeypatch.setattr(byte_words.word_blocks, "__defaults__", (9,))
    for text in ("", "one", "a b", " ".join(f"w{i} été" for i in range(40)), "x" * 50 + " y z"):
        found = list(importance.run_hashes(text.encode(), longest))
        words, wanted = grams(text, longest)
        assert sum(n for n, _ in found) == len(words)
        assert sorted(h for _, hashes in found for h in hashes) == sorted(zlib.crc32(g.encode()) for g in wanted)


def resampled(rows, target, percent, least, buckets):
    s, t = (Counter(zlib.crc32(g.encode()) % buckets for text in texts for g in grams(text, 2)[1]) for texts in ([t for _, t in rows], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        words, features = grams(text, 2)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(words) >= least, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1]), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = order[: len(order) * percent // 100]
    left = Counter(drawn)
    place = defaultdict(list)
    for i, r in enumerate(drawn, 1):
        place[r].append(i)
    return sorted((repr((r[0], *r[2:], place[r].pop(0) if left[r] and place[r] else None)) for r in out))


def test_importance_resampling(spark, edge_rows, no_rows):
    rows = [(r["doc_id"], r["text"]) for r in edge_rows.collect()]
    texts = ["near1 near2 near3 near4 word1", None, "", "Tie tie été"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    for percent, least in ((25, 20), (100, 0), (60, 1)):
        got = importance.importance_resample(edge_rows, target, percent, least, buckets=97)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(repr((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in got.collect()) == resampled(rows, texts, percent, least, 97)
    assert importance.importance_resample(no_rows, target).count() == 0
    empty = importance.importance_resample(edge_rows, target.limit(0), 25, 20, buckets=97)
    assert sorted(repr((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in empty.collect()) == resampled(rows, [], 25, 20, 97)


def test_ranks_of_one_large_tie(spark):
    rows = spark.range(3000).select((F.col("id") % 3 * F.lit(0) + F.when(F.col("id") < 2500, 5).otherwise(F.col("id"))).alias("score"))
    got = ranks.ranked(rows, [F.col("score").desc()], "rank").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))
    assert [r["score"] for r in sorted(got, key=lambda r: r["rank"])] == sorted((r["score"] for r in got), reverse=True)


PHRASES = (("mit license", "mit"), ("a b a", "aba"))
NOTICES = (("one two three four five six seven eight nine ten", "count"), ("the the of the licence text", "the"), ("...", "none"))


def scanned(text, threshold):
    words, out = re.findall(WORDS, lower(text)), []
    for phrase, label in PHRASES:
        own = phrase.split()
        out += [(label, True, i, len(own), 1.0) for i in range(len(words) - len(own) + 1) if words[i: i + len(own)] == own]
    for notice, label in NOTICES:
        own = re.findall(WORDS, notice)
        if not own or not words:
            continue
        needed = math.ceil(threshold * len(set(own)) - 1e-9)
        share = {i: len(set(words[i: i + len(own)]) & set(own)) for i in range(max(1, len(words) - len(own) + 1))}
        met = [i for i in share if share[i] >= max(1, needed)]
        for i in met:
            if i - 1 not in met:
                last = next(j for j in range(i, len(words) + 1) if j + 1 not in met)
                out.append((label, False, i, min(last + len(own), len(words)) - i, max(share[j] for j in range(i, last + 1)) / len(set(own))))
    return len(words), sorted(out, key=lambda m: (m[2], m[0], m[3]))


def test_license_scan(spark, edge_rows, no_rows):
    rng = random.Random(4)
    words = "one two three four five six seven eight nine ten the of licence text mit license a b x y z".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 50))) for _ in range(300)]
    texts += ["MIT-License", "mit\nlicense", "submit license", "a b a b a", "One two, three four five six seven eight nine ten!" * 3, None, "", "ten nine eight seven six five four three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"label": F.lit(1), "matches": F.lit(2), "n_words": F.lit(3)})
    for threshold in (0.8, 1.0, 0.3):
        got = license_scan.scan_licenses(docs, PHRASES, NOTICES, threshold)
        assert got.columns == ["doc_id", "text", "label", "n_words", "matches"]
        for r in got.collect():
            n_words, wanted = scanned(texts[r["doc_id"]], threshold)
            assert (r["n_words"], [tuple(m) for m in r["matches"]]) == (n_words, wanted) and r["text"] == texts[r["doc_id"]]
    assert license_scan.scan_licenses(edge_rows, PHRASES, NOTICES).count() == edge_rows.count()
    assert license_scan.scan_licenses(no_rows, PHRASES, NOTICES).count() == 0
    assert all(r["matches"] == [] for r in license_scan.scan_licenses(docs, (), ()).collect())
    with pytest.raises(ValueError):
        license_scan.scan_licenses(docs, (("x" * (17 << 20), "long"),), ())


def test_level_products_equal_the_dense_product(monkeypatch):
    rng = np.random.default_rng(2)
    for block in (1, 50, 1 << 20):
        monkeypatch.setattr(source_audit, "_BLOCK_PAIRS", block)
        dense = rng.integers(0, 4, (30, 5)) * rng.integers(0, 2, (30, 5))
        row, group = np.nonzero(dense)
        total = Counter()
        for left, right, cells in source_audit.level_products(row, group, dense[row, group]):
            for g, h, a, b, n in zip(left, right, *cells):
                total[g, h, a, b] += n
        one_hot = np.stack([dense[:, g] == level for g in range(5) for level in range(1, 4)]).astype(int)
        product = one_hot @ one_hot.T
        wanted = {(i // 3, j // 3, i % 3 + 1, j % 3 + 1): product[i, j] for i in range(15) for j in range(15) if i // 3 < j // 3 and product[i, j]}
        assert dict(total) == wanted
    assert list(source_audit.level_products(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))) == []


def audited(rows, least, top):
    docs = [(lang or "", source or "", Counter(re.findall(LETTERS, lower(text)))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        total, df = sum((d[2] for d in own), Counter()), Counter(t for d in own for t in d[2])
        kept = [t for t in total if df[t] >= least]
        groups = {s: sum((d[2] for d in own if d[1] == s), Counter()) for s in {d[1] for d in own}}

        def shares(counts):
            size = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (size + len(kept)) for t in kept}

        q, p = shares(total), {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in groups if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def test_source_audit(spark, edge_rows, no_rows):
    rng = random.Random(5)
    words = ["the", "a", "Zug", "été", "日本", "b1c", "x-y", "🙂", *[f"w{c}" for c in "abcdefgh"]]
    rows = [(" ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(30))), rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "s3", "", None])) for _ in range(200)]
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("only here", "it", "s1"), ("! 1", "it", "s1")] + [("copy of one text " * 50, "en", "hot")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({n: F.lit("mine") for n in ("item", "n", "value", "rank", "size", "kept")})
    shown = ("lang", "source", "part", "item", "value", "rank")
    for least, top in ((3, 200), (1, 4)):
        got = source_audit.audit_sources(docs, least, top)
        assert got.columns == list(shown)
        assert sorted(tuple(r[c] for c in shown) for r in got.collect()) == audited(rows, least, top)
    edge = [(r["text"], r["lang"], r["source"]) for r in edge_rows.collect()]
    assert sorted(tuple(r[c] for c in shown) for r in source_audit.audit_sources(edge_rows, 1).collect()) == audited(edge, 1, 200)
    assert source_audit.audit_sources(no_rows).count() == 0


def test_shares_and_penalties_are_exact_for_any_count(spark):
    rows = [(0, 0, 0), (0, 10**9, 5), (10**13, 3 * 10**13, 10**8), (8_999_999_999, 10**10, 1), (9_000_000_000, 10**10, 1), (2**62, 2**62, 7)]
    got = spark.createDataFrame(rows, "n long, size long, kept long").select("*", source_audit.share(F.col("n"), F.col("size"), F.col("kept")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (n + 1) // max(1, size + kept) for n, size, kept in rows]
    pairs = [(10**9 + 1, 1), (1, 10**9 + 1), (5, 5), (123456789, 987654)]
    got = spark.createDataFrame(pairs, "p long, q long").select(source_audit.penalty(F.col("p"), F.col("q")).alias("f")).collect()
    assert [r["f"] for r in got] == [(p - q) ** 2 // q for p, q in pairs]
