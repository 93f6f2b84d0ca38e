"""Operators on edge cases, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import tiktoken
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from schemaledger.llm import decontaminate, exact_dedup, language_id, line_dedup, ngram_join, page_text, token_counts, token_files, url_rules
from schemaledger.llm.byte_bpe import byte_bpe, ranks_of
from schemaledger.llm.registered import QUERIES, vocabulary
from schemaledger.session import shared_folder

WHITE = "".join(map(chr, [32, *range(9, 14)]))


def plain(rows):
    return [(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()]


def written_rows(rows, name):
    path = f"{shared_folder(rows.sparkSession)}/{name}.parquet"
    rows.write.parquet(path)
    return path


def test_exact_dedup(spark, edge_rows, no_rows):
    given = plain(edge_rows)
    norm = lambda t: "".join(c for c in t or "" if c not in WHITE)
    for digest in (exact_dedup.sha256, lambda text: F.substring(F.sha2(text, 256), 1, 1)):  # the second one has many false hits
        folder = shared_folder(spark)
        path = written_rows(edge_rows, "documents")
        got = exact_dedup.exact_dedup(spark, path, folder, digest=digest).collect()
        assert len(got) == len(given)
        for doc, text in given:
            own = [g for g in given if norm(g[1]) == norm(text)]
            keep = min(own, key=lambda g: (-len(g[1] or ""), g[0] is None, g[0] or 0))[0]
            assert {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] == doc} == {(keep, len(own))}
        assert sum(r["kept"] for r in got) == len({norm(t) for _, t in given})
    edge_rows.where("doc_id = 8").write.mode("append").parquet(path)
    again = exact_dedup.exact_dedup(spark, path, folder, digest=digest).where("doc_id = 8").collect()  # goes on from the state
    assert {r["group_size"] for r in again} == {4} and len(again) == 2
    assert exact_dedup.exact_dedup(spark, written_rows(no_rows, "documents"), shared_folder(spark)).count() == 0


def test_ngram_components(spark, edge_rows, no_rows):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(edge_rows).collect()}
    assert ngram_join.ngram_jaccard_components(edge_rows).count() == edge_rows.count()
    by_id = {d: (n, c) for d, n, c in got}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[5] == (0, 5)
    assert by_id[3] == by_id[4] == (29_996, 3) and by_id[6] == (56, 6) and by_id[7] == (57, 6)
    assert by_id[8] == (1, 8) and by_id[9] == (1, 8) and by_id[10] == (1, 10) and by_id[None] == (6, None)
    assert ngram_join.ngram_jaccard_components(no_rows).count() == 0


@pytest.mark.parametrize("bound_rows", [ngram_join.BOUND_ROWS, 40])  # the second one spreads groups over many pairs of blocks
def test_ngram_components_of_a_large_group(spark, monkeypatch, bound_rows):
    monkeypatch.setattr(ngram_join, "BOUND_ROWS", bound_rows)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(700):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(own))
    got = {r[0]: r[2] for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i: i + 5]) for i in range(116)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}


def test_line_dedup(spark, edge_rows, no_rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    order = lambda d: (1 << 63) - 1 if d is None else d
    owner: dict[str, int] = {}
    for doc, text in plain(edge_rows):
        for line in (text or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), order(doc)), order(doc))
    wanted = sorted((order(d), "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or owner[key(x)] == order(d))) for d, t in plain(edge_rows))
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        got = line_dedup.dedup_lines(edge_rows, batches=batches, fanout=fanout)
        assert got.columns == [*edge_rows.columns, "n_lines", "n_dropped"]
        assert sorted((order(r["doc_id"]), r["text"]) for r in got.collect()) == wanted
    assert line_dedup.dedup_lines(no_rows).count() == 0


def test_token_files(spark, edge_rows, no_rows):
    file = vocabulary("word_bpe_49k.json")
    library = token_files.Tokenizer.from_buffer(file)
    library.encode_special_tokens = True
    got = token_files.token_files(edge_rows, file, 1).orderBy("start").collect()
    ordered = sorted(plain(edge_rows), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for row, (doc, text) in zip(got, ordered, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, at, len(ids))
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        at += len(ids)
    folder = shared_folder(spark)
    small = token_files.read_token_files(spark, folder, token_files.write_token_files(edge_rows, folder, file, 1, file_ids=10))
    assert sorted(r["start"] for r in small.collect()) == [r["start"] for r in got]
    assert token_files.token_files(no_rows, file, 1).count() == 0


def test_byte_bpe(edge_rows, no_rows):
    file = vocabulary("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(file), special_tokens={})
    got = byte_bpe(edge_rows, file, public_tokenizers.PATTERN)
    assert got.columns == [*edge_rows.columns, "n_tokens", "ids", "decoded"]
    for row in got.collect():
        assert np.frombuffer(row["ids"], "<u4").tolist() == library.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    assert byte_bpe(no_rows, file, public_tokenizers.PATTERN).count() == 0


def test_leaks(spark, edge_rows, no_rows):
    items = [(1, "what is the colour of a very clear sky at noon in june. it is blue and bright."), (2, None), (3, ""), (4, "short one"), (4, "short one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(300))
    texts = [(20, f"{filler} What is the colour of a very clear sky, at noon in June? It is blue and bright. {filler}"),
             (21, f"{filler} what is the colour of a very clear wall. nobody knows. {filler}"), (22, "a short one here")]
    docs = edge_rows.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    got = decontaminate.find_leaks(docs.withColumn("leaks", F.lit(1)), benchmark)
    found = sorted((r[0], r[1]) for r in got.select("doc_id", F.inline("leaks")).collect())
    assert found == [(20, 1), (22, 4), (22, 4)] and got.count() == docs.count()
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontaminate.find_leaks(no_rows, benchmark).count() == 0


def test_url_rules(spark):
    urls = ["http://Example.COM/en/x?q#f", "https://www.example.com/en/", "http://a.net/es/1", "http://net/fr/", "http://notnet/es/", "no scheme", None, "http://", "http://a.org:80?x/y"]
    bad = [f"http://spam{i}.org/win/{i}?id={i}" for i in range(40)]
    good = [f"http://fine{i}.org/read/{i}" for i in range(40)]
    labelled = spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in good] + [(None, True), ("http://x.org", None)], "url string, bad boolean")
    rules = url_rules.mined_rules(labelled, 0.05, 0.9).cache()
    tokens = {r["url"]: frozenset(r["t"]) for r in labelled.select("url", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    counted = [(tokens[u], b) for u, b in [(r["url"], r["bad"]) for r in labelled.collect()] if b is not None and tokens[u]]
    from itertools import combinations

    seen: dict[frozenset, list[int]] = {}
    for own, b in counted:
        for k in range(1, len(own) + 1):
            for chosen in combinations(sorted(own), k):
                s = seen.setdefault(frozenset(chosen), [0, 0])
                s[0] += 1
                s[1] += b
    wanted = {a for a, (n, b) in seen.items() if b >= 0.05 * len(counted) and b >= 0.9 * n}
    assert {frozenset(r["antecedent"]) for r in rules.collect()} == wanted and wanted
    pages = spark.createDataFrame(list(enumerate(urls + ["http://new.org/win/7?id=1", "http://new.org/read/7"])), "page_id long, url string").withColumn("host", F.lit("mine"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in
           url_rules.judge_urls(pages, rules, ("com/", "www.example.com/en/"), ("example.com/en/", "net/es/", "net/fr/")).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2] == ("a.net", "/es/1", "net/es/", "block") and got[3][2:] == ("net/fr/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow") and got[8][:2] == ("a.org:80", "")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "allow")
    one = spark.createDataFrame([(bad[0], True)] * 4 + [(u, False) for u in good], "url string, bad boolean")
    assert url_rules.mined_rules(one).count() == 0 and url_rules.mined_rules(one.union(one.limit(1))).count() > 0
    assert url_rules.mined_rules(one.limit(4)).count() == 0
    none = url_rules.mined_rules(labelled.limit(0))
    assert none.count() == 0 and url_rules.judge_urls(pages.limit(0), none, (), ()).count() == 0


def test_language_id_on_held_out_documents(spark, edge_rows, no_rows):
    found = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    model = language_id.learned(edge_rows, docs=50)
    got = language_id.identify(edge_rows, model)
    assert got.columns == [*edge_rows.columns, "lang_pred", "score"]
    rows = got.collect()
    assert all((r["lang_pred"] == "und") == (re.search(r"[^\W\d_]", r["text"] or "") is None) and 0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in language_id.identify(edge_rows, language_id.learned(no_rows)).collect()} == {"und"}
    assert language_id.identify(no_rows, model).count() == 0


def test_page_text(spark):
    menu = "home about contact imprint terms privacy help more"
    rows = [(1, "http://a.org/1", f"<p>{menu}</p><p>first own text</p>"), (2, "http://a.org/2", f"<div>{menu}</div><p>second &lt;own&gt; text</p>"), (3, None, None),
            (4, "x", ""), (5, "http://b.org/", f"<article><p>{menu}</p></article>"), (None, "http://b.org/", f"<p>{menu}</p>"), (6, "http://c.org", "<p>unclosed <b>bold"), (6, "http://c.org", "<p>unclosed <b>bold")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "blocks": F.lit(2), "n": F.lit(3)})
    got = sorted(((r["page_id"] or 0, r["text"]) for r in page_text.extract_main_text(pages).collect()))
    assert got == [(0, ""), (1, "first own text"), (2, "second <own> text"), (3, ""), (4, ""), (5, menu), (6, "unclosed bold"), (6, "unclosed bold")]
    assert page_text.extract_main_text(pages.limit(0)).count() == 0


def test_page_text_over_a_whole_host(spark):
    """Pages of one host that only their repeats can tell apart, against brute force over all pages at once."""
    rng = random.Random(11)
    notice = "this site is run by people who like long notices on pages"
    bodies = [" ".join(f"w{rng.randrange(5_000)}" for _ in range(rng.randint(9, 40))) for _ in range(400)]
    blocks = [[*([notice] if i % 50 == 0 else []), body, *([bodies[i - 1]] if i % 90 == 1 else [])] for i, body in enumerate(bodies)]
    blocks.append(["w " * 30_000 + "end"])
    rows = [(i, f"http://big.org/{i}", "<body>" + "".join(f"<p>{b}</p>" for b in own)) for i, own in enumerate(blocks)]
    rows += [(1_000, "http://big.org/a", f"<article>{notice} {bodies[7]}</article>"), (1_001, "http://other.org/", f"<p>{notice}</p>")]
    rows += [rows[5]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = sorted((r["page_id"], r["text"]) for r in page_text.extract_main_text(pages).collect())

    size, streams = page_text.RUN, [" ".join(own).split() for own in blocks] + [f"{notice} {bodies[7]}".split()]
    holders: dict[tuple, set] = {}
    for page, stream in enumerate(streams):
        for i in range(len(stream) - size + 1):
            holders.setdefault(tuple(stream[i: i + size]), set()).add(page)
    wanted = []
    for own, stream in zip(blocks, streams):
        gone = {i + k for i in range(len(stream) - size + 1) if len(holders[tuple(stream[i: i + size])]) > 1 for k in range(size)}
        kept, at = [], 0
        for words in map(str.split, own):
            kept.append(" ".join(w for i, w in enumerate(words, at) if i not in gone))
            at += len(words)
        wanted.append("\n".join(filter(None, kept)))
    assert not any(notice in text for text in wanted) and wanted[50] != "" and wanted[7] == ""
    assert got == sorted([*enumerate(wanted), (5, wanted[5]), (1_000, f"{notice} {bodies[7]}"), (1_001, notice)])


@pytest.mark.parametrize("dealt", [False, True])
def test_page_text_of_articles_by_their_host(spark, monkeypatch, dealt):
    """A notice that most pages of a host hold leaves its articles; copies, shared lines and small hosts stay, against a recount."""
    if dealt:
        monkeypatch.setattr(page_text, "_MOST_ALONE", -1)
        monkeypatch.setattr(page_text, "_TOGETHER", 16)
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(9_000)}" for _ in range(n))
    notice, line, copied = "read our letter every week and never miss a story again", words(12), [words(30), words(25)]
    rows, wanted = [], {}

    def add(host, blocks, kept):
        rows.append((len(rows), f"http://{host}/{len(rows)}", "<nav>home about</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
        wanted[len(rows) - 1] = "\n".join(kept)

    for i in range(80):
        own = [words(20), words(15)]
        add("big.org", [own[0], *([notice] if i % 3 else []), own[1]], own)
        add("half.org", [own[0], *([line] if i % 2 else []), own[1]], [own[0], *([line] if i % 2 else []), own[1]])
        if i < 30:
            add("same.org", copied, copied)
        if i < 4:
            add("small.org", [own[0], notice], [own[0], notice])
        if i < 20:
            more = words(9)
            add("near.org", [more, *copied], [more, *copied])
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = sorted((r["page_id"], r["text"]) for r in page_text.extract_main_text(pages).collect())
    assert got == sorted([*wanted.items(), (0, wanted[0])])


def test_token_rollup(spark):
    rollup = token_counts.TokenRollup(spark, shared_folder(spark))
    change = lambda *rows: spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, version string, n_tokens long")
    first = change(("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 5), ("insert", None, None, None, "v1", 3), ("insert", 3, "b", "de", "v1", None), ("delete", 99, "a", "en", "v1", 1))
    assert rollup.commit(1, first) and not rollup.commit(1, first)
    assert rollup.commit(2, change(("revise", 1, "a", "en", "v1", 12), ("revise", 2, "b", "en", "v1", 6), ("insert", 1, "a", "en", "v2", 7), ("insert", 1, "a", "en", "v2", 7)))
    wanted = {("a", "en", "v1", 1, 12), ("b", "en", "v1", 1, 6), ("a", "en", "v2", 1, 7), (None, None, "v1", 1, 3), ("b", "de", "v1", 1, 0)}
    assert {tuple(r) for r in rollup.totals().collect()} == wanted
    broken = change(("delete", 1, None, None, "v1", None), ("delete", None, None, None, "v1", None))
    broken.limit(0).write.parquet(f"{rollup.folder}/deltas/at=3")  # a batch that broke off before its commit
    assert {tuple(r) for r in rollup.totals().collect()} == wanted
    assert rollup.commit(3, broken)
    assert {tuple(r) for r in rollup.totals().collect()} == wanted - {("a", "en", "v1", 1, 12), (None, None, "v1", 1, 3)}
    assert rollup.commit(4, broken.limit(0)) and rollup.committed() == [1, 2, 3, 4]


def test_token_counts_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in QUERIES["op9_token_counts"](spark, sf).collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    wanted: dict[tuple, list[int]] = {}
    for version in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        library = tiktoken.Encoding(version, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(vocabulary(f"{version}.tiktoken")), special_tokens={})
        for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
            if r["doc_id"] not in toxic:
                total = wanted.setdefault((r["source"], r["lang"], version), [0, 0])
                total[0] += 1
                total[1] += len(library.encode_ordinary(r["text"] or ""))
    assert got == {(*key, *total) for key, total in wanted.items()}


def test_pipeline_stages_on_edge_rows(spark, edge_rows):
    path = written_rows(edge_rows.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars")), "documents")
    folder = path.rsplit("/", 1)[0]
    spark.createDataFrame([(1, "own line of twelve is a benchmark item of some words. yes.")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == docs.columns
        assert found.count() <= docs.count()
    rows = corpus_pipeline.run(spark, folder).collect()
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows) and {2, 5, 13}.isdisjoint(r["doc_id"] for r in rows)
    assert all(hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in rows)


def test_near_duplicates_keep_one_row_of_each_group(spark):
    near = " ".join(f"near{i}" for i in range(60))
    rows = [(7, near + " tail", "en", "a"), (7, near + " tail", "fr", "a"), (None, near, "en", "a"), (9, near, "en", "a"), (7, "another text of its own id", "en", "a"),
            (None, "alone without id", "en", "a"), (None, "alone without id", "en", "b"), (None, "second text without id here", "en", "a"), (3, "", "en", "a"), (3, "", "en", "a"), (4, None, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert kept == sorted([(7, near + " tail"), (7, "another text of its own id"), (None, "alone without id"), (None, "second text without id here"), (3, ""), (3, ""), (4, None)], key=repr)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_components_of_words_that_collide_as_polynomials(spark):
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(docs).collect()) == [(1, 1), (2, 2), (3, 1)]
