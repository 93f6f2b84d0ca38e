"""The parts that run inside tasks, against plain versions."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from schemaledger.llm import byte_bpe, decontaminate, language_id, ngram_join, page_text, token_files, words

TEXTS = [
    "", " ", "one", "One two\tthree  four", "a b c d e f g " * 3, "don't  stop\n\n  now 123 é x y", "x" * 3000, "ab" * 2000 + " " * 500,
    "日本語 текст 🙂🙂 \x1c\x85 　end  ", "A" * 40 + " " + "a" * 40, "\n\n\n", "  leading and trailing  ", "1234567 3.14 !!! ??? ...",
]


def plain_shingles(text, size=5):
    own = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({i: " " for i in range(9, 14)}).split(" ") if w]
    return {tuple(own[i: i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def test_shingle_sets_count_like_tuples():
    blocks = list(words.in_blocks(TEXTS))
    counts = np.concatenate([words.shingle_sets(b, 5)[1] for b in blocks])
    assert counts.tolist() == [len(plain_shingles(t)) for t in TEXTS]
    assert words.shingle_sets([b"", b""], 5)[1].tolist() == [0, 0]


def test_forest_of_links_equals_all_pairs():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    texts = []
    for k in range(40):
        own = list(base) if k % 2 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    texts += ["", " \t", "same", "same"]
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    nodes = np.arange(len(texts))
    links = ngram_join.forest_of_links(nodes, nodes, texts, 5, 80)
    assert {(a, b) for a, b in links} == {(i, find(i)) for i in range(len(texts)) if find(i) != i}


def test_upper_bound_drops_no_link():
    texts = ["a b c d e f g h i j", "a b c d e f g h i j k", "x y z u v w q r s t"]
    own = [words.canonical(t) for t in texts]
    hashes, n = words.shingle_sets(own, 5)
    counts = np.zeros((3, ngram_join.BOUND_CELLS), np.int64)
    np.add.at(counts, (np.repeat(np.arange(3), n), (hashes % np.uint64(ngram_join.BOUND_CELLS)).astype(int)), 1)
    assert ngram_join.with_partner(n, np.arange(3), counts, 80).tolist() == [True, True, False]


@pytest.fixture(scope="module")
def coder():
    file = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = byte_bpe.ranks_of(file)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.coder(file, public_tokenizers.PATTERN, True), own


def test_bpe_equals_the_library(coder):
    mine, library = coder
    rng = random.Random(5)
    made = ["".join(rng.choice("aeiounrstlhd' ,.\n\tAÉéßñ1 23🙂日  \x1c") for _ in range(rng.randint(1, 400))) for _ in range(400)]
    runs = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 200))) for pool in ("ab", "aaab", "the", "éè", "0123", "-=_*") for _ in range(60)]
    for text in TEXTS + made + runs:
        ids = mine.ids(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert mine.decoded(ids) == text.encode()
    assert mine.ids(None) == b""


def test_bpe_compatibility_is_what_merging_gives(coder):
    mine, library = coder
    rng = random.Random(7)
    tokens = rng.sample(mine.bpe.bytes_of, 400)
    for a, b in zip(tokens[::2], tokens[1::2]):
        merged = library._core_bpe.encode_single_piece(a + b)
        assert mine.bpe.encode(a + b) == merged


def test_token_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, token_files.BLOCK, token_files.BLOCK + 1, 5000):
        for high in (1, 2, 300, 49408, 1 << 32):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            if n > 10:
                ids[rng.integers(0, n, 5)] = (1 << 32) - 1
            data, starts = token_files.packed(ids)
            assert (token_files.unpacked(np.frombuffer(data, np.uint8), starts, n) == ids).all()
    few = token_files.file_bytes([5, None, 7], np.array([2, 0, 1]), np.array([9, 8, 7], np.uint32))
    docs, counts, ids = token_files.read_file(few)
    assert (docs, counts.tolist(), ids.tolist()) == ([5, None, 7], [2, 0, 1], [9, 8, 7])


def test_word_coder_equals_the_library_on_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    mine = token_files.WordCoder(open(path, "rb").read())
    got = mine.ids([*TEXTS, None, "<|endoftext|> Σίσυφος é Å"])
    for text, ids in zip([*TEXTS, "", "<|endoftext|> Σίσυφος é Å"], got):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_wand_finds_what_brute_force_finds():
    rng = random.Random(11)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40)))) for i in range(150)]
    sets = [set(decontaminate.term_hashes(decontaminate.plain_words(t)).tolist()) for _, t in items]
    df = {t: sum(t in s for s in sets) for s in sets for t in s}
    for theta in (0.1, 0.3, 0.6):
        index = decontaminate.ItemIndex(items, df, len(items), 20.0, theta)
        for _ in range(60):
            terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 120)))
            score: dict[int, float] = {}
            for t in terms:
                for item, impact in zip(index.items[t], index.impacts[t]):
                    score[item] = score.get(item, 0.0) + impact
            assert {i for i, _ in index.search(terms)} == {i for i, s in score.items() if s >= theta - 1e-9}


def test_gru_gradients_equal_differences():
    model = language_id.Model.fresh(["a", "b"], 3)
    for name in ("tables", "u", "c"):
        setattr(model, name, [w.astype(np.float64) for w in getattr(model, name)])
    model.out, model.bias = model.out.astype(np.float64), model.bias.astype(np.float64)
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 105, (6, 4)), np.array([0, 1, 1, 0])
    _, grads = language_id.gradients(model, x, y)
    for w, g in zip(model.weights(), grads):
        at = tuple(np.unravel_index(np.abs(g).argmax(), g.shape))
        held = w[at]
        w[at] = held + 1e-3
        up = language_id.gradients(model, x, y)[0]
        w[at] = held - 1e-3
        down = language_id.gradients(model, x, y)[0]
        w[at] = held
        assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.05, abs=1e-4)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>menu</a></nav><!-- ad --><div class="ad">buy</div>
<div id="cookie-notice">ok?</div><aside>side</aside><article><h1>Head &amp; more</h1><p><b>First  line<br>next<p>Second&nbsp;one</p><form>mail <input></form>
<section class="comments"><p>reader</p></section></article><footer>end</footer></body></html>"""


def stated_text(page):
    blocks = page_text.page_blocks(page)
    settled = page_text.settled_zone(blocks)
    return None if settled is None else "\n".join(text for zone, text in blocks if zone == settled and text)


def test_page_blocks_and_main_text():
    assert [stated_text(p) for p in (PAGE, None, "")] == ["Head & more\nFirst line next\nSecond one", "", ""]


@pytest.mark.parametrize("page", [
    '<article class="post has-comments"><p>own text</p><div class="post-comments">x</div><ul class="replies"><li>y</ul></article>',
    '<main class="no-sidebar"><p>own text</p><div class="banner">x</div></main>',
    '<article><div class="menu-less"><p>own text</p></div><div class="cookie-notice">x</div></article>',
    '<article><div class="post share"><p>own text</p></div></article>',
    '<div class="layout sidebar-right"><main><p>own text</p></main><div>z</div></div>',
    '<html><head><meta charset="utf-8"><title>t</title><article><p>own text</p></article>',
    '<div class="page-menu"><article class="story"><p>own text</p></article></div><div class="ad">x</div>',
    '<article><p>own text</p><article class="comment"><p>y</p></article></article>',
    '<article class="comment-free"><header><p>own text</p></header></article><article class="post-comment">y</article>',
])
def test_names_never_empty_an_article(page):
    assert stated_text(page) == "own text"


def test_doubtful_blocks_without_other_text():
    none = np.zeros(0, np.uint64)
    for page, wanted in (('<div class="page-menu"><p>own text</p></div>', "own text"), ('<div class="page-menu">x</div><p>own</p>', "own"),
                         ('<div class="ad">x</div>', ""), ('<article></article><div class="ad-slot">x</div>', "")):
        assert (page_text.unique_text(page_text.page_blocks(page), none) if stated_text(page) is None else stated_text(page)) == wanted


def test_repeated_open_text_goes_and_unique_runs_stay():
    shared = "this site is run by people who like long notices on every page"
    pages = [page_text.page_blocks(f"<p>{shared}</p><p>{n} has words alpha{n} beta{n} of its own</p>") for n in ("one", "two", "three")]
    repeated = np.intersect1d(*map(page_text.page_runs, pages[:2]))
    assert [page_text.unique_text(p, repeated) for p in pages] == [f"{n} has words alpha{n} beta{n} of its own" for n in ("one", "two", "three")]


def test_unique_text_equals_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        pages = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(4)]
        runs = [[tuple(own[i: i + page_text.RUN]) for i in range(len(own) - page_text.RUN + 1)] for own in (p.split() for p in pages)]
        keys = [page_text.page_runs([("open", p)]) for p in pages]
        assert [len(k) for k in keys] == [len(r) for r in runs]
        for p, own in enumerate(pages):
            others = {run for q, more in enumerate(runs) if q != p for run in more}
            gone = {i + k for i, run in enumerate(runs[p]) if run in others for k in range(page_text.RUN)}
            wanted = " ".join(w for i, w in enumerate(own.split()) if i not in gone)
            repeated = np.concatenate([k for q, k in enumerate(keys) if q != p])
            assert page_text.unique_text([("open", own)], repeated) == wanted


def test_article_loses_common_blocks_only():
    notice = "sign up for the letter of this site today"
    common = page_text.page_runs([("article", f"{notice} and read more")])
    for texts, wanted in ((["own words " * 19, notice], 1), ([notice, "own words " * 19, notice + " and read"], 1), ([notice, "short own text"], 2),
                          (["own words " * 19 + notice], 1), (["own words " * 19, notice + " now"], 2), (["own words " * 19, "sign up"], 2), ([notice], 1)):
        texts = [" ".join(t.split()) for t in texts]
        long, heads = page_text.block_starts(texts)
        begun = [i for i, head in zip(long, heads) if page_text.page_runs([("article", head.decode())])[0] in common]
        got = page_text.article_text(texts, begun, common)
        assert got == ("\n".join(texts) if wanted == len(texts) else max(texts, key=len))
    assert page_text.article_text([], [], common) == "" and page_text.block_starts(["", "a b", notice]) == ([2], [notice.rsplit(" ", 1)[0].encode()])


def test_cells_of_pairs_hold_every_pair():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 6_000, 400)
    pairs = np.triu(rng.random((400, 400)) < 0.001, 1)
    met = np.zeros_like(pairs)
    for _, _, rows in ngram_join.cells_of_pairs(pairs, n):
        assert len(rows) <= 2 * ngram_join.BLOCK_ROWS
        met[np.ix_(rows, rows)] = True
    assert not (pairs & ~met).any()


def test_finer_counts_tell_long_texts_apart():
    rng = random.Random(8)
    long = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(8_000)) for _ in range(2)]
    texts = [*long, long[0] + " and a tail"]
    n = words.shingle_sets([words.canonical(t) for t in texts], 5)[1]
    upper = int(np.log(n.max()) / np.log(1.01 * 100 / 80))
    batch = pa.RecordBatch.from_arrays([pa.array([upper] * 3, pa.int32()), pa.array(texts)], ["upper", "text"])
    (made,) = ngram_join.fine_counts(iter([batch]), 5, 80)
    counts = np.stack([np.frombuffer(c, np.uint8) for c in made.column("counts").to_pylist()]).astype(np.int64)
    assert np.argwhere(ngram_join.possible_pairs(n, np.arange(3), counts, 80)).tolist() == [[0, 2]]


def test_words_that_collide_as_polynomials_are_two():
    """A Thue-Morse word and its complement are equal under every polynomial modulo a power of two."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [one, other, f"x {one} y z", f"x {other} y z", "a b", "ab", "b a", "a  b", "", "aa", "aaa"]
    for size in (1, 5):
        sets = {}
        hashes, n = words.shingle_sets([words.canonical(t) for t in texts], size)
        for t, part in zip(texts, np.split(hashes, np.cumsum(n)[:-1])):
            sets[t] = frozenset(part.tolist())
        assert sets["a b"] == sets["a  b"] and sets[""] == frozenset()
        distinct = [sets[t] for t in texts if t != "a  b" and (t != "b a" or size > 1)]
        assert len(set(distinct)) == len(distinct)
