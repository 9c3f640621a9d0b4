"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import functools
import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doclathe.llm import ann, bpe, classifier, html_main, mixing, ngram_join, quality, secrets, suffix_dedup, urls
from doclathe.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=("the", "of", "and", "alpha", "beta", "gamma", "delta", "x1", "Straße", "été", "word")):
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    """Nulls in each column, empty and white texts, copies, near copies, shared passages, a long text, repeated rows."""
    rng = random.Random(3)
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (None, words(rng, 80), "en", "b", 1), (5, "Two words", None, "b", None), (6, "two  WORDS", "en", "b", 9)]
    base = words(rng, 300)
    passage = words(rng, 70)
    for i in range(10, 22):
        w = base.split(" ")
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        rows.append((i, " ".join(w), "en", rng.choice("abc"), 1))
    rows += [(i, base, "en", "c", 1) for i in (30, 31, 32)]
    rows += [(i, words(rng, 40) + "\n" + passage + "\n" + words(rng, 40), "de", "d", 1) for i in range(40, 52)]
    rows += [(i, words(rng, rng.randrange(1, 120)) + "\nsame line\nsame line\n#*$ %&", "fr", rng.choice("abcde"), 1) for i in range(60, 90)]
    rows.append((99, words(rng, 30_000), "en", "e", 1))
    rows += [(100, "again and again and again and again", "en", "e", 1)] * 2
    return rows


CORPUS = corpus()
#: Names that operators use inside.
CLASH = ["size", "hash", "h", "text_hash", "slice", "draw", "w", "g", "p", "b", "key", "batch", "kind", "node", "root", "rep", "n", "votes", "host", "found", "_d", "_t", "bucket", "rate", "bad", "kept", "label", "rank", "leaf", "_h", "_gone", "_again", "_n", "_s1", "_mix_hash", "mix_id", "mix_text", "mix_times", "secret_id", "secret_spans", "jaccard_gone", "kept_id", "kept_text", "code", "votes_", "failed", "more"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, DOCS).repartition(5).persist()


@pytest.fixture(scope="module")
def wide(docs):
    for name in CLASH:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


# 1


def brute_components(rows):
    sets = [(d, grams(t)) for d, t, *_ in rows]
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= 80 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            up[hi] = lo
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=repr)


@pytest.mark.parametrize("most", [500, 4])
def test_ngram_join(docs, most):
    assert rows_of(ngram_join.near_duplicates(docs, most=most)) == brute_components(CORPUS)


def test_ngram_join_keeps_one_of_each(docs):
    got = ngram_join.one_of_each(docs).collect()
    comp = {d: c for d, _, c in brute_components(CORPUS)}
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({c for d, c in comp.items() if d is not None})
    assert len(got[0]) == 5


def test_equal_batches_are_not_one(spark):
    rng = random.Random(9)
    shared = words(rng, 60).split(" ")
    rows = [(i, " ".join(shared + words(random.Random(50 + i), 60).split(" ")), "en", "a", 1) for i in range(6)]  # Jaccard of about a third
    part = spark.createDataFrame(rows, DOCS).coalesce(1)
    twice = part.union(part)
    assert rows_of(ngram_join.near_duplicates(twice)) == brute_components(rows + rows)
    assert sorted(r.doc_id for r in ngram_join.one_of_each(twice).collect()) == list(range(6))


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    a, b, c, d = (words(random.Random(70 + i), 90) for i in range(4))
    near = a + " end"
    rows = [(7, a), (7, b), (7, a), (8, near), (3, near), (3, c), (9, c), (10, d), (11, ""), (11, None), (11, d), (12, b), (None, b), (None, b)]
    got = ngram_join.one_of_each(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(3, near), (3, c), (7, b), (10, d), (11, ""), (11, None), (None, b), (None, b)], key=repr)


def test_ngram_join_of_chained_clusters(spark):
    """Clusters that are candidates of each other by common passages, of many sizes, in groups far over the limit."""
    rng = random.Random(12)
    common = [words(rng, 12).split(" ") for _ in range(3)]
    rows = []
    for c in range(6):
        base = words(rng, 60 + 25 * c).split(" ")
        for i in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["the1", "of2", "and3", "beta7"])
            rows.append((len(rows), " ".join([*w, *common[c % 3], *common[(c + i) % 3]]), "en", "s", 1))
    rng.shuffle(rows)
    got = rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), most=5))
    assert got == brute_components(rows) and len({c for _, _, c in got}) > 6


def test_ngram_join_moves_each_set_of_some_hundreds_once(spark, monkeypatch):
    """Candidates of each other by common passages, none of them linked, more than 500."""
    rng = random.Random(21)
    passages = [words(rng, 40) for _ in range(14)]
    some = rng.sample(list(itertools.combinations(range(14), 4)), 600)
    docs = spark.createDataFrame([(i, " ".join(passages[k] for k in c), "en", "s", 1) for i, c in enumerate(some)], DOCS)
    moved, joined = [], ngram_join._joined
    monkeypatch.setattr(ngram_join, "_joined", lambda groups, percent: moved.append(groups.count()) or joined(groups, percent))
    assert all(r.component_id == r.doc_id for r in ngram_join.near_duplicates(docs).collect())
    assert 500 < sum(moved) <= 600


def test_ngram_join_of_many_blocks_goes_by_grams(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRED", 1)
    test_ngram_join_of_chained_clusters(spark)


def test_ngram_hashes_of_small_pieces_at_once(monkeypatch):
    rng = random.Random(31)
    texts = [rng.choice([None, "", " ", "a B", words(rng, rng.randrange(1, 80))]) for _ in range(400)] + [words(rng, 900), ""]
    alone = [(h, i) for i, t in enumerate(texts) for h in ngram_join.ngram_hashes(pa.array([t], pa.string()))[0].tolist()]
    held, spans = [], ngram_join.word_spans
    monkeypatch.setattr(ngram_join, "word_spans", lambda data, offsets: held.append((len(data), len(offsets) - 1)) or spans(data, offsets))
    monkeypatch.setattr(ngram_join, "CACHED_BYTES", 1000, raising=False)
    h, doc = ngram_join.ngram_hashes(pa.array(texts))
    assert list(zip(h.tolist(), doc.tolist())) == alone
    assert all(size <= 1000 or count == 1 for size, count in held) and len(held) > 20
    assert [x.tolist() for x in ngram_join.sets_of(pa.array(texts), 5)[:2]] == [list(x) for x in zip(*sorted(set(alone)))]


def test_ngrams_in_order_of_count():
    rng = np.random.default_rng(4)
    h, many, doc = np.sort(rng.integers(0, 1 << 63, 5000).astype(np.uint64)), rng.integers(2, 9, 5000).astype(np.uint32), rng.integers(0, 40, 5000).astype(np.uint16)
    many[:50] = ngram_join.MOST_COUNTED
    assert ngram_join._rarest_first(h, many, doc).tolist() == np.lexsort((h, many, doc)).tolist()


def test_two_sets_are_compared_without_a_tree(monkeypatch):
    rng, made, tree = random.Random(6), [], ngram_join.PrefixTree
    monkeypatch.setattr(ngram_join, "PrefixTree", lambda *a: made.append(1) or tree(*a))
    for _ in range(300):
        x, y = (np.array(sorted(rng.sample(range(24), rng.randrange(14, 24))), np.uint64) for _ in range(2))
        (nx, ny), (a, b) = ((len(s) + rng.randrange(3) for s in (x, y)), rng.choice([(2, 2), (0, 1), (1, 0), (0, 0)]))
        label = rng.randrange(4)
        common = len(set(x.tolist()) & set(y.tolist()))
        joined = not label or (a == 2 or a != b) and 100 * common >= 80 * (nx + ny - common)
        assert ngram_join.linked([(nx, x, 0, a), (ny, y, label, b)], 80) == [(0, 0), (1, 0 if joined else 1)]
    assert not made


def test_prefix_tree_finds_all_links():
    rng = random.Random(5)
    for _ in range(30):
        base = [rng.sample(range(60), 25) for _ in range(3)]
        sets = [sorted(set(b) ^ set(rng.sample(range(60), rng.randrange(6)))) for b in base for _ in range(8)]
        sizes = [len(s) + rng.randrange(3) for s in sets]
        tree, union = ngram_join.PrefixTree(sets, sizes), ngram_join.Union(len(sets))
        for x in range(len(sets)):
            tree.link(x, union, 80, lambda a, b: True)
        want = ngram_join.Union(len(sets))
        for a, b in itertools.combinations(range(len(sets)), 2):
            common = len(set(sets[a]) & set(sets[b]))
            if 100 * common >= 80 * (sizes[a] + sizes[b] - common):
                want.join(a, b)
        assert [union.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


# 2


def test_bpe_is_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    odd = ["", "ΣΑΣ İ ﬁ é", "a" * 3000, "!" * 500, "don't <|endoftext|>x<|startoftext|>", "\x1c\x85\u2028 1²Ⅳ 漢字 👍🏽", "it's\u00a0we'll"]
    extra = docs.sparkSession.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(odd)], DOCS)
    got = rows_of(bpe.tokenize(docs.unionByName(extra), vocabulary_path()))
    want = []
    for d, t, *_ in [*CORPUS, *[(1000 + i, t) for i, t in enumerate(odd)]]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_bpe_code_points_and_windows(monkeypatch):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary_path()), bpe.codec(open(vocabulary_path(), "rb").read())
    odd = [c for a, b in (*bpe.LETTERS_16, *bpe.NUMBERS_16) for c in range(a, b + 1)] + [0x558, 0x58B, 0x88F, 0xC5C, 0x10940, 0xA7CE, 0xA7D2, 0x16EA0, 0x3A3]
    points = [c for c in range(0x110000) if c < 0x600 or c % 97 == 0 and not 0xD800 <= c < 0xE000] + odd
    texts = [f"a{c}b{c}{c}1{c} {c}" for c in map(chr, points)]
    assert [own.encode_text(t) for t in texts] == [" ".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe, "WINDOW", 7)
    for text in ["", " ", "one two  three four\nfive <|endoftext|>six e\u0301 \u0301x " * 5, "x" * 100 + " y"]:
        ids = library.encode(text, add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        assert own.digests(text, True) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest(), ids)


def test_bpe_stream_emits_early():
    codec = bpe.codec(open(vocabulary_path(), "rb").read())
    stream = codec.stream("ab" * 20_000)
    next(stream)
    assert len(stream.gi_frame.f_locals["last"]) < 10 * codec.lookahead


def test_byte_state_machine():
    alphabet = bpe.byte_alphabet()
    state = bpe.ByteState({c: b for b, c in enumerate(alphabet)}, {})
    assert "".join(state.push(alphabet[b]) for b in "é漢👍".encode()) + state.close() == "é漢👍"
    assert state.push(alphabet[0xE6]) == "" and state.close() == "\ufffd"


# 3


def test_mixing(docs):
    got = mixing.mix_sizes(docs).collect()
    assert rows_of(mixing.mix_sizes(docs)) == sorted(map(tuple, got), key=repr)
    size = Counter()
    for _, t, _, s, _ in CORPUS:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, left, open_ = {}, sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        for s in over or open_:
            goal[s] = 3 * size[s] if over else weight[s] * level
        left -= sum(goal[s] for s in over)
        open_ -= over or open_
    source = {d: s for d, _, _, s, _ in CORPUS}
    taken, longest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, goal[s], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in names:
        assert abs(taken[s] - goal[s]) <= longest[s] / 2 + 1e-6


def test_mixed_documents_repeat(docs):
    want = Counter()
    for r in mixing.mix_sizes(docs).collect():
        want[r.doc_id] += r.taken // r.size if r.size else 0
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == +want


def test_mixed_documents_by_source(spark):
    same = words(random.Random(1), 100)
    rows = [(1, same, "en", "a", 0)] * 15 + [(1, same, "en", "b", 0)] + [(100 + i, words(random.Random(i), 100), "en", "b", 0) for i in range(30)] + [(None, same, None, None, 0)] * 4 + [(5, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want, size = Counter(), {}
    for r in mixing.mix_sizes(docs).collect():
        want[r.source] += r.taken
    got = Counter()
    for r in mixing.mix_documents(docs).collect():
        got[r.source] += 100
    assert got == +want


def test_mixing_joins_many_sources(docs, monkeypatch):
    want = rows_of(mixing.mix_sizes(docs))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    assert rows_of(mixing.mix_sizes(docs)) == want


# 4


def test_html():
    page = html_main.Page('<html><head><title>t</title><body><header>Site</header><nav><a>m</a></nav><div class="side-bar sidebar">s</div><article><header><h1>Head &amp; line</h1></header><p>One\n <b>two<br>three<p>four<script>var a = "</p>";</script><ul><li>a<li>b</ul><div class="comments"><p>reader</div><form>f</form></article><footer>end</footer>')
    assert page.articles == ["Head & line", "One two three", "four", "a", "b"]


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'aria-hidden="false"', 'data-x="hidden"', 'data-id="sidebar" data-role="banner"', 'class="hidden-x"', 'title="a hidden thing"', 'style="display: none; display: block"'])
def test_html_shown(attrs):
    assert html_main.Page(f"<body><div {attrs}><article><p>Text</p></article></div>").articles == ["Text"]


@pytest.mark.parametrize("attrs", ["hidden", 'HIDDEN=""', "class=a hidden id=b", 'style="color:red; Display : none"', "style='visibility:hidden !important'", 'id="sidebar"', "role=banner"])
def test_html_hidden(attrs):
    assert html_main.Page(f"<body><div {attrs}><article><p>Text</p></article></div>").articles == []


def test_html_template(spark):
    rows = [(i, f"http://h.x/{i}", f"<body><div>Site name</div><div><p>Body {i} text</p><p>All rights</p></div><p>page {i * 7}</p></body>") for i in range(9)]
    rows += [(20, None, None), (21, "nohost", ""), (None, "http://h.x/z", "<p>x"), (22, "http://one.x/", "<p>Alone &copy; here"), (22, "http://one.x/", "<p>Alone &copy; here")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("frame", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.main_text(pages).collect()}
    assert got[3] == ("Body 3 text\npage 21", 19) and got[20] == ("", 0) and got[21] == ("", 0) and got[22] == ("Alone © here", 12)
    assert html_main.main_text(pages).count() == len(rows) and html_main.main_text(pages.limit(0)).count() == 0


def test_html_template_of_inline_text(spark):
    menu = "<ul><li><a>Home</a></li><li><a>News</a></li></ul><p><span>Subscribe</span></p>"
    rows = [(i, f"http://h.x/{i}", f"<body>{menu}<p>By <a>Author {i}</a></p><ul><li>Price: <b>{i * 12}</b></li></ul><div>Lead <i>in</i><p>Body {i}</p>Tail <b>{i}</b></div></body>") for i in range(9)]
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"By Author {i}\nPrice: {i * 12}\nBody {i}\nTail {i}" for i in range(9)}


PAGES = "page_id long, url string, html string"


def brute_match(a, b):
    """The size of the largest match of two trees (tag, children), by trying all."""
    if a[0] != b[0]:
        return 0

    @functools.cache
    def best(i, j):
        if i == len(a[1]) or j == len(b[1]):
            return 0
        s = brute_match(a[1][i], b[1][j])
        return max(best(i + 1, j), best(i, j + 1), s + best(i + 1, j + 1) if s else 0)

    return 1 + best(0, 0)


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_html_alignment_is_the_largest(cells, monkeypatch):
    monkeypatch.setattr(html_main, "_CELLS", cells)
    rng = random.Random(3)

    def tree(depth):
        return (rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randrange(5))] if depth else [])

    def frame(t, depth=0):
        return ";".join([f"{depth}:{t[0]}:{rng.choice(['', '', '1', '2'])}", *(frame(k, depth + 1) for k in t[1])])

    for _ in range(150):
        a, b = ("r", [tree(2) for _ in range(rng.randrange(7))]), ("r", [tree(2) for _ in range(rng.randrange(7))])
        shapes = html_main.Shapes()
        one, two = html_main.read_frame(frame(a), shapes), html_main.read_frame(frame(b), shapes)
        pairs = html_main.align(one[0], two[0], shapes)
        assert len(pairs) == brute_match(a, b) == shapes.match(one[0][5], two[0][5])
        assert len({x for x, _, _ in pairs}) == len({y for _, y, _ in pairs}) == len(pairs)
        assert sorted(pairs) == sorted(pairs, key=lambda p: (p[0], p[1])) and [y for _, y, _ in sorted(pairs)] == sorted(y for _, y, _ in pairs)


def test_html_wrapper_within_and_beside_articles(spark):
    def page(i, extra=""):
        return f"<body><article><p>Share this story</p><h1>Title {i}</h1><p>{words(random.Random(i), 40)}</p><p>Written by our staff</p></article>{extra}</body>"

    rows = [(i, f"http://in.x/{i}", page(i, f"<div>More of {i}</div>")) for i in range(5)] + [(5, "http://in.x/0", page(0, "<div>More of 0</div>"))] * 3
    # the story stands outside two teasers, on every page of the host
    rows += [(10 + i, f"http://tease.x/{i}", f"<body><article><p>Teaser {i}</p></article><article><p>Other {i}</p></article><div><p>{words(random.Random(i), 50)}</p></div></body>") for i in range(4)]
    rows += [(20, "http://alone.x/", "<main><div class='share-price'>Shares rose</div><div class='share-buttons'>Post</div><div class='related_posts'>x</div><div class='comment-list-2'>y</div></main>")]
    # near copies of one text, and copies: their text isn't template
    base = [words(random.Random(99 + j), 30) for j in range(6)]
    rows += [(30 + i, f"http://near.x/{i}", "<article>" + "".join(f"<p>{t if j != i else 'edit ' + t}</p>" for j, t in enumerate(base)) + "</article>") for i in range(6)]
    got = {r.page_id: r for r in html_main.main_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert all(got[i].text == f"Title {i}\n{words(random.Random(i), 40)}" for i in range(5)) and got[5].text == got[0].text
    assert all(words(random.Random(i), 50) in got[10 + i].text for i in range(4))
    assert got[20].text == "Shares rose"
    assert all(got[30 + i].text == "\n".join(t if j != i else "edit " + t for j, t in enumerate(base)) for i in range(6))
    assert all(r.induced == (i != 20) for i, r in got.items())


def test_html_long_and_deep(spark, monkeypatch):
    long = "".join(f"<p>para {i} {'word ' * 5}</p>" for i in range(3000))
    flat = [(i, f"http://flat.x/{i}", "<div>Same head</div>" + ("<div>one more</div>" if i == 2 else "") + "".join(f"<p>para {i} {k} x</p>" for k in range(1500)) + "<div>Same foot</div>") for i in range(4)]
    deep = [(10 + i, f"http://deep.x/{i}", "<div>" * 3000 + f"Body {i}" + "</div>" * 2990 + "<div>Same end</div>") for i in range(4)]
    odd = [(20, "http://odd.x/", long), (21, None, None), (22, "", "<p>"), (23, "http://flat.x/9", "")]
    pages = spark.createDataFrame(flat + deep + odd, PAGES)
    got = {r.page_id: r.text for r in html_main.main_text(pages).collect()}
    assert all(got[i] == "\n".join(([] if i != 2 else ["one more"]) + [f"para {i} {k} x" for k in range(1500)]) for i in range(4))
    assert all(got[10 + i] == f"Body {i}" for i in range(4)) and got[20].count("\n") == 2999 and got[21] == got[22] == got[23] == ""
    monkeypatch.setattr(html_main, "MOST_MODELS", 0)
    assert {r.page_id: r.text for r in html_main.main_text(pages).collect()} == got


def test_html_empty_article(spark):
    rows = [(i, f"http://h.x/{i}", f"<body><main><p> </p></main><div>Site name</div><div><p>Body {i}</p></div></body>") for i in range(4)]
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Body {i}" for i in range(4)}


# 5


def brute_quality(text):
    w = WORD.findall(text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    places = {i + j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(places) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), again, len(places), failed


def test_quality(docs):
    got = quality.quality_rules(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == sorted(((d, *brute_quality(t)) for d, t, *_ in CORPUS), key=repr)
    assert all(r.kept == (not r.base_failed and r.host_rate < quality.HOST_LIMIT and not r.failed) for r in got)


def test_bad_hosts_lose_their_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 20 == 0 else "few words", None, "bad", None) for i in range(200)] + [(1000 + i, good if i % 20 else "few words", None, f"s{i % 9}", None) for i in range(900)]
    got = quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert not any(r.kept for r in got if r.doc_id < 200)
    assert sum(r.kept for r in got if r.doc_id >= 1000) == 900 - 45


def test_hosts_decide_on_single_failures(spark):
    good, soup = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}%" for i in range(60))
    twice = "\n".join(f"some line w{i // 4}" for i in range(80))
    rows = [(h * 1000 + i, soup if i % (200 if h else 4) == 0 else good, None, f"host{h}", None) for h in range(8) for i in range(600)]
    rows += [(9000 + i, "\n".join(f"word{j} of line w{i} {j} {'x' * 20}" for j in range(30)), None, "long", None) for i in range(30)] + [(9900, twice, None, "host1", None)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[i].kept for i in range(0, 600, 4)) and got[0].failed == ["symbols"]  # a host of many such texts
    assert all(got[h * 1000 + i].kept for h in range(1, 8) for i in range(600))  # on trusted hosts the few stay
    assert all(got[i].kept for i in range(1, 600) if i % 4)
    assert not got[9900].kept


# 6


def brute_repeats(rows):
    least = {}
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, b in data:
        for i in range(len(b) - 49) if d is not None else ():
            least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], d))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49) if d is not None else ():
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(gone) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [256, 2])
def test_suffix_dedup(docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    assert rows_of(suffix_dedup.deduplicated(docs, hot=hot)) == brute_repeats(CORPUS)


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(2)
    size = rng.integers(50, suffix_dedup.MOST + 1, 200)
    rows = rng.integers(97, 99, (200, suffix_dedup.MOST)).astype(np.uint8)
    rows[:, 10:62] = rows[rng.integers(0, 9, 200), 10:62]
    rows[np.arange(suffix_dedup.MOST) < suffix_dedup.MOST - size[:, None]] = 0
    who, length, new = suffix_dedup.suffix_groups(rows, size)
    found = [bytes(rows[w, suffix_dedup.MOST - n :]) for w, n in zip(who, length)]
    assert found == sorted(found) and len(found) == (size - 49).sum()
    assert new.tolist() == [True, *(a[:50] != b[:50] for a, b in zip(found, found[1:]))]


# 7


def test_classifier_tells_junk(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(names) for _ in range(rng.randrange(60, 200))), None, None, None) for i in range(400)]
    rows += [(1000 + i, " ".join(rng.choice(names) + "%%%" for _ in range(100)), None, None, None) for i in range(60)] + [(2000 + i, "buy " * 120, None, None, None) for i in range(60)]
    got = {r.doc_id: r.kept for r in classifier.classify(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(got[i] for i in range(400)) >= 396 and sum(got[i] for i in range(1000, 1060)) + sum(got[i] for i in range(2000, 2060)) <= 6


def test_classifier_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(classifier, "SAMPLE", 50)
    seen = []
    monkeypatch.setattr(classifier, "train", lambda rows, real=classifier.train: seen.append(len(rows)) or real(rows))
    rng = random.Random(3)
    junk, fine = "buy " * 90, [words(rng, 80) for _ in range(300)]
    rows = [(None, t, None, None, None) for t in fine] + [(5, junk + str(i % 7), None, None, None) for i in range(300)] + [(5, None, None, None, None), (None, "", None, None, None), (7, words(rng, 20_000), None, None, None)]
    got = classifier.classify(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and 10 <= seen[0] <= 50
    by_votes = defaultdict(set)
    for r in got:
        by_votes[r.votes].add(r.posterior)
    assert all(len(v) == 1 for v in by_votes.values())
    assert len({r.score for r in got if r.doc_id == 5}) <= 8 + 1  # equal texts have equal scores


def test_posteriors_by_brute_force():
    """One round of estimation on every single document is one round on the counts of patterns."""
    rng, docs = random.Random(6), []
    for _ in range(500):
        docs.append([rng.choice([0, 1, 2]) for _ in range(3)])
    counts = Counter("".join(map(str, d)) for d in docs)
    got, right = classifier.posteriors(dict(counts), rounds=25)
    votes = np.array(docs)
    p = ((votes == 2).sum(1) + 1.0) / ((votes > 0).sum(1) + 2.0)
    p = np.where((votes == 1).sum(1) >= 2, np.minimum(p, 0.3), p)
    for _ in range(25):
        log = []
        for q in (p, 1 - p):
            t = np.array([[(q * (votes[:, j] == v)).sum() + 0.5 for v in range(3)] for j in range(3)])
            t /= t.sum(1, keepdims=True)
            log.append(np.log(q.sum() + 1) + sum(np.log(t[j][votes[:, j]]) for j in range(3)))
        p = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    assert np.allclose(p, [got["".join(map(str, d))] for d in docs])


def test_em_finds_the_better_labeller():
    rng, counts = random.Random(4), Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        counts["".join("0" if rng.random() < 0.1 else "12"[good == (rng.random() < a)] for a in (0.95, 0.9, 0.65, 0.9))] += 1
    _, right = classifier.posteriors(dict(counts))
    assert right[2] < min(right[0], right[1], right[3]) and right[0] > 0.9


# 8


def test_urls(spark):
    rng = random.Random(2)
    nice = [f"https://www.site{rng.randrange(50)}.example.com/{rng.choice(['en', 'fr'])}/{rng.randrange(999)}?q" for _ in range(300)]
    junk = [f"http://m.casino-win{rng.randrange(9)}.example.com/en/{rng.randrange(999)}" for _ in range(60)]
    fixed = [None, "", "no scheme", "HTTP://A.EXAMPLE.NET/en/x", "x://b.example.net/fr/", "x://net", "x://notnet/", "x://c.net?/en/", "x://w.org/fr/1#a", "x://example.com/de/", "x://EXAMPLE.com/de", "a://b://c.net/"]
    rows = list(enumerate(nice + junk + fixed)) + [(None, "x://d.net/")]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(0))).collect()}
    assert sum(got[i].verdict == "block" for i in range(300)) <= 9 and all(got[i].verdict == "block" for i in range(300, 360))
    at = {u: got[360 + i] for i, u in enumerate(fixed)}
    assert [at[u].rule for u in fixed] == [None, None, None, "example.net/en/", "net/", None, None, None, "org/fr/", "example.com/de/", None, None]
    assert (at["HTTP://A.EXAMPLE.NET/en/x"].host, at["HTTP://A.EXAMPLE.NET/en/x"].path) == ("a.example.net", "/en/x")
    assert (at["x://c.net?/en/"].host, at["x://c.net?/en/"].path) == ("c.net", "") and at[None].host == "" and got[None].rule == "net/"


def test_urls_are_all_fitted(spark, monkeypatch):
    """Every distinct labelled URL counts, but those held out; the threshold is the exact quantile of these."""
    rows = [(i, f"http://{'casino' if i % 4 == 0 else 'school'}{i}.com/{i * 7919 % 1000}") for i in range(400)]
    pages = urls.ruled(urls.parts(spark.createDataFrame(rows + rows, "page_id long, url string")))
    if hasattr(urls, "SAMPLE"):
        monkeypatch.setattr(urls, "SAMPLE", 20)
    model = urls.fit_filter(pages)
    held = {r.host + r.path: r.h for r in pages.select("host", "path", (F.pmod(F.xxhash64("host", "path"), F.lit(3)) == 0).alias("h")).collect()}
    fitted = [urls.masked(t.split("/")[0], urls.RULES) + "/" + t.split("/")[1] for t, h in held.items() if not h and "school" in t]
    assert int(model.good.totals.max()) >= sum(len(t) + 1 for t in fitted) > 20 * 30
    scores = np.sort(model.ratios([t for t, h in held.items() if h and "school" in t]))
    assert model.threshold == max(scores[int(np.ceil(len(scores) * 0.99)) - 1] + 1e-12, 0)


def test_urls_by_the_name_of_the_host():
    rng = random.Random(6)
    good = [(f"www.{rng.choice(['garden', 'school', 'museum', 'library', 'river'])}{rng.randrange(40)}.{rng.choice(['com', 'org'])}", f"/en/{rng.randrange(999)}") for _ in range(400)]
    bad = [(f"{rng.choice(['best-casino', 'cheap-pills', 'mega-poker'])}{rng.randrange(40)}.{rng.choice(['com', 'org'])}", f"/en/{rng.randrange(999)}") for _ in range(200)]
    model = urls.Filter(good, bad)
    assert model.blocks("casino-win.com/en/7") and model.blocks("cheap-pills.org/en/8") and not model.blocks("www.garden7.com/en/9") and not model.blocks("school.org/en/9")
    assert [urls.masked(h, urls.RULES) for h in ("a.b.example.com", "example.com", "notexample.com", "cheap-pills.org", "x.example.net")] == ["a.b", "", "notexample.com", "cheap-pills", "x"]
    hosts = {"casino-win.com": True, "my-bets3.org": True, "ads-track.example.com": True, "alphabets.com": False, "essex.org": False, "downloads.org": False, "caterpillar.com": False}
    assert {h: bool(re.search(urls.bad_word(), h)) for h in hosts} == hosts


# 9


def test_secrets(spark):
    live = "Zx9kQ2mV7bR4tL8pW3nY6cD1"
    copied = "Qw3rTy8uIo5pAs2dFg7hJk4l"
    texts = {
        1: f'é password = "abcdefghijkl" API_KEY: short token=secret:abcdefghijklmnop AKIA{"A1" * 7} AKIASHORT {"0f" * 8} {live}',
        2: f"{copied} ſecret=abcdefghijklmnop", 3: copied, 4: copied, 5: None, 6: "", 7: "deadbeef" * 400,
    }
    rows = [(d, t, "en", f"s{d}", 0) for d, t in texts.items()] + [(3, copied, "en", "s3", 0), (None, "token:abcdefghijkl", None, None, None)]
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows, DOCS).withColumn("hash", F.lit(1)).withColumn("found", F.lit(1))).collect()}

    def base(text):
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        return sorted(found)

    for d, t in [*texts.items(), (None, "token:abcdefghijkl")]:
        want = base(t or "")
        kinds = [k for _, k, _ in want]
        assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == [kinds.count(k) for k in range(3)]
        assert got[d].base_sha256 == hashlib.sha256(secrets.joined(want).encode()).hexdigest()
        assert set(secrets.joined(want).split(",")) - {""} <= set(got[d].spans.split(","))
    assert (got[1].n_owned, got[1].n_copied) == (4, 0) and (got[3].n_owned, got[3].n_copied) == (0, 1) and (got[5].n_owned, got[5].n_copied) == (0, 0)
    at = texts[1].index(live)
    assert f"owned:{at}:{at + len(live)}" in got[1].spans and "owned" not in got[2].spans + got[3].spans
    clean = {r.doc_id: r.text for r in secrets.redact_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert live not in clean[1] and clean[1].startswith("é [secret]") and clean[3] == copied and clean[5] is None


def test_secrets_by_repositories(spark):
    """Two owners may have a value; more owners, or more repositories of them, make it an example. Null is an owner of its own."""
    value = {k: hashlib.sha256(k.encode()).hexdigest()[:24] for k in "abcd"}
    rows = [(1, "a", "en", "s1"), (2, "a", "en", "s2"), (3, "b", "en", "s1"), (4, "b", "en", "s2"), (5, "b", "en", None), (6, "c", None, None), (7, "c", "en", "")]
    rows += [(10 + i, "d", f"l{i}", "s1") for i in range(5)]
    got = {r.doc_id: (r.n_owned, r.n_copied) for r in secrets.secret_spans(spark.createDataFrame([(i, f"x {value[k]} y {value[k]}", lang, s, 0) for i, k, lang, s in rows], DOCS)).collect()}
    assert {i: got[i] for i, k, _, _ in rows} == {i: (1, 0) if k in "ac" else (0, 1) for i, k, _, _ in rows}


# 10


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    vectors = (centres[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    vectors[100:400] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0] * 3), (None, [1.0] * 16), (7, vectors[7].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("hash", F.lit(1)).withColumn("ids", F.lit(1)).repartition(4)
    got = defaultdict(list)
    for r in ann.nearest(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    exact = vectors.astype(np.float64)
    hits = 0
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        score = np.zeros(3000)
        for j in range(16):
            score += exact[:, j] * exact[q, j]
        assert [s for _, s in found] == [score[i] for i, _ in found] and found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == 20
        order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]
        hits += len({i for i, _ in found} & set(order))
        tied = [i for i, _ in found if 100 <= i < 400]
        assert tied == [i for i in range(100, 400) if i != q][: len(tied)]
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("size, recall", [(4_000, 0.9), (16_000, 0.9), (1_500, 1.0)])
def test_recall_without_clusters(spark, size, recall):
    """Vectors without any structure, the hardest case: what is measured holds for other queries, at either size."""
    rng = np.random.default_rng(size)
    vectors = rng.normal(size=(size, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    asked = list(range(3, size, size // 100))
    got = defaultdict(set)
    for r in ann.nearest(table, table.where(F.col("vec_id").isin(asked)), **({"recall": 1} if recall == 1 else {})).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in asked:
        score = vectors @ vectors[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= recall * 20 * len(asked)


def test_queries_visit_some_at_a_time():
    from doclathe.llm import ann

    rows = np.random.default_rng(4).normal(size=(600, 8))
    forest = ann.Forest(rows, 20, 3, float(np.linalg.norm(rows, axis=1).max()))
    parts = list(ann._visited(forest, rows, 5))
    assert sum(len(p[0]) for p in parts) == 600 and max(len(p[0]) for p in parts) <= ann.VISITORS
    assert [x for p in parts for x in p[1].tolist()] == [x for v in forest.visit(rows, 5) for x in v]


def test_few_neighbours(spark):
    table = spark.createDataFrame([(20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in ann.nearest(table, table.where("vec_id = 20")).orderBy("rank").collect()] == [(1, 2.0), (2, 1.0)]


# all


OPERATORS = {
    "ngram": ngram_join.near_duplicates, "one": ngram_join.one_of_each, "bpe": lambda d: bpe.tokenize(d, vocabulary_path()), "mix": mixing.mix_sizes, "mixed": mixing.mix_documents,
    "quality": quality.quality_rules, "suffix": suffix_dedup.deduplicated, "classifier": classifier.classify, "secrets": secrets.secret_spans, "redact": secrets.redact_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, name):
    assert OPERATORS[name](none).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(docs, wide, name):
    got = OPERATORS[name](wide)
    if got.columns == wide.columns:
        assert all(r[c] == "clash" for r in got.select(CLASH).collect() for c in CLASH)
        got = got.select(docs.columns)
    assert rows_of(got) == rows_of(OPERATORS[name](docs))


def test_pages_tables_may_be_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge_urls(pages).count() == 0 and html_main.main_text(pages).count() == 0


def test_quality_of_long_texts(spark):
    rng = np.random.default_rng(3)
    for words, kinds in ((8_191, 60), (8_192, 60), (30_000, 90), (20_000, 1)):  # about where windows go to pairs, and beyond
        text = " ".join(f"w{x}" for x in rng.integers(0, kinds, words))
        got = quality.quality_rules(spark.createDataFrame([(1, text, "en", "s", len(text))], DOCS)).first()
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed) == brute_quality(text)
