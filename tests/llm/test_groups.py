"""Near dedup, decontamination, HTML, chat, tokens, packing, and the pipeline."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftspark.llm import chat_format, decontaminate, html_extract, near_dedup, packing, queries, token_store
from siftspark.llm.tokenizing import default_tokenizer_path, encoder

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(x), find(y))] = min(find(x), find(y))
    least = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        least[find(x)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted(((i, len(s), least[find(x)], i == least[find(x)]) for x, (i, s) in enumerate(sets)), key=str)


def test_near_dedup_chains_and_copies(spark, odd_docs):
    r = random.Random(1)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows, text = [], list(base)
    for i in range(60):
        rows.append((100 + i, " ".join(text)))
        text = list(text if i % 2 else base)
        for _ in range(r.randint(0, 5)):
            text[r.randrange(len(text))] = f"n{r.randrange(10**6)}"
    rows += [(500, "a b c"), (501, "A  b\tC"), (502, "a b d"), (None, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    got = sorted((tuple(x) for x in near_dedup.near_report(docs).collect()), key=str)
    assert got == brute_components([tuple(x) for x in docs.collect()])


def test_near_dedup_second_stage_alone(spark, monkeypatch):
    """Without hubs every link has to come from the comparison across components, with its bounds on and buckets crowded."""
    monkeypatch.setattr(near_dedup, "HUBS", 0)
    monkeypatch.setattr(near_dedup, "CROWDED", 3)
    r = random.Random(4)
    rows = []
    for family in range(6):
        base = [f"f{family}w{r.randrange(80)}" for _ in range(100)]
        for _ in range(12):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                text[r.randrange(len(text))] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in near_dedup.near_report(docs).collect()), key=str)
    assert got == brute_components(rows)
    assert len({x[2] for x in got}) < len(rows) / 2


def test_near_dedup_stage_keeps_one_row_and_own_columns(spark):
    text = "one two three four five six"
    rows = [(1, text, 0), (1, text, 0), (2, text, 0), (None, text, 0), (3, None, 0), (3, None, 0), (None, "seven eight", 0), (None, "seven eight", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int").selectExpr("doc_id", "text", "x AS __nd_id", "x AS __own_0", "x AS cls")
    out = near_dedup.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(x)[:2] for x in out.collect()), key=str) == sorted([(1, text), (3, None), (3, None), (None, "seven eight")], key=str)


def test_spread_join_is_a_join(spark, monkeypatch):
    from siftspark.llm import _shared

    monkeypatch.setattr(_shared, "HOT_ROWS", 5)
    monkeypatch.setattr(_shared, "HOT_KEYS", 10)
    left = _shared.durable(spark.createDataFrame([(k, i) for i, k in enumerate([1] * 40 + [2] * 30 + [None] * 20 + [*range(3, 20)] * 2)], "k long, i long"), "t")
    right = spark.createDataFrame([(k, k * k) for k in range(0, 12)], "k long, v long")
    for how in ("inner", "left"):
        assert sorted(map(str, _shared.spread_join(left, right, "k", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_near_dedup_keeps_columns(odd_docs, no_docs):
    out = near_dedup.near_dedup(odd_docs)
    assert out.columns == odd_docs.columns and {x.doc_id for x in out.collect()} == {1, 2, 3, None, 4, 5, 6}
    assert near_dedup.near_report(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 60, 3000])
def test_sketches_fill_and_concentrate(n):
    r = np.random.default_rng(n)
    a = r.integers(0, 1 << 63, n).astype(np.uint64)
    b = np.concatenate([a[: 3 * n // 4], r.integers(0, 1 << 63, n - 3 * n // 4).astype(np.uint64)])
    x, y = near_dedup.sketch(a), near_dedup.sketch(b)
    assert (x != near_dedup._EMPTY).all() and (near_dedup.sketch(a[::-1].copy()) == x).all()
    if n >= 60:
        assert abs((x == y).mean() - len(set(a) & set(b)) / len(set(a) | set(b))) < 0.2


def sellers(p, t):
    prev = list(range(len(p) + 1))
    best = prev[-1]
    for c in t:
        cur = [0]
        for i, x in enumerate(p):
            cur.append(min(prev[i] + (x != c), prev[i + 1] + 1, cur[i] + 1))
        prev, best = cur, min(best, cur[-1])
    return best


def test_decontamination_against_full_distance():
    r = random.Random(3)
    for _ in range(400):
        items = [(i, "".join(r.choice("abc ") for _ in range(r.randint(1, 70)))) for i in range(3)]
        t = list("".join(r.choice("abc ") for _ in range(30)) + r.choice(items)[1] + "abc")
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(["", "a", "bc"])
        t = "".join(t)
        norm = decontaminate.normalise
        want = {(i, d) for i, x in items for d in [sellers(norm(x), norm(t))] if norm(x) and len(norm(x)) >= 16 and d <= len(norm(x)) // 16}
        want |= {(i, 0) for i, x in items if 0 < len(norm(x)) < 16 and f" {norm(x)} " in f" {norm(t)} "}
        assert {h[:2] for h in decontaminate.Matcher(items).hits(t)} == want


def test_decontamination_blocks_and_odd_rows(spark, odd_docs, no_docs):
    item = "a passage that is certainly long enough to be found, with punctuation"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, item.upper()), (5, "quite another passage that nobody has ever written down")], "item_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(9, "x " + item.replace("certainly", "certainy") + " y")], "doc_id long, text string"))
    for chars in (10_000, 40):
        assert sorted((x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench, block_chars=chars).collect()) == [(9, 1), (9, 4)]
        kept = decontaminate.decontaminate(docs, bench, block_chars=chars)
        assert kept.count() == 8 and kept.columns == docs.columns
    assert decontaminate.find_leaks(no_docs, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 9


def test_decontamination_short_items_and_null_ids(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (None, "one cat"), (None, "ONE, cat"), (2, "one cat"), (3, "?!"), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "ask: what is the capital of france"), (2, "here one cat sat"), (3, "one catalogue, stone cat"), (4, "what is the capitol of france"), (5, "?! "), (None, "One cat.")], "doc_id long, text string")
    want = [(1, 1, 0), (2, None, 0), (2, None, 0), (2, 2, 0), (4, 1, 1), (None, None, 0), (None, None, 0), (None, 2, 0)]
    for chars in (1, 40, 10_000):
        got = [(x.doc_id, x.item_id, x.distance) for x in decontaminate.find_leaks(docs, bench, block_chars=chars).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert {x.doc_id for x in decontaminate.decontaminate(docs, bench, block_chars=chars).collect()} == {3, 5}
    blocks = list(decontaminate.item_blocks(spark.createDataFrame([(i, "same") for i in range(10)], "item_id long, text string"), block_chars=12))
    assert [len(b) for b in blocks] == [3, 3, 3, 1]


PAGE = "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><header>Site</header><nav><ul><li>a<li>b</ul></nav><!-- c --><div class='notice'>N{0}</div><article><h1>T{0}</h1><p>One <b>b{0}</b>&amp; &eacute;<br>two<p>Three<aside>x</aside><form>q<input></form><div class=box>Always the same</div></article><section id='comments'><p>me</p></section><footer>f</footer></body></html>"


def test_html_main_text(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(i)) for i in range(5)]
    rows += [(10, "https://one.example/", PAGE.format(10)), (11, None, None), (12, "nonsense", ""), (13, "https://h.example/13", "<p>a<b>b</b> &lt;c&gt; <!-- open"), (10, "https://one.example/", PAGE.format(10))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS host")
    out = [(r.page_id, r.text) for r in html_extract.page_report(pages).collect()]
    got = dict(out)
    assert len(out) == len(rows)
    assert all(got[i] == f"T{i} One b{i}& é two Three" for i in range(5))  # the box is the same on every page: template
    assert got[10] == "T10 One b10& é two Three Always the same"  # one page alone shows no template
    assert got[11] == got[12] == "" and got[13] == "ab <c>"
    assert html_extract.page_report(pages.limit(0)).count() == 0


def test_html_copies_and_small_groups_show_no_template(spark):
    """Copies count once, a slot must be constant on the host, and a page loses only the very content that is constant."""
    page = "<body><div class=top>{1}</div><article><p>Text {0}</p>{2}</article></body>"
    table, heading = "<table><tr><td>Figures</td></tr></table>", "<h2>References</h2>"
    rows = [("copies", page.format("copied", "Site", table))] * 6 + [("copies", page.format(i, "Site", "")) for i in range(10)]
    rows += [("few", page.format(i, "Site", heading if i < 4 else "")) for i in range(40)]
    rows += [("most", page.format("copied", "Site", heading))] * 36 + [("most", page.format(i, "Site", "<h2>Own</h2>")) for i in range(4)]
    bare = "<body><div class=top>{1}</div><p>Text {0}</p></body>"
    rows += [("other", bare.format(i, "Site" if i else "Not the site")) for i in range(20)]
    twice = "<body><article><p>Text {0}</p>{1}</article></body>"
    rows += [("twice", twice.format(i, "<h2>A</h2><p>-</p><h2>A</h2>" * (i < 5))) for i in range(11)]
    pages = spark.createDataFrame([(i, f"http://{h}.example/{i}", t) for i, (h, t) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.page_report(pages).collect()}
    for i, (_, t) in enumerate(rows):
        assert got[i] == " ".join(re.sub("<[^>]*>", " ", t.replace(">Site<", "><")).split())


def test_html_names_switch_off_no_article():
    for page in (
        "<body class='no-sidebar'><article>Text</article></body>",
        "<body class='search'><p>Text</p></body>",
        "<html class=hidden><body class='comments-open'><div id=page class='content has-menu'><p>Text</p></div></body>",
        "<body><div class='widget'><article class='post share'><p>Text</p></article></div></body>",
        "<body><span class='related'><main role=main id=search>Text</main></span></body>",
        "<body><div class='post related-work'>Text</div></body>",
        "<body><div data-id='form' data-class=menu title='?id=search' href=/?id=search>Text</div></body>",
        "<body><div class=post class=ad>Text</div></body>",
        "<body><div class='main-menu'></div><div CLASS='x AD y'>off</div><p>Text</p><div id=comments>off</div><nav><article>off</article></nav></body>",
        "<body><div class='ad'>off</div><div class='ad-2'>Text</div></body>",
    ):
        assert html_extract.Page(page).text(set()) == "Text", page


def test_html_formulas_objects_and_open_controls():
    for page, text in (
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>", "Let x=1 be"),
        ("<article><p>a<object data=f>shown instead</object>b</p></article>", "a shown instead b"),
        ("<article><div><button>off</div><p>a</p><div><select><option>off</div><p>b</p><div><object></div><p>c</p><div><svg><text>off</div><p>d</p></article>", "a b c d"),
        ("<article>a<button>off</button>b<button/>c<svg viewBox='0'/>d<p>e<button><p>off</p><div>off</button>f</p></article>", "abcd e f"),
        ("<article><ul><li>a<select><li>off</select>b</ul><script>off", "a b"),
    ):
        assert " ".join(html_extract.Page(page).text(set()).split()) == text, page


def test_html_deep_and_long_pages(spark):
    """Depth and length don't matter to the parser, the matching or the text."""
    n = 50_000
    pages = [
        (1, "http://h.example/1", "<div>" * n + "deep"),
        (2, "http://h.example/2", "<div>" * (n // 2) + "<p>other"),
        (3, "http://h.example/3", "<ul>" + "<li>a<p>b" * n),
        (4, "http://h.example/4", "<section><div></p></li></td>" * n + "end"),
        (5, "http://h.example/5", "<p>x" * n + "</article>" * n),
    ]
    got = {r.page_id: r.text for r in html_extract.page_report(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "deep", 2: "other", 3: " ".join(["a b"] * n), 4: "end", 5: " ".join(["x"] * n)}


def test_html_wrapper_decides_where_nothing_is_named(spark):
    """Menus, adverts and footers in plain div elements: only their being the same on all pages of the host gives them away."""
    page = "<body><div>Home<div>News</div><div>Shop</div></div><div><h1>T{0}</h1><p>Own {0}</p><p>More {0}</p></div><div>Buy now</div><div>Imprint</div></body>"
    rows = [(i, f"http://{h}.example/{i}", page.format(i)) for i, h in enumerate(["many"] * 8 + ["few"] * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS __he_host", "2 AS __own_1", "3 AS __he_text")
    got = {r.page_id: r.text for r in html_extract.page_report(pages).collect()}
    for i in range(8):
        assert got[i] == f"T{i} Own {i} More {i}"
    assert all(got[i] == f"Home News Shop T{i} Own {i} More {i} Buy now Imprint" for i in (8, 9, 10))
    assert html_extract.main_text(pages).columns == ["page_id", "url", "html", "__he_host", "__own_1", "__he_text"]


def test_html_weak_words_in_articles_need_the_wrapper(spark):
    """A part of an article that is called related or tags stays where it varies, goes where it is constant, and counts on small hosts."""
    page = "<body><div class='related'>Out</div><article><p>Own {0}</p><div class='related'>Work {0}</div><ul class='tags'><li>Same</ul><div class='ad'>Buy {0}</div></article></body>"
    rows = [(i, f"http://{h}.example/{i}", page.format(i)) for i, h in enumerate(["many"] * 8 + ["few"] * 3)]
    got = {r.page_id: r.text for r in html_extract.page_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(11)] == [f"Own {i} Work {i}" if i < 8 else f"Own {i}" for i in range(11)]


def recursive_match(a, b):
    """The weight of simple tree matching straight from its definition, on nested (label, children) trees."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for p, u in enumerate(a[1], 1):
        for q, v in enumerate(b[1], 1):
            m[p][q] = max(m[p - 1][q], m[p][q - 1], m[p - 1][q - 1] + recursive_match(u, v))
    return 1 + m[-1][-1]


def test_tree_matching_is_the_largest():
    r = random.Random(6)

    def tree(depth):
        return (r.choice("ab") if depth else "r", [tree(depth + 1) for _ in range(r.randint(0, 3))] if depth < 4 else [])

    def lines(t, depth=0):
        return [f"{depth} {t[0]}", *[x for c in t[1] for x in lines(c, depth + 1)]]

    for _ in range(500):
        a, b = tree(0), tree(0)
        got = html_extract.tree_match("\n".join(lines(a)), "\n".join(lines(b)))
        assert len(got) == len(set(got.values())) == recursive_match(a, b)


def test_tree_matching_keeps_order():
    assert html_extract.tree_match("0 a\n1 b\n1 c\n2 d", "0 a\n1 c\n2 d\n1 b") == {0: 0, 2: 1, 3: 2}
    assert html_extract.tree_match("0 a", "0 b") == {}


def test_html_on_test_pages(spark, sf_dir):
    """Articles cut out by a plainer reading of the test pages."""
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op2_html_extraction(spark, sf_dir).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br|li|ul|div)\b[^>]*>", " ", inner))).split())


def test_chat_round_trip(spark):
    r = random.Random(2)
    parts = ["### ", "\\", "</turn>", "<\\/turn>", "\n", " ", "### Assistant: ", ": ", "é😀", "a", ":", "#"]
    rows = [(c, t, r.choice(["user", "assistant", "a: b", "x\\: y", "### r", None]), r.choice([None, "".join(r.choice(parts) for _ in range(r.randint(0, 8)))])) for c in range(150) for t in range(r.randint(1, 5))]
    rows += [(0, 0, "user", "a"), (None, 1, "assistant", "b"), (7, 3, "assistant", "\\### Assistant: </turn> ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {x.conv_id: x for x in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{a}\n{b}\n" for _, a, b in turns))
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert chat_format.format_conversations(df.limit(0)).count() == 0


@functools.cache
def fresh_tokenizer():
    """The library as anybody would load it, apart from the operators' own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("special", [False, True])
def test_encoder_equals_library(special):
    e = encoder(default_tokenizer_path())
    r = random.Random(1)
    parts = ["a", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'", "12", "!", "??", "　", "日", "😀", "<|endoftext", "\r\n", "\x0b", " ", "-", "ß", "word.", "|>"]
    parts += ["<|endoftext|>"] * 3 * special
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    want = fresh_tokenizer().encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(a, "<u4").tolist() == b.ids for a, b in zip(e.encode_all(texts), want, strict=True))
    assert not special or any(50256 in b.ids for b in want)


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    data = token_store.pack_bits(ids, bits)
    assert len(data) == (1001 * bits + 7) // 8
    assert (token_store.unpack_bits(data, bits, 0, 1001) == ids).all() and (token_store.unpack_bits(data, bits, 317, 200) == ids[317:517]).all()
    if bits < 32:
        with pytest.raises(ValueError):
            token_store.pack_bits(np.array([1 << bits]), bits)


def library_ids(text, end):
    return [*fresh_tokenizer().encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store(spark, odd_docs, no_docs):
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want, start = [], 0
    for i, t in rows:
        ids = library_ids(t, 2)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted((tuple(x) for x in token_store.store_report(token_store.round_trip(odd_docs)).collect()), key=lambda x: x[1])
    assert got == want
    assert token_store.round_trip(no_docs).count() == 0


def test_packing(spark, odd_docs, no_docs):
    out = packing.pack(odd_docs).collect()
    assert len({x.sequence_id for x in out}) == len(out) and all(x.offset == 0 and x.length & (x.length - 1) == 0 and x.length <= 1024 for x in out)
    whole = defaultdict(int)
    for x in out:
        whole[x.doc_id] += x.length
    assert whole[4] == len(library_ids(next(r.text for r in odd_docs.collect() if r.doc_id == 4), 0)) and whole[2] == 1
    parts = sorted((x for x in out if x.doc_id == 4), key=lambda x: x.start)
    assert crc(np.frombuffer(b"".join(x.ids for x in parts), "<u4")) == crc(library_ids(next(r.text for r in odd_docs.collect() if r.doc_id == 4), 0))
    assert packing.pack(no_docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd_docs, max_len=1000)


def test_special_tokens_in_texts(spark):
    """What the library takes for a special token is one in the files and in the packed pieces too."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n y", "<|endoftext", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.store_report(token_store.round_trip(docs)).collect()}
    packed = defaultdict(list)
    for r in sorted(packing.pack(docs).collect(), key=lambda r: r.start):
        packed[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    for i, t in enumerate(texts):
        assert stored[i] == (len(library_ids(t, 2)), crc(library_ids(t, 2)))
        assert packed[i] == library_ids(t, 0)


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_piece_lengths(n):
    p = packing.piece_lengths(n)
    assert sum(p) == n and p == sorted(p, reverse=True) and len(set(p) - {1024}) == len([x for x in p if x != 1024])


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, kept, sf_dir)
            ids = {r.doc_id for r in out.collect()}
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                kept = out
            # Null, empty and blank texts go first; doc 5 has four words; one of the two rows of doc 1 stays later on.
            assert ids == ({1, None, 4} if docs is odd_docs else set())
        assert out.where("doc_id = 1 AND start = 0").count() == (1 if docs is odd_docs else 0)


def test_pipeline_against_brute_force(spark, sf_dir):
    """Every stage replayed in plain Python on the small table."""
    from test_texts import ascii_lower

    from siftspark.llm.quality_cascade import RULES, judge

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {i: t for i, t in rows.items() if judge(t, RULES)[1] is None}
    count, owner = defaultdict(set), {}
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows.items():
        for x in t.split("\n"):
            count[key(x)].add(i)
    rows = {i: "\n".join(x for x in t.split("\n") if not (len(k := key(x)) >= 20 and len(count[k]) >= 3 and max(count[k]) != i)) for i, t in rows.items()}
    rows = {i: rows[i] for i, _, c, kept in brute_components(list(rows.items())) if kept}
    norm = decontaminate.normalise
    items = [norm(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(sellers(x, norm(t)[max(0, k - 99) : k + len(x) + 99]) <= decontaminate.error_budget(len(x)) for x in items for k in [norm(t).find(x[:12])] if k >= 0)}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
    assert set(got) == set(rows)
    assert all(got[i] == len(library_ids(t, 0)) for i, t in rows.items())
