import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewright.llm import chat, mixing
from casewright.llm.html_text import extract_text, main_text
from casewright.llm.licences import scan_licences
from casewright.llm.token_count import Counter, count_tokens, pieces
from casewright.llm.topk import top_k, threshold_topk

public_tokenizers = pytest.importorskip("public_tokenizers")


# --- token counts


def reference_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


TRICKY = ["", " ", "a", " a  b\n\n c ", "don't  stop", "<|endoftext|> x <|endoftext|>", "x\x1c y\x1d\x1e", "é\u00a0 ü\u2003z", "日本語 テキスト", "a" * 20_000, "\n" * 500 + "x", "tab\t\tend\r\n", "🙂 🙂🙂", " " * 3000]


def test_counts_equal_the_tokenizer(spark):
    rows = list(enumerate([*TRICKY, None])) + [(None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = {r.doc_id: r for r in count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert [got[i].n_tokens for i in range(len(TRICKY))] == reference_counts(TRICKY)
    assert got[len(TRICKY)].n_tokens == 0 == got[len(TRICKY)].n_bytes and got[None].n_tokens == 2
    assert got[9].n_bytes == 20_000 and all(r.over_limit == (r.n_tokens > 1024) for r in got.values())
    assert count_tokens(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB1 '\n\t\u00a0\u2003é.!<|>endoftext日\x1c\x85"), max_size=60), max_size=4))
def test_pieces_never_change_counts(texts):
    assert Counter(public_tokenizers.path("byte_bpe_50k.json")).counts(texts) == reference_counts(texts)
    assert all("".join(pieces(t)) == t for t in texts)


def test_sentence_pieces(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert Counter(path).counts(TRICKY) == [len(model.encode(t)) for t in TRICKY]


# --- exact top-k


def brute_topk(rows, k):
    import math

    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in whole:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_equals_brute_force(spark, monkeypatch):
    import casewright.llm.topk as t

    monkeypatch.setattr(t, "BLOCK", 64)
    rnd = random.Random(1)
    rows = [(i, [round(rnd.gauss(0, 1), 2) for _ in range(6)]) for i in range(450)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(500, None), (600, [float("nan")] * 6), (700, [None] * 6), (800, [1.0, 2.0]), (900, [0.0] * 6), (901, [float("inf")] * 6), (7, rows[7][1]), (1100, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 100 = 0")).collect())
    assert got == brute_topk(rows, 10)
    assert top_k(df.limit(0), df.limit(0)).collect() == []


def test_threshold_stops_early_and_right():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = rng.integers(-50, 50, (3000, 3)).astype(float)
    rows[5] = 400
    lists = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
    q = np.array([1.0, 2.0, -0.0])
    got = threshold_topk(lists, rows, np.arange(3000), q, -1, 3)
    expected = sorted(((-(r @ q), i) for i, r in enumerate(rows)))[:3]
    assert got == [(i, int(-s)) for s, i in expected]


# --- main text


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("<html><body></body></html>", ""), ("plain &amp; text", "plain & text"),
        ("<nav><a href=x>menu</a></nav><article><h1>T</h1><p>a&nbsp; b<br>c<p>d</article><footer>f</footer>", "T\n\na b c\n\nd"),
        ("<script>var t='<p>x</p>'</script><style>p{}</style><!-- c --><p>one &lt;two&gt;</p><noscript>n</noscript>", "one <two>"),
        ("<article><header><h1>H</h1></header><p>Body</p><aside>no</aside><div class='comments'><p>c</p></div></article><div class='cookie-notice'>n</div>", "H\n\nBody"),
        ("<div id=sidebar><p>side</p></div><main><p>text</p><form><p>fill</p></form></main>", "text"),
        ("<article><p><b>unclosed<br><p>next</p></article>", "unclosed\n\nnext"),
    ],
)
def test_main_text(html, expected):
    assert main_text(html) == expected


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<body><form id=aspnetForm><div><p>one text</p><p>two</p></div></form></body>", "one text\n\ntwo"),
        ("<body><form><nav><a href=x>menu</a></nav><article><p>text</p></article></form></body>", "text"),
        ("<article class='post has-comments'><p>text</p></article>", "text"), ("<article class='sponsor'><p>text</p></article>", "text"),
        *((f"<main><p>more</p><div class='{c}'><p>two</p></div></main>", "more\n\ntwo") for c in ("no-sidebar", "with-navigation", "social-policy")),
        ("<body><div class='sidebar'><p>all the text that there is</p></div></body>", "all the text that there is"),
        ("<main><p>text</p><div class='left-sidebar'><p>s</p></div><div id='comment-list'><p>c</p></div><div class='site-footer'>f</div></main>", "text"),
        ("<main><p>text</p></main><div id='comments'><article class='comment-body'><p>c</p></article></div>", "text"),
        ("<article><p>so <math><mi>x</mi><annotation>tex</annotation></math></p><h2><button>Part</button></h2><textarea>code</textarea></article><button>Buy</button>", "so x\n\nPart\n\ncode"),
    ],
)
def test_wrappers_that_hold_the_text(html, expected):
    assert main_text(html) == expected


def test_dense_neighbours_of_the_best_subtree():
    long = lambda c, n: f"{c * 5} " * (n // 6)
    section = "<div>" + "".join(f"<p>{long('s', 500)}</p>" for _ in range(5)) + "</div>"
    got = main_text(f"<body><div><p>{long('a', 700)}</p>{section}<pre>{long('b', 700)}</pre><p>tiny</p></div></body>").split("\n\n")
    assert [g[0] for g in got] == ["a", *"sssss", "b"]
    got = main_text(f"<body>{long('c', 350)}<i>{long('i', 40)}</i>{long('d', 350)}<div>{section}tiny<a href=x>link</a></div>{long('e', 700)}</body>").split("\n\n")
    assert [g[0] for g in got] == ["c", *"sssss", "e"] and "iiiii" in got[0] and "ddddd" in got[0]


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>a</p><![foo[x]]>", "a"), ("<![ <p>q", "q"), ("<p>a</p><!--unclosed <p>b", "a"), ("<!--><p>a</p>", "a"), ("<p>a<!x>b</p></ >", "ab"), ("<p>a</p><?pi <p>b?></p>c", "a\n\nb?>\n\nc"), ("<p>a</p><div class=\"x", "a"), ("a</div", "a"),
        *((f"<article><p>one</p><div class='{c}'><p>a paragraph of its text</p></div></article>", "one\n\na paragraph of its text") for c in ("notice-period", "social-history", "share", "menu-of-the-day")),
        ("<article><p>one</p><div class='share'>on <a href=x>this site</a> and <a href=y>that site</a></div></article>", "one"),
        *((f"<article><p>one</p><{t}><p>two</p></{t}></article>", "one\n\ntwo") for t in ("object", "map")),
        ("<article><p>one <select><option>two</option></select></p></article><select><option>x</option></select>", "one\n\ntwo"),
        ("<div><h1>Site</h1></div><article><h1>T</h1><p>text</p></article>", "T\n\ntext"), ("<div><h1><a href=/>Site</a></h1></div><h1>T</h1><article><p>the text of it</p></article>", "T\n\nthe text of it"),
    ],
)
def test_broken_markup_and_wrongly_named_text(html, expected):
    assert main_text(html) == expected


NAMES_OF_BOXES = ["comment", "menu", "alert", "notice", "red-alert", "banner", "promo", "ad", "disclaimer", "legal-notice", "subscribe", "replies"]


@pytest.mark.parametrize("name", NAMES_OF_BOXES)
def test_named_blocks_of_an_article_are_judged_by_their_text(name):
    one, two, three = "a sentence of the article, as long as any. " * 4, "another that says what follows from it all. " * 4, "and a third one, which ends it. " * 5
    page = lambda inner: f"<body><nav><a href=x>m</a></nav><article><h1>H</h1><p>{one}</p>{inner}</article></body>"
    lines = lambda *texts: "\n\n".join(t.strip() for t in ("H", *texts))
    assert main_text(page(f"<p class='{name}'>{two}</p>")) == lines(one, two)
    assert main_text(page(f"<section class='{name}'><h2>S</h2><p>{two}</p><p>{three}</p></section>")) == lines(one, "S", two, three)
    gone = [
        f"<div class='{name}'>{two[:40]}</div>", f"<p class='{name}'>short words</p>", f"<section class='{name}'><p>short words</p></section>", f"<div class='{name}'><p>short words</p></div>",
        f"<section class='{name}'><p>{two} <a href=x>{two}</a></p></section>", f"<p class='{name}'><a href=x>{two}</a></p>", f"<section class='{name}'><p>{two}</p><form><input name=q><button>Send</button></form></section>",
        f"<section class='{name}'><div class='c'><b>Jo</b> <time>May 1</time><p>{two}</p></div><div class='c'><b>Al</b><p>{three}</p></div></section>",
        f"<section class='{name}'><ul><li><p>{two}</p></li></ul></section>", f"<section class='{name}'><p class='{name}'>{two}</p><p class='{name}'>{three}</p></section>",
        f"<div class='{name}' role='alert'><p>{two}</p></div>", f"<p class='{name}' hidden>{two}</p>",
    ]
    for inner in gone:
        assert main_text(page(inner)) == lines(one), inner
    assert main_text(page(f"<div class='{name}'><p>{two}</p><p>{three}</p></div>")) == (lines(one) if name in ("comment", "ad", "replies") else lines(one, two, three))
    assert main_text(f"<body><section class='{name}'><p>{two}</p></section><article><p>{one}{one}</p></article></body>") == (one + one).strip()


def test_a_thread_of_paragraphs_goes():
    long = "words that a reader left below it. " * 5
    thread = "".join(f"<p class='comment'>{long}{i}</p>" for i in range(3))
    assert main_text(f"<article><p>{long}</p><p>{long}</p>{thread}</article>") == f"{long.strip()}\n\n{long.strip()}"


def plain_own_text(parts):
    """The blocks of an article that stay: a second, plain reading of the rule, over (tag, named, linked, paragraphs)."""
    plain = [len(p) for tag, named, linked, ps in parts if not named for p in ps]
    mean, whole = sum(plain) / len(plain) if plain else 0, sum(len(p) for *_, ps in parts for p in ps)
    kept = []
    for tag, named, linked, ps in parts:
        size = sum(map(len, ps))
        if not named or not linked and (tag == "div" and named == "notice" and size >= whole / 4 or tag != "div" and size / len(ps) >= mean / 2):
            kept += ps
    return "\n\n".join(kept)


def test_blocks_that_stay_equal_a_plain_reading_on_random_articles():
    rnd, told = random.Random(12), 0
    for _ in range(400):
        parts = [("p", "", False, ["w" * rnd.randint(30, 90)]) for _ in range(rnd.randint(1, 4))]
        seen = False  # one paragraph of "ad": more are a thread
        for _ in range(rnd.randint(0, 4)):
            tag, named = rnd.choice(["p", "section", "div"]), rnd.choice(["notice", "ad", ""])
            if tag == "p" and named == "ad":
                if seen:
                    continue
                seen = True
            parts.insert(rnd.randrange(len(parts) + 1), (tag, named, bool(named) and rnd.random() < 0.3, ["w" * rnd.randint(5, 90) for _ in range(1 if tag == "p" else rnd.randint(1, 3))]))
        html = ""
        for tag, named, linked, ps in parts:
            inner = [f"<a href=x>{p}</a>" if linked else p for p in ps]
            html += f"<{tag} class='{named}'>" + (inner[0] if tag == "p" else "".join(f"<p>{p}</p>" for p in inner)) + f"</{tag}>"
        assert main_text(f"<article>{html}</article>") == plain_own_text(parts), html
        told += any(named for _, named, *_ in parts)
    assert told > 200


PARTS = ["<p>", "</p>", "<div class='ad'>", "</div>", "<![CDATA[", "]]>", "<!--", "-->", "<!", "<?", "</", "<", ">", "<a href=\"", "\"", "'", "&amp;", "&#x;", "&#1114112;", "<script>", "</script>", "<table><td>", "<article>", "</article>", "text ", "\x00", "<svg/>", "<![if x", "<br>", "<h1>", "="]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40))
def test_no_page_stops_the_job(parts):
    got = main_text("".join(parts))
    assert isinstance(got, str) and all(b and b == " ".join(b.split()) for b in got.split("\n\n") if got)


@pytest.mark.parametrize("seed", range(12))
def test_densities_equal_brute_force(seed):
    """Random trees, counted by recursion over nested lists, and the subtree of the greatest sum by comparing all."""
    import math

    from casewright.llm.html_text import Tree, densities

    rnd = random.Random(seed)

    def make(depth):
        tag = rnd.choice(["div", "section", "p", "a", "b"] if depth else ["b", "i", "a"])
        inside = [make(depth - 1) if depth and rnd.random() < 0.6 else "w" * rnd.randint(1, 40) for _ in range(rnd.randint(1, 5))]
        return (tag if tag != "p" or all(isinstance(x, str) for x in inside) else "div", inside)

    html = lambda x: x if isinstance(x, str) else f"<{x[0]}>" + "".join(map(html, x[1])) + f"</{x[0]}>"
    page = ("body", [("div", [make(3) for _ in range(4)]), ("div", [make(2)])])

    def count(x, linked=False):
        """chars, tags below, linked chars, links below"""
        out = [0, 0, 0, 0]
        for y in x[1]:
            here = linked or x[0] == "a"
            got = (len(y), 0, len(y) * here, 0) if isinstance(y, str) else count(y, here)
            out = [a + b for a, b in zip(out, got)]
            if not isinstance(y, str):
                out[1] += 1
                out[3] += y[0] == "a"
        return out

    c, _, lc, _ = count(page)
    share, expected = lc / c, []

    def visit(x, linked=False):
        """own densities and sums of children, in page order"""
        n, t, links, tags = count(x, linked)
        below = linked or x[0] == "a"
        own = n / max(t, 1) * math.log(max(n / max(links, 1) * max(t, 1) / max(tags, 1), 1)) / max(math.log(math.log(n / max(n - links, 1) * links + share * n + math.e)), 0.1)
        at = len(expected)
        expected.append(None)
        children = [visit(y, below) for y in x[1] if not isinstance(y, str)]
        expected[at] = (own, sum(children) if children else own)
        return own

    tree = Tree(html(page))
    if [t for t in tree.tag[1:]] != [t for t in __import__("re").findall(r"<(\w+)>", html(page))]:
        pytest.skip("the parser closes elements of this tree")
    visit(page)
    own, total, _, got_share = densities(tree, [False] * len(tree.tag))
    assert got_share == pytest.approx(share)
    assert own[1:] == pytest.approx([e[0] for e in expected]) and total[1:] == pytest.approx([e[1] for e in expected])


def test_very_long_page():
    many = "".join(f"<p>{'word ' * 20}{i}</p>" for i in range(20_000))
    assert main_text(f"<nav><a href=x>m</a></nav><div>{many}</div><footer>f</footer>").count("\n\n") == 19_999


def test_pages_of_the_tables_shape(spark):
    rnd = random.Random(2)
    rows, expected = [], {}
    for i in range(60):
        words = lambda n: " ".join(rnd.choice(["aa", "bé", "c&amp;d", "x,"]) for _ in range(n))
        paragraphs = [words(rnd.randint(1, 60)) for _ in range(rnd.randint(1, 8))]
        links = "".join(f'<li><a href="/{n}">{words(1)}</a></li>' for n in range(6))
        head = f'<html><head><title>{words(5)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{links}</ul></nav><div class="ad">{words(9)}</div>'
        rows.append((i, f"http://h{i}", head + f"<article><h1>{paragraphs[0]}</h1>" + "".join(f"<p>\n {p}\n</p>" for p in paragraphs[1:]) + f"</article><footer>{words(8)}</footer>" + ("</body></html>" if i % 2 else "")))
        expected[i] = "\n\n".join(paragraphs).replace("&amp;", "&")
    rows += [(None, None, None), (99, "u", "<div>" * 2000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in extract_text(df).collect()}
    assert {i: got[i].text for i in expected} == expected and got[None].text == "" and got[99].text == "deep"
    assert all(r.n_chars == len(r.text) for r in got.values()) and extract_text(df.limit(0)).collect() == []


# --- mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free} if free else {}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | capped
        capped |= over


def mix_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    return df, mixing.mixed_words(df).collect()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixture(spark, seed):
    rnd = random.Random(seed)
    names = ["a", "B", "é", "zz", None, "tiny", "😀"]
    heavy = [100, 3, 5, 2, 8, 1, 4]
    rows = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 5, 40, 900]))), rnd.choices(names, heavy)[0]) for i in range(400)]
    rows += [(1000, None, "a"), (2000, "same id", "a"), (2000, "same id", "a"), (None, "no id", None), (1001, "only\tone\u00a0word", "alone"), (1002, "", "empty")]
    df, got = mix_rows(spark, rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    target, source = brute_targets(sizes), {i: s for i, _, s in rows}
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(sizes.values())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        assert r.target == pytest.approx(target[next(s for s in sizes if sizes[s] == r.source_size and abs(target[s] - r.target) < 1e-6)])
        by[source[r.doc_id]] = by.get(source[r.doc_id], 0) + r.taken
    for s, n in by.items():
        assert abs(n - target[s]) <= max(20, 0.02 * target[s] + 6), s
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mixed_words(df.repartition(7)).collect()))


def test_slots_do_not_overlap_and_spread(spark):
    rows = [(i, "w " * 50, "ab"[i % 2]) for i in range(40)]
    df, _ = mix_rows(spark, rows)
    placed, mix = mixing.mixture(df)
    got = mix.collect()
    first = {}
    for r in got:
        assert first.setdefault(r.slot, r.source_no) == r.source_no
    order = [first[k] for k in sorted(first)]
    for at in range(0, len(order) - 30, 30):
        share = order[at : at + 30].count(2) / 30
        assert abs(share - 2 / 3) < 0.15
    assert mixing.mixed_words(df.limit(0)).collect() == []


# --- chat


TEXTS = ["", "ok", "</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<\\s>", "<s>", "[TURN]\n[/TURN]", " [/INST]", "[/SYS", "\\n", "é🙂\n"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "to\\ol\n[TURN]", "[INST] "]), st.one_of(st.sampled_from(TEXTS), st.text(alphabet="\\<>s/[]INTURSYn \n", max_size=30))), max_size=8))
def test_turns_come_back(turns):
    whole = "".join(chat.format_turn(r, t) for r, t in turns)
    assert list(chat.read_turns(whole)) == turns
    assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROL)


def test_digests(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice([*TEXTS, None])) for c in range(20) for t in range(rnd.randint(1, 40))]
    rows += [(50, 0, "user", "x"), (50, 0, "user", "x"), (50, 0, "assistant", "y"), (None, 1, "user", "n"), (60, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1))
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.format_turn(r[2] or "", r[3] or "")) for r in own)
    assert chat.chat_digests(df.limit(0)).collect() == []


def test_best_branches_of_trees(spark):
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 2, 0.5), (2, 1, None, 0.0), (2, 2, 1, 1.0), (2, 3, 1, 1.0), (3, 7, 99, 2.0), (4, 1, 2, 0.0), (4, 2, 1, 0.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    walk = {}
    for r in chat.reply_paths(df, branches=2).collect():
        walk.setdefault((r.tree, r["rank"]), []).append(r.node)
    assert {k: sorted(v) for k, v in walk.items()} == {(1, 1): [1, 2, 4], (1, 2): [1, 3], (2, 1): [1, 2], (2, 2): [1, 3], (3, 1): [7]}


# --- licences


def test_licences(spark):
    apache, mit, gpl = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, f"prose here and there\n{apache}\nmore prose", "p/a/x.py"), (2, mit, "p/LICENSE"), (3, "nothing at all", "p/a/b/y.py"), (4, f"many words before it all\n{gpl}", "p/a/COPYING"), (5, "plain", "q/z.py"), (6, None, "p/n.py"), (7, "", None),
        (8, "Permission is hereby given to read this license of mine in the version you like under the tree", "q/w.py"), (5, "plain", "q/z.py"), (9, "plain", "p"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string").withColumn("licence", F.lit("clash"))
    got = scan_licences(df, F.col("place")).collect()
    found = {(r.doc_id, r.licence, r.inherited_from) for r in got}
    assert len(got) == len(rows) and found == {(1, "Apache-2.0", None), (2, "MIT", None), (3, "GPL-3.0", "p/a"), (4, "GPL-3.0", None), (5, None, None), (6, "MIT", "p"), (7, None, None), (8, None, None), (9, None, None)}
    assert {r.doc_id for r in got if r.is_licence_file} == {2, 4} and {r.doc_id: r.line for r in got}[1] == 1
    assert scan_licences(df.limit(0), F.col("place")).collect() == []


def test_gate_loses_no_licence():
    from casewright.llm.licences import TEMPLATES, SIMILAR, Scanner, terms_of, vocabulary

    rnd = random.Random(3)
    s = Scanner(1000, {t: rnd.randint(0, 900) for t in vocabulary()})
    words = vocabulary()
    for _ in range(3000):
        own = terms_of(rnd.choice(rnd.choice(list(TEMPLATES.values()))))
        terms = rnd.sample(own, rnd.randint(1, len(own))) + rnd.sample(words, rnd.randint(0, 2))
        v = s.unit(terms)
        best = max(sum(x * v.get(t, 0.0) for t, x in template.items()) for _, template in s.templates)
        if best >= SIMILAR:
            assert s.best(terms) == pytest.approx(min(best, 1.0))


def test_wrapped_embedded_and_complete_licences(spark):
    from casewright.llm.licences import TEMPLATES, complete_texts

    rnd = random.Random(5)
    prose = lambda n: " ".join("".join(rnd.choice("aeioulmnrst") for _ in range(6)) for _ in range(n))
    header = "\n".join([
        "# This program is free software: you can redistribute it and/or modify", "# it under the terms of the GNU General Public License as published by",
        "# the Free Software Foundation, either version 3 of the License, or", "# (at your option) any later version.",
    ])
    texts = {f"file {name}": (name, text, None) for name, text in complete_texts().items()}
    texts["MIT with holder"] = ("MIT", complete_texts()["MIT"].replace("<year> <copyright holders>", "2024 A. Writer and others"), None)
    texts["header"] = ("GPL-3.0", f"{prose(40)}\n{header}\n{prose(60)}", 1)
    texts["opening"] = ("MIT", f"{prose(30)}\n\n" + TEMPLATES["MIT"][2].replace(" obtaining", "\nobtaining").replace(" files,", "\nfiles,") + f"\n{prose(30)}", 2)
    texts["paragraph"] = ("MIT", f"{prose(20)}\n{prose(15)} Released under the MIT License. {prose(15)}", 1)
    texts["none"] = (None, f"{prose(30)} all rights of the reader, {prose(30)}", None)
    rows = [(i, text, f"d{i}/{i}") for i, (_, text, _) in enumerate(texts.values())] + [(1000 + i, f"{prose(40)} all the terms, under rights of a version", "x/y") for i in range(60)]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string, place string"), F.col("place")).collect()}
    for i, (kind, (licence, _, line)) in enumerate(texts.items()):
        assert (got[i].licence, got[i].line) == (licence, line), kind
        assert got[i].is_licence_file == (kind.startswith(("file", "MIT with"))), kind
    assert all(got[1000 + i].licence is None for i in range(60))


def test_cosines_and_inheritance_equal_brute_force(spark):
    import math
    from collections import Counter

    from casewright.llm.licences import LICENCE_NAME, NAMES, SHORT, SIMILAR, TEMPLATES, complete_texts, family, kinds, terms_of, versions

    import re

    rnd = random.Random(8)
    wordings = [(name, w) for name, ws in TEMPLATES.items() for w in ws]
    rows = []
    for i in range(160):
        name, w = rnd.choice(wordings)
        own = w.split()
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(len(own))] = rnd.choice(["other", "words", "here"])
        text = " ".join(own) if rnd.random() < 0.5 else " ".join(rnd.choice(["plain", "prose", "the", "of", "license"]) for _ in range(rnd.randint(0, 30)))
        parts = [rnd.choice("ab") for _ in range(rnd.randint(0, 3))] + [rnd.choice(["LICENSE", "copying.txt", f"f{i}.py"])]
        rows.append((i, text, "/".join(parts)))
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string, place string"), F.col("place")).collect()}
    having = Counter(t for _, text, _ in rows for t in set(terms_of(text)))
    known = {t for _, w in wordings for t in terms_of(w)}
    idf = lambda t: math.log((len(rows) + 1) / (having[t] + 1)) + 1

    def unit(terms):
        v = {t: (1 + math.log(n)) * (idf(t) if t in known or t in vocabulary_ else math.log(len(rows) + 1) + 1) for t, n in Counter(terms).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    from casewright.llm.licences import vocabulary

    vocabulary_ = set(vocabulary())
    whole = {}
    for i, text, _ in rows:
        v = unit(terms_of(text)) if terms_of(text) else {}
        whole[i] = max((sum(x * v.get(t, 0) for t, x in unit(terms_of(w)).items()) for _, w in wordings), default=0)
        # the licence itself: of all runs of a wording's length and the whole (one line), the one that says most
        terms, found = terms_of(text), []
        for n, (name, w) in enumerate(wordings):
            own, u = terms_of(w), unit(terms_of(w))
            weight = math.sqrt(sum(((1 + math.log(c)) * idf(t)) ** 2 for t, c in Counter(own).items()))
            spans = {(at, at + len(own)): False for at in range(len(terms) - len(own) + 1)} | {(0, len(terms)): True}
            for (a, b), all_of_it in spans.items():
                part = terms[a:b]
                x = sum(y * unit(part).get(t, 0) for t, y in u.items()) if part else 0
                most = max(map(idf, own))
                if x < SIMILAR - 1e-9 or not all_of_it and len(own) < SHORT and not any(t in part for t in own if idf(t) >= most - 1e-12):
                    continue
                if any(t in NAMES and t not in part for t in own) or "spdx-license-identifier" in own and set(own) - set(part):
                    continue
                exact = kinds(own) == kinds(part) and versions(own) <= versions(part)
                called = name if exact or "spdx-license-identifier" in own else family(name, part)
                if name == "BSD-3-Clause" and "redistribution" in own:
                    called, exact = "BSD", False  # no clauses follow here
                found.append((name != "Proprietary", exact or "spdx-license-identifier" in own, round(x * weight, 9), round(x, 9), -n, called, x))
        if whole[i] < SIMILAR or not any(unit(terms_of(t)) and sum(x * v.get(k, 0) for k, x in unit(terms_of(t)).items()) >= SIMILAR for t in complete_texts().values()):
            own_licence = got[i].licence if got[i].inherited_from is None else None
            assert own_licence == (max(found)[5] if found else None), text
            assert not found or got[i].cosine == pytest.approx(min(max(found)[6], 1.0))
    # each row's own licence is what was found; who licenses a directory, and who inherits, follows from paths alone
    files = {}
    for i, _, path in rows:
        r, folder = got[i], path.rpartition("/")[0]
        own = r.licence is not None and r.inherited_from is None
        assert r.is_licence_file == (own and (whole[i] >= SIMILAR or re.match(LICENCE_NAME, path.rpartition("/")[2]) is not None))
        if r.is_licence_file:
            files.setdefault(folder, []).append((-r.cosine, path, r.licence))
    inherited = 0
    for i, _, path in rows:
        r = got[i]
        if r.licence is not None and r.inherited_from is None:
            continue
        parts = path.split("/")[:-1]
        above = next(("/".join(parts[:n]) for n in range(len(parts), -1, -1) if "/".join(parts[:n]) in files), None)
        assert r.inherited_from == above and r.licence == (min(files[above])[2] if above is not None else None)
        inherited += above is not None
    assert inherited > 10


GPL = "This {0} is free software; you can redistribute it and/or modify\nit under the terms of the GNU {1} as published by\nthe Free Software Foundation; either version {2} of the License, or\n(at your option) any later version."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0"
HELD = "Copyright (C) 2011-2019 A. Writer <a@b.example>. All rights reserved.\n"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n1. Redistributions of source code must retain the above copyright\n   notice.\n2. Redistributions in binary form must reproduce it.\n"
THIRD, AS_IS = "3. Neither the name of the author nor of others may be used to endorse.\n", "THIS SOFTWARE IS PROVIDED BY THE AUTHOR AS IS"
HEADERS = [
    (GPL.format("program", "General Public License", "2"), "GPL-2.0"), (HELD + GPL.format("program", "General Public License", "2"), "GPL-2.0"),
    (GPL.format("file", "General Public License", "2"), "GPL-2.0"), (GPL.format("program", "General Public License", "3"), "GPL-3.0"),
    (HELD + GPL.format("program", "General Public License", "3"), "GPL-3.0"), (GPL.format("library", "Lesser General Public License", "2.1"), "LGPL-2.1"),
    (HELD + GPL.format("library", "Lesser General Public License", "2.1"), "LGPL-2.1"), (GPL.format("library", "Lesser General Public License", "3"), "LGPL-3.0"),
    (GPL.format("program", "Affero General Public License", "3"), "AGPL-3.0"), (GPL.format("program", "General Public License", "1"), "GPL"),
    (GPL.format("library", "Library General Public License", "2"), "LGPL"), ("# This work is licensed under the GNU General Public License.", "GPL"),
    (HELD + BSD + AS_IS, "BSD-2-Clause"), (BSD + AS_IS, "BSD-2-Clause"), (HELD + BSD + THIRD + AS_IS, "BSD-3-Clause"), (BSD + THIRD + AS_IS, "BSD-3-Clause"),
    (HELD + BSD.split("1. ")[0], "BSD"), (HELD + APACHE, "Apache-2.0"), (APACHE, "Apache-2.0"), (APACHE.replace("2.0", "1.1"), "Apache"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttp://www.eclipse.org/legal/epl-2.0.", "EPL-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed", "MPL-2.0"),
    ("The contents of this Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1", "MPL"),
    ("// SPDX-License-Identifier: MIT", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    (HELD + "Use of this source code is governed by what we say. Released under the MIT License.", "MIT"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"), (HELD, "Proprietary"), ("Released under the Foo License.", None), ("All of the rights of readers.", None),
]


def test_headers_are_named_as_they_say(spark):
    rnd = random.Random(6)
    prose = lambda n: " ".join("".join(rnd.choice("aeioulmnrst") for _ in range(6)) for _ in range(n))
    comment = lambda text, mark: "\n".join(mark + line for line in text.split("\n"))
    rows, want = [(10_000 + i, prose(50), "z") for i in range(300)], {}
    for text, licence in HEADERS:
        for form in (text, comment(text, " * ") + "\n" + prose(80), prose(30) + "\n" + comment(text, "# ") + "\n\n" + prose(30)):
            want[len(want)] = (licence, text)
            rows.append((len(want) - 1, form, f"{len(want)}/x"))
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string, place string"), F.col("place")).collect()}
    wrong = [(licence, got[i].licence, text[:60]) for i, (licence, text) in want.items() if got[i].licence != licence]
    assert not wrong, wrong
    assert all(got[i].licence is None for i in range(10_000, 10_300))


def test_very_long_texts_of_every_kind(spark):
    long = "word " * 300_000
    rows = [(1, long + "\nReleased under the MIT License.", "a/b"), (2, "short", "a/c")]
    got = {r.doc_id: r.licence for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string, place string"), F.col("place")).collect()}
    assert got == {1: "MIT", 2: None}
    mixed = mixing.mixed_words(spark.createDataFrame([(1, long, "s"), (2, "a b", "s"), (3, "c", "t")], "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.size for r in mixed} == {1: 300_000, 2: 2, 3: 1} and all(r.taken <= 3 * r.size for r in mixed)
    said = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r = chat.chat_digests(said).first()
    assert r.loss_chars == len(long) and r.n_turns == 2


def test_topk_with_a_first_block(spark, monkeypatch):
    import casewright.llm.topk as t

    monkeypatch.setattr(t, "BLOCK", 100)
    monkeypatch.setattr(t, "FIRST", 90)
    rnd = random.Random(4)
    rows = [(i, [float(rnd.randint(-3, 3)) for _ in range(4)]) for i in range(700)]  # with many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 100 = 0")).collect())
    assert got == brute_topk(rows, 10)
    few = df.limit(3)
    assert len(top_k(few, few.where("vec_id = 0")).collect()) == 2
