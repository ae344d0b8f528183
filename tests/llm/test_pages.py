import itertools
import math
import random
import time

from quire.llm import pages as P


def test_marginals_against_all_states():
    model = P.train(P.labelled_pages(60))
    source = "<body><nav><a href=x>a b</a></nav><div class=content><p>One two three.<p>Four<div class=ad>Buy.</div></div></body>"
    tree = P.parse(source)
    shown, n = P.evidence(tree), len(tree.tag)
    assert n <= 14
    total, yes = 0.0, [0.0] * n
    for states in itertools.product((0, 1), repeat=n):
        w = 1.0
        for i, y in enumerate(states):
            w *= math.exp(sum(model.own.get(f, 0) for f in shown[i])) if y else 1
            if i:
                w *= model.child[P.kind_of(tree.tag[i])][states[tree.parent[i]]][y]
        total += w
        for i, y in enumerate(states):
            yes[i] += w * y
    assert all(abs(a - b / total) < 1e-6 for a, b in zip(model.marginals(tree), yes))


def test_held_out_pages():
    model = P.train(P.labelled_pages())
    right = wrong = 0
    for i in range(150):
        tree, labels = P.labelled(P.page(random.Random(-1 - i)))
        for text, y, p in zip(tree.text, labels, model.marginals(tree)):
            if text:
                right, wrong = right + len(text) * ((p > 0.5) == y), wrong + len(text) * ((p > 0.5) != y)
    assert right / (right + wrong) > 0.97


def test_cases(spark):
    cases = {
        1: ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Title here</h1><p><b>First  &amp; fine\nline.<br><p>Second one is longer, said the author.</article><footer>&copy; x</footer>', "Title here\n\nFirst & fine line.\n\nSecond one is longer, said the author."),
        2: (None, ""),
        3: ("", ""),
        4: ("<article><p>Words in the article go on and on.</p><p>Cut off <b", "Words in the article go on and on.\n\nCut off"),
        5: ("<article>" + "<p>A sentence that goes on for a while, as they do.</p>" * 20000 + "</article>", "\n\n".join(["A sentence that goes on for a while, as they do."] * 20000)),
        6: ("<article><p>One here is a sentence.</p><div class='comments'><p>I disagree with that.</p></div><form>Mail <input></form></article>", "One here is a sentence."),
    }
    df = spark.createDataFrame([(k, "u", v[0], 1) for k, v in cases.items()], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in P.extract(df).collect()}
    assert {k: r.text for k, r in got.items()} == {k: v[1] for k, v in cases.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert P.extract(df.limit(0)).count() == 0


def test_short_plain_and_table_pages(spark):
    cases = {
        1: ("<article><p>Yes.</p></article><footer>Copyright 2020 Example Inc. All rights reserved.</footer>", "Yes."),
        2: ("Just text, no markup at all, that goes on for a little while.", "Just text, no markup at all, that goes on for a little while."),
        3: ("<nav><a href=1>Home</a></nav><article><h1>Title of it</h1><p>First paragraph, long enough.</p><details><summary>More on this</summary><p>Folded, but still a part of the article.</p></details><p>The end of it.</p></article>", "Title of it\n\nFirst paragraph, long enough.\n\nMore on this\n\nFolded, but still a part of the article.\n\nThe end of it."),
        4: ("<table><tr><td><a href=1>Home</a> <a href=2>News</a></td><td><h1>The title</h1><p>The article stands in the second cell, and it is long enough.</p><p>There is another paragraph.</p></td></tr></table>", "The title\n\nThe article stands in the second cell, and it is long enough.\n\nThere is another paragraph."),
        5: ("<body>Plain<br>lines<br>of a poem</body>", "Plain lines of a poem"),
        6: ("<h1>Only a title</h1>", "Only a title"),
        7: ("<nav><a href=1>Home</a><a href=2>News</a></nav>", ""),
        8: ("<article><table><tr><td>One</td><td>1</td></tr><tr><td>Two</td><td>2</td></tr></table></article>", "One 1\n\nTwo 2"),
    }
    df = spark.createDataFrame([(k, "u", v[0]) for k, v in cases.items()] * 2, "page_id long, url string, html string")
    got = P.extract(df).collect()
    assert len(got) == 2 * len(cases) and {r.page_id: r.text for r in got} == {k: v[1] for k, v in cases.items()}


def test_deep_tree():
    model = P.train(P.labelled_pages(50))
    P.main_text(model, "<div>" * 30000 + "<p>Deep down.")


def test_hidden_is_an_attribute_of_its_own():
    for attrs in (' title="The hidden valley"', ' href="/x" title="a hidden gem"', ' data-title="Our hidden history"', ' class="menu hidden md:block"', " data-x='display: none'", ' title="aria-hidden=true"', ' title="left hidden'):
        assert not P.hidden(attrs), attrs
        if attrs.count('"') % 2 == 0:
            assert "Words" in P.parse(f"<section{attrs}>Words</section>").text, attrs
    for attrs in (" hidden", " HIDDEN=''", ' class="a" hidden="until-found"', " aria-hidden=true", ' aria-hidden = "True"', ' style="color:red; DISPLAY : none"', " hidden/", " id=x\nhidden"):
        assert P.hidden(attrs), attrs
        assert "Words" not in P.parse(f"<section{attrs}>Words</section>").text, attrs
    assert not P.hidden(' aria-hidden="false" style="display:block"')


def test_broken_markup_takes_linear_time():
    n = 1 << 20
    forms = ["<button>", "<!--", "<!-- x -->", "<a t=\"'>", "<a t='", '<p class="x', "<b", "<", "&", "</nav>", "<x hidden>", "<select><option>", "<li><ul>", "<dt><div>", "<a ", "<![", "</ ", "<div hidden", "<p style='"]
    pages = [f * (n // len(f)) for f in forms]
    pages += ["<div>" * (n // 11) + "</nav>" * (n // 11), "<li><ul>" + "<div>" * (n // 20) + "<li></li>" * (n // 20), "".join(f"<x{i} hidden>" for i in range(n // 14)), "<article>" + "<!--" * (n // 4) + ">", "<p>" * (n // 8) + '"' * (n // 8) + ">", "<p a=" + " " * n + ">"]
    for page in pages:
        began = time.process_time()
        P.parse(page)
        assert time.process_time() - began < 4, page[:40]


def test_all_words_of_a_class_count_and_formulas_stay(spark):
    many = " ".join(f"u{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(40))
    html = f"<article><p>One here is a sentence.</p><p>So <math>a + b</math> it is, she said.</p><div class='{many} comments'><p>I disagree with that.</p></div></article>"
    rows = [(1, "u", html), (1, "u", html), (None, None, html)]
    got = P.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["One here is a sentence.\n\nSo a + b it is, she said."] * 3
