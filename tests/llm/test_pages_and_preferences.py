"""Main text of pages and preference segments, on hand-made pages and sessions."""

from __future__ import annotations

import pytest
from conftest import got

from tagspark.llm import page_text as T
from tagspark.llm import preferences as P

PAGES = "page_id bigint, url string, html string, row int, host string, runs string"


def pages(spark, *rows):
    return spark.createDataFrame([(*r, 1, "h", "r") for r in rows], PAGES)


def texts(df, **more):
    return {r["page_id"]: r["text"] for r in T.page_texts(df, **more).collect()}


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<p>a<p>b", "a b"),
        ("<p>one<b>two</b> three<br>four", "onetwo three four"),
        ("<h1>T&eacute;&amp;&#x41;</h1> x &lt;y&gt; &nope; &amp", "Té&A x <y> &nope; &"),
        ("<article><p> a \n\t b </p></article>", "a b"),
        ("<header>h</header><nav>n</nav><main><header><h1>t</h1></header>x</main><footer>f</footer>", "t x"),
        ("<body>text<script>var t='</p>';</script><style>p{}</style><!-- c --><noscript>n</noscript></body>", "text"),
        ("<div class='side-bar cookie-notice'>c</div>kept<div id=sidebar>s</div><div role=navigation>n</div>", "kept"),
        ("<article>a</article><section class=comments><article>reader</article></section>", "a"),
        ("<article class='post ad-free'>a</article><article class='reader-comment'>c</article>", "a"),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", "x y 1 2 3"),
        ("<form>f</form><aside>s</aside><div hidden>h</div><div style='display: none'>d</div>", ""),
        ("", ""),
        ("a < b & c", "a < b & c"),
        ("<p>un<span>closed", "unclosed"),
        ("<div>" * 3_000 + "deep", "deep"),
    ],
)
def test_main_text_of_one_page(spark, html, wanted):
    found = T.page_texts(pages(spark, (1, "http://h/x", html))).first()
    assert (found["text"], found["n_chars"]) == (wanted, len(wanted))


def test_what_a_host_repeats_is_deleted(spark):
    rows = []
    for i in range(6):
        own = f"<article><p>shared line</p><p>own {i}</p><div>tell your friends</div></article>"
        rows.append((i, f"http://WWW.Site.org:80/{i}", f"<div>our shop</div><section><b>top</b></section>{own}<div>bottom {i}</div>"))
    rows += [(10 + i, f"//other.org/{i}", f"<div>our shop</div><div>page {i}</div><div>page {i}</div>") for i in range(2)]
    rows += [(20 + i, "https://plain.org", f"<div>menu</div><div>words {i}</div>") for i in range(4)]
    rows += [(30 + i, None, "<div>menu</div><div>no host</div>") for i in range(5)]
    found = texts(pages(spark, *rows).repartition(3))
    assert {found[i] for i in range(6)} == {f"shared line own {i}" for i in range(6)}
    assert found[10] == "our shop page 0 page 0" and found[11] == "our shop page 1 page 1"
    assert found[20] == "words 0" and found[23] == "words 3"
    assert found[30] == "menu no host"
    rare = [(i, "http://big.org/", "<div>note</div>x" if i < 4 else f"<div>{i}</div>x") for i in range(40)]
    assert texts(pages(spark, *rare))[0] == "note x"  # on four pages of forty
    assert texts(pages(spark, *rare), min_share=0.05)[0] == "x"


def test_odd_pages(spark):
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    rows = [(1, "http://a/", None), (None, None, None), (2, None, "<p>x"), (2, None, "<p>x"), (3, "no url", long)]
    found = got(T.page_texts(pages(spark, *rows)), "page_id", "url", "n_chars")
    assert found == sorted([(1, "http://a/", 0), (None, None, 0), (2, None, 1), (2, None, 1), (3, "no url", 5 * 50_000 - 1)], key=repr)
    assert T.page_texts(pages(spark, (1, "a", "b")).limit(0)).collect() == []


TURNS = "session_id bigint, seq bigint, role string, text string, part string, start int"


def turns(spark, *rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], TURNS)


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "pair_id bigint, chosen_session bigint, rejected_session bigint")


def assembled(df):
    """Text of each part, and the trained stretches of it."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["pair_id"], r["part"], r["start"])):
        text, loss = out.get((r["pair_id"], r["part"]), ("", []))
        assert r["start"] == len(text) and r["n_chars"] == len(r["rendered"])
        text += r["rendered"]
        out[r["pair_id"], r["part"]] = text, loss + ([text[r["loss_start"] : r["loss_end"]]] if r["loss_start"] is not None else [])
    return out


def test_common_turns_are_the_prompt_and_the_rest_two_masked_completions(spark):
    both = [(s, k, role, text) for s in (1, 2) for k, (role, text) in enumerate([("user", "tag this"), ("assistant", "ok"), ("user", "more")])]
    rows = [*both, (1, 3, "assistant", "gööd"), (1, 4, "user", "thanks"), (2, 3, "assistant", "bad"), (3, 0, "user", "alone")]
    found = assembled(P.preference_segments(turns(spark, *rows), pairs(spark, (7, 1, 2))))
    assert found == {
        (7, "prompt"): ("<|user|>\ntag this<|end|>\n<|assistant|>\nok<|end|>\n<|user|>\nmore<|end|>\n", []),
        (7, "chosen"): ("<|assistant|>\ngööd<|end|>\n<|user|>\nthanks<|end|>\n", ["gööd<|end|>\n"]),
        (7, "rejected"): ("<|assistant|>\nbad<|end|>\n", ["bad<|end|>\n"]),
    }


def test_odd_sessions(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 2, None, None), (1, None, "assistant", "late"),
        (2, 0, "user", "a"), (2, 2, None, ""), (None, 0, "user", "x"),
        (4, 0, "user", "b"), (4, 0, "system", "s"), (5, 0, "system", "s"), (5, 0, "user", "b"),
    ]
    given = pairs(spark, (1, 1, 2), (1, 1, 2), (2, 1, 9), (3, 4, 5), (None, 1, 2), (4, None, None))
    found = assembled(P.preference_segments(turns(spark, *rows), given))
    assert found == {
        (1, "prompt"): ("<|user|>\na<|end|>\n", []),
        (1, "chosen"): ("<||>\n<|end|>\n<|assistant|>\nlate<|end|>\n", ["late<|end|>\n"]),
        (1, "rejected"): ("<||>\n<|end|>\n", []),
        (2, "chosen"): ("<|user|>\na<|end|>\n<||>\n<|end|>\n<|assistant|>\nlate<|end|>\n", ["late<|end|>\n"]),
        (3, "prompt"): ("<|system|>\ns<|end|>\n<|user|>\nb<|end|>\n", []),
    }
    assert P.preference_segments(turns(spark, *rows).limit(0), given).collect() == []
    assert P.preference_segments(turns(spark, *rows), given.limit(0)).collect() == []


def test_a_long_session_is_compared_turn_by_turn(spark):
    rows = [(s, k, "user" if k % 2 == 0 else "assistant", f"{k if k < 900 or s == 1 else -k}") for s in (1, 2) for k in range(1_000)]
    df = P.preference_segments(turns(spark, *rows), pairs(spark, (1, 1, 2)))
    assert got(df.groupBy("part").count()) == [("chosen", 100), ("prompt", 900), ("rejected", 100)]
    assert len(assembled(df)[1, "chosen"][1]) == 50


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<body><div class='layout has-sidebar'><p>our text</p><div class=sidebar>s</div></div></body>", "our text"),
        ("<div class='no-sidebar'>our text</div>", "our text"),
        ("<div id='page-with-menu'><article>our text</article><div class=menu>m</div></div>", "our text"),
        ("<div class='widget-page'><main>our text</main></div><div class=widget>w</div>", "our text"),
        ("<div class='social-wrap'><p>our long text</p></div><div class=menu>m</div>", "our long text"),
        ("<body><form action=x><p>our long text</p><button>go</button></form></body>", "our long text"),
        ("<form><article>our text</article></form>", "our text"),
        ("<html><head><title>t</title><body><p>our text</p></body></html>", "our text"),
        ("<html><head><title>t</title><p>our text</p></html>", "our text"),
        ("<div class=comments><main>our text</main></div>", "our text"),
        ("<p>our text</p><div class=comments><p>much longer text of readers</p><article>a</article></div>", "our text"),
        ("<p>our text</p><form><p>mail</p></form><div class=sidebar><p>see</p></div>", "our text"),
    ],
)
def test_wrappers_of_a_page_are_not_dropped(spark, html, wanted):
    assert T.page_texts(pages(spark, (1, "http://h/x", html))).first()["text"] == wanted
