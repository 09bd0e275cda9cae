"""Extraction without a declared article or with misleading names, and repetition against brute force."""

import numpy as np
import pytest

from quaystone.llm import op2_tag_path_ratios as op2
from quaystone.llm import op3_suffix_repetition as op3

PROSE = [f"Paragraph number {k} speaks at some length, with commas, of the matter at hand; it does not hurry, and it ends." for k in range(6)]


def page(body):
    return f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav>{body}<footer>Imprint, contact.</footer></body></html>"


# 2
def test_no_article_element():
    body = "".join(f"<p>{x}</p>" for x in PROSE)
    menu = "<div class=list>" + "".join(f"<div><a href=/{k}>Section {k}</a></div>" for k in range(9)) + "</div>"
    got = op2.content(page(f"<div id=wrap>{menu}<div class=text><h2>The head</h2>{body}</div></div>"))
    assert got == "\n\n".join(["The head", *PROSE])


def test_boilerplate_inside_the_article():
    body = "".join(f"<p>{x}</p>" for x in PROSE)
    extra = '<div class="share-buttons">Share this, now!</div><div class="related-posts"><p>Other posts, here.</p></div><div id="comment-list"><p>A reader, angry.</p></div><div class="cookie-notice">We use cookies, ok.</div><aside>Aside, said.</aside><form>Name</form>'
    assert op2.content(page(f"<article>{body}{extra}</article>")) == "\n\n".join(PROSE)


def test_names_that_only_contain_a_boilerplate_word():
    kept = ["The share price rose, they said.", "Side effects were rare, mild.", "A notice of motion, in full.", "A side note, kept."]
    body = f'<p class="share-price">{kept[0]}</p><div class="side-effects"><p>{kept[1]}</p></div><p id="notice-of-motion">{kept[2]}</p><p class="side note">{kept[3]}</p>'
    assert op2.content(page(f"<article>{body}</article>")) == "\n\n".join(kept)
    for name, element, gone in (("ad-slot-3", "div", True), ("site-footer", "div", True), ("header", "div", True), ("header", "p", False), ("adventure", "div", False), ("comments", "p", True), ("navy-blue", "div", False), ("top-menu", "ul", True)):
        assert op2.named_boilerplate(name, element) == gone, name


def test_pages_without_content_and_any_share():
    links = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul>"
    assert op2.content(links) == op2.content(f"<body>{links}") == op2.content("<p> </p>") == op2.content("<nav>x</nav>") == ""
    text = page("".join(f"<p>{x}</p>" for x in PROSE) + "<div><span>Short one.</span></div>")
    for share in (0, 0.5, 1, 5, 1e9):
        assert isinstance(op2.content(text, share=share), str)
    assert op2.content(text, share=1e9) == ""


def test_share_parts_paths():
    text = "".join(f"<section><p>{x}</p></section>" for x in PROSE) + "".join(f"<div><em>Line {k}, brief.</em></div>" for k in range(6))
    wide, narrow = op2.content(text, share=0.0), op2.content(text, share=2.0)
    assert "brief" in wide and "brief" not in narrow.split("\n\n")[-1] and all(x in narrow for x in PROSE)


def test_repeated_and_long_pages(spark):
    long = page("<article>" + "".join(f"<p>{x}</p>" for x in PROSE * 500) + "</article>")
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, "u", None)], "page_id long, url string, html string")
    rows = op2.extract(df, keep=["page_id"]).collect()
    assert [r.n_chars for r in sorted(rows, key=lambda r: r.page_id)] == [len("\n\n".join(PROSE * 500))] * 2 + [0]


# 3
def brute(words):
    """(words in the union of repeats of three words, of eight words, longest repeat)."""
    n, longest = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
    union = lambda least: len({x for i, k in enumerate(longest) if k >= least for x in range(i, i + k)})
    return union(3), union(op3.LONG_WORDS), max(longest, default=0)


def test_spans_and_longest_repeat():
    rng, texts = np.random.default_rng(7), []
    for _ in range(60):
        w = [f"w{x}" for x in rng.integers(0, int(rng.integers(2, 60)), int(rng.integers(0, 70)))]
        if len(w) > 20:
            w += w[3 : 3 + int(rng.integers(3, 18))]
        texts.append(" ".join(w))
    got = op3.measure([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert (got[4][k], got[5][k], got[6][k]) == brute(t.split())


@pytest.fixture(scope="module")
def judged(spark):
    fresh = lambda a, n: " ".join(f"v{a}x{k}" for k in range(n))
    passage = fresh("p", 15)
    texts = {
        "clean": fresh("c", 200), "one passage twice": " ".join([fresh("d", 100), passage, fresh("e", 70), passage]), "a third repeats": " ".join([fresh("f", 50), passage, fresh("g", 12), passage, fresh("h", 8)]),
        "long copy": " ".join([fresh("i", 101), fresh("j", 900), fresh("i", 101)]), "short copy": " ".join([fresh("i", 99), fresh("j", 900), fresh("i", 99)]), "base": "again and again " * 30, "few": fresh("k", 49),
    }
    names = list(texts)
    rows = op3.quality(spark.createDataFrame([(k, texts[n]) for k, n in enumerate(names)], "doc_id long, text string")).collect()
    return {names[r.doc_id]: r for r in rows}, texts


def test_verdict_decides(judged):
    rows, texts = judged
    assert {n: r.kept for n, r in rows.items()} == {"clean": True, "one passage twice": True, "a third repeats": False, "long copy": False, "short copy": True, "base": False, "few": False}
    assert not rows["a third repeats"].base_failed and not rows["long copy"].base_failed and rows["base"].base_failed
    for n, r in rows.items():
        w = texts[n].split()
        if len(w) < 300:
            rep, long, top = brute(w)
            failed = len(w) < 50 or rep > 0.5 * len(w)
            assert (r.n_repeat_words, r.n_long_repeat_words, r.longest_repeat, r.base_failed) == (rep, long, top, failed)
            assert r.kept == (not failed and long <= op3.MAX_LONG_SHARE * len(w) and top <= op3.MAX_LONGEST)
