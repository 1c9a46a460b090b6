"""Main text, host reputation, quality rules and preference pairs on small cases."""

import math
import random
import time
from collections import defaultdict

import pytest
from llm_cases import WORD, empty_frame, odd_frame, sentence, vocabulary

from coocatlas.llm import host_reputation, html_text, preference, quality_rules

ARTICLE = " ".join(["A sentence of the story that goes on for a while, with some words in it."] * 6)
PAGE = f"""<!DOCTYPE html><html><head><title>t</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>
<div id="main"><article><h2>Head &amp; line</h2><p>{ARTICLE}</p><p>Second   <b>bold</b>
part &#233;.</p></article></div>
<div class="sidebar"><a href="/x">More</a> <a href="/y">Links</a></div>
<footer>Copyright <a href="/t">Terms</a></footer></body></html>"""


def test_main_text():
    lines = html_text.main_text(PAGE).split("\n")
    assert ARTICLE in lines and "Second bold part é." in lines
    assert not any(w in "\n".join(lines) for w in ("Home", "Copyright", "Links", "var a"))


STORY = "".join(f"<p>{ARTICLE} Part {i}.</p>" for i in range(3))
LINKS = "<ul>" + "".join(f'<li><a href="/{w}">{w} things</a></li>' for w in ("One", "Two", "Three")) + "</ul>"
AROUND = f"<nav>{LINKS}</nav>", f"<footer>Made here. <a href='/t'>Terms</a></footer>"
KEEPING = {
    "state on the page": f'<div id="page" class="no-sidebar">{STORY}</div>',
    "state on the content": f'<div class="content has-sidebar">{STORY}</div>',
    "state on the post": f'<div class="post comments-open">{STORY}</div>',
    "one form around all": f'<form action="/x"><div><article>{STORY}</article></div></form>',
    "one form, no article": f'<form action="/x"><div>{STORY}</div></form>',
    "article class words": f'<article class="post has-ads no-comments">{STORY}</article>',
    "named wrapper": f'<div class="social"><article>{STORY}</article></div>',
    "main in a wrapper": f'<div class="widget"><main><div>{STORY}</div></main></div>',
}


def lines_of(body):
    return html_text.main_text(f"<html><body>{AROUND[0]}{body}{AROUND[1]}</body></html>").split("\n")


@pytest.mark.parametrize("name", KEEPING)
def test_names_that_drop_no_article(name):
    assert lines_of(KEEPING[name]) == [f"{ARTICLE} Part {i}." for i in range(3)]


def test_nothing_else_is_dropped():
    in_article = lines_of(f"<article><h1 id='related'>Head</h1>{STORY}{LINKS}<h2 id='social'>More</h2><p>End.</p></article>")
    assert in_article == ["Head", *[f"{ARTICLE} Part {i}." for i in range(3)], "One things", "Two things", "Three things", "More", "End."]
    both = lines_of(f"<main><article><p>First {ARTICLE}</p></article><article><p>Second {ARTICLE}</p></article></main>")
    assert both == [f"First {ARTICLE}", f"Second {ARTICLE}"]
    plain = lines_of(f"<h1>The title</h1><div>{STORY}</div><div><h2>Second</h2><p>Short.</p></div><div class='sidebar'><p>Aside words.</p></div>")
    assert plain == ["The title", *[f"{ARTICLE} Part {i}." for i in range(3)], "Second", "Short."]


def test_boilerplate_is_dropped():
    comments = "".join(f"<article class='comment'><p>{ARTICLE} Reader {i}.</p></article>" for i in range(9))
    extra = (f"<header><p>Our site</p></header><div class='ad'>Buy now.</div><aside><p>{ARTICLE}</p></aside>"
             f"<div class='cookie-notice'>We use cookies.</div><form><label>Mail</label><input><p>Sign up.</p></form>")
    story = [f"{ARTICLE} Part {i}." for i in range(3)]
    assert lines_of(f"{extra}<article>{STORY}<div class='share'>Share this</div></article><section id='comments'>{comments}</section>") == story
    assert lines_of(f"{extra}<div>{STORY}</div><div class='comments'><p>Reader one. {ARTICLE}</p></div>") == story
    assert lines_of(f"<article>{STORY}<script>x()</script><style>p{{}}</style><div hidden>no</div><p style='display: none'>no</p></article>") == story


def test_broken_pages():
    for source in (None, "", "   ", "<", "<p", "</div></p>", "<div><p>open", "<!-- never closed", "<script>x", "&#xffffffff;",
                   "<!", "</", "a < b > c", "<a href=\"x>y</a>", "<p>a<![CDATA[b", "<p title='>'>q</p>"):
        assert isinstance(html_text.main_text(source), str)
    assert html_text.main_text("<p>1 < 2 and <b>3 > 2</b></p>") == "1 < 2 and 3 > 2"
    assert html_text.main_text("<p title='a > b'>q</p><p title=it's>r</p>") == "q\nr"


BROKEN = {
    "tags without end": "<a ", "quoted ends": '<a =">"', "declarations": "<!", "stray ends": "<div></b>", "deep": "<div>",
    "spans": "<span>", "items": "<li><i>", "cells": "<td><b>", "brackets": "< ", "quotes": "<a x=\">'\">",
}


@pytest.mark.parametrize("name", BROKEN)
def test_time_is_linear(name):
    def seconds(n):
        started = time.process_time()
        html_text.main_text(f"<b><article>{BROKEN[name] * n}</b><p>x</p>" + "</i></p><div></div></b>" * n)
        return time.process_time() - started

    seconds(100)
    assert seconds(80_000) < 25 * max(seconds(8_000), 0.05)


def plain_tree(page, out):
    """Density and sum of child densities of every node, from the definition, one subtree at a time."""
    children = defaultdict(list)
    for i in range(1, len(page.tag)):
        children[page.parent[i]].append(i)

    def under(i):
        return [i, *[d for c in children[i] for d in under(c)]]

    def linked(i):
        return i > 0 and (page.tag[i] == "a" or linked(page.parent[i]))

    def totals(i):
        nodes = set(under(i))
        sizes = [(n, len(" ".join(t.split()))) for n, t in page.runs if t and n in nodes and not out[n]]
        live = [n for n in nodes if not out[n]]
        return (sum(s for _, s in sizes), sum(s for n, s in sizes if linked(n)), len(live), sum(page.tag[n] == "a" for n in live))

    c0, l0, _, _ = totals(0)

    def density(i):
        c, link, tags, anchors = totals(i)
        if not c:
            return 0.0
        base = math.log(c / max(c - link, 1) * link + l0 / max(c0, 1) * c + math.e)
        return c / max(tags, 1) * math.log(max(c / max(link, 1) * tags / max(anchors, 1), 1)) / math.log(max(base, 1.01))

    found = [density(i) for i in range(len(page.tag))]
    return found, [sum(found[c] for c in children[i]) for i in range(len(page.tag))]


def random_page(draw, depth=0):
    if depth > 4 or draw.random() < 0.3:
        return draw.choice(["word " * draw.randint(0, 30), "<a href='/x'>link text</a> "])
    tag = draw.choice(["div", "p", "section", "b", "ul", "a", "span", "td", "div class='ad'"])
    return f"<{tag}>" + "".join(random_page(draw, depth + 1) for _ in range(draw.randint(0, 5))) + draw.choice([f"</{tag.split()[0]}>", ""])


def test_density_against_a_plain_tree():
    draw = random.Random(8)
    for _ in range(150):
        page = html_text.Page("".join(random_page(draw) for _ in range(4)))
        out = html_text.boilerplate(page)
        density, sums, _ = html_text.densities(page, out)
        found, summed = plain_tree(page, out)
        assert density == pytest.approx(found) and sums == pytest.approx(summed)
        chosen, best = html_text.selected(page, out), max(range(len(sums)), key=lambda i: (not out[i], sums[i], -i))
        assert all(chosen[i] for i in range(best, len(out)) if not out[i] and i == best)


def test_pages_frame(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_text.extract(frame).collect()
    assert len(found) == 4 and sum(ARTICLE in r.text for r in found) == 2 and sum(r.text == "" for r in found) == 2
    assert html_text.extract(frame.limit(0)).collect() == []
    more = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, text string, tag string, n_chars int")
    assert sorted(map(repr, html_text.extract(more).collect())) == sorted(map(repr, found))


def test_host_and_path(spark):
    urls = ["http://A.Example.ORG/es/1?x#y", "https://b.com", "no scheme", None, "x://h?q/p", "x://h#f", "a://b/://c"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    found = frame.select(host_reputation.host_of(frame.url), host_reputation.path_of(frame.url)).collect()
    assert [tuple(r) for r in found] == [
        ("a.example.org", "/es/1"), ("b.com", ""), ("", ""), ("", ""), ("h", ""), ("h", ""), ("b", "/://c")]


def test_reputation_borrows_from_the_domain(spark):
    pages = [(i, f"http://h{i % 4}.good.net/{i}") for i in range(40)] + [(i, f"http://h{i % 4}.bad.info/{i}") for i in range(40, 80)]
    pages += [(100, "http://new.good.net/"), (101, "http://new.bad.info/"), (102, None), (103, "http://x.example.org/es/1"), (103, "http://y.org/")]
    outcomes = [(u, float("good" in u)) for _, u in pages[:80]] + [(None, 1.0), ("http://h0.good.net/", None)]
    rules = (host_reputation.Rule("org", "/", "allow"), host_reputation.Rule("example.org", "/es/", "block"))
    frame = spark.createDataFrame(pages, "page_id long, url string")
    judged = host_reputation.judge(frame, spark.createDataFrame(outcomes, "url string, good double"), rules)
    found = {(r.page_id, r.host): (r.rule, r.verdict) for r in judged.collect()}
    assert found[100, "new.good.net"] == (None, "allow") and found[101, "new.bad.info"] == (None, "block")
    assert found[103, "x.example.org"] == ("example.org/es/", "block") and found[103, "y.org"] == ("org/", "allow")
    assert judged.count() == len(pages)
    more = frame.selectExpr("page_id", "url", "url AS host", "1 AS k", "'x' AS mean", "'y' AS verdict", "2 AS bound")
    labelled = spark.createDataFrame([(*o, 5, "z") for o in outcomes], "url string, good double, n int, host string")
    assert sorted(map(repr, host_reputation.judge(more, labelled, rules).collect())) == sorted(map(repr, judged.collect()))
    none = spark.createDataFrame([], "url string, good double")
    assert host_reputation.judge(frame, none).count() == len(pages)
    assert host_reputation.judge(frame.limit(0), none).count() == 0


def test_quality_rules(spark):
    frame = odd_frame(spark)
    found = {r.doc_id: r for r in quality_rules.ledger(frame).collect()}
    assert len(found) == len({r.doc_id for r in frame.select("doc_id").collect()})
    assert (found[0].n_words, found[4].n_words, found[10].n_dup_lines, found[8].n_words) == (0, 2, 1, 30_000)
    kept = quality_rules.apply_policy(frame)
    assert kept.columns == frame.columns
    passed = {r.doc_id for r in quality_rules.ledger(frame).where(quality_rules.passes()).collect()}
    assert {r.doc_id for r in kept.collect()} == passed and 5 in passed and 0 not in passed
    assert quality_rules.apply_policy(empty_frame(spark)).count() == 0
    assert quality_rules.ledger(empty_frame(spark)).count() == 0


def repeated_words(text):
    found = WORD.findall(text or "")
    places = defaultdict(list)
    for i in range(len(found) - 2):
        places[tuple(found[i:i + 3])].append(i)
    return len({p for starts in places.values() if len(starts) > 1 for i in starts for p in (i, i + 1, i + 2)})


def test_repeats_and_filters_of_long_texts(spark):
    draw, few = random.Random(3), vocabulary(size=40)
    texts = [sentence(draw, few, n) for n in (50, 400, 30_000)] + ["a b c a b c", "x x x x", "a b a b a"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality_rules.ledger(frame)
    assert {r.doc_id: r.n_repeat_words for r in rows.collect()} == {i: repeated_words(t) for i, t in enumerate(texts)}
    started = time.monotonic()
    assert rows.where(quality_rules.passes()).count() == sum(r.failures == 0 for r in rows.collect())
    assert rows.where("n_repeat_words > 3 and n_words < 100").groupBy("failures").count().count() > 0
    assert time.monotonic() - started < 60


def test_rule_ablations(spark):
    rows = quality_rules.ledger(odd_frame(spark))
    masks = [r.failures for r in rows.collect()]
    for r in quality_rules.ablations(rows).collect():
        mask, bit = quality_rules.mask_of(quality_rules.POLICIES[r.policy]), quality_rules.mask_of((r.rule,))
        assert (r.n_kept, r.n_failed, r.n_failed_alone, r.n_kept_without) == (
            sum(m & mask == 0 for m in masks), sum(m & bit != 0 for m in masks),
            sum(m & mask == bit for m in masks), sum(m & mask & ~bit == 0 for m in masks))
    assert quality_rules.ablations(quality_rules.ledger(empty_frame(spark))).count() == 0


def test_preference_pairs(spark):
    turns = [("a", "chosen", 1, "user", "hi"), ("a", "rejected", 1, "user", "hi"), ("a", "chosen", 2, "assistant", "yes"),
             ("a", "rejected", 2, "assistant", "no"), ("b", "chosen", 1, None, None), ("c", "other", 1, "user", "x")]
    frame = spark.createDataFrame(turns, "pair_id string, side string, turn int, role string, text string")
    found = {r.pair_id: r for r in preference.format_pairs(frame).collect()}
    assert set(found) == {"a", "b"} and found["a"].n_common == 1 and found["b"].n_common == 0
    a = found["a"]
    assert [a.chosen[s.start:s.end] for s in a.chosen_mask] and "yes" in a.chosen[a.chosen_mask[0].start:a.chosen_mask[0].end]
    assert a.prompt.count("hi") == 1 and "hi" not in a.chosen and b"no" in a.rejected.encode()
    assert preference.format_pairs(frame.limit(0)).count() == 0


def test_conversations_as_pairs(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 2, "user", "s"), (1, 3, "assistant", "t"), (2, 0, "user", "x"), (None, 0, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = {r.pair_id: r for r in preference.format_pairs(preference.replies_as_pairs(frame)).collect()}
    assert set(found) == {1, None} and found[1].n_common == 3
