"""Ranked search, page extraction and conversation repair against brute force and hard cases."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import htmltree, queries, ranking, repair, wrappers


def got(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def read(spark, sf, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]


# ---------------------------------------------------------------- ranked search

ITEMS = [(1, "w12 w40 W77 é"), (2, "one two three"), (3, None), (4, "..."), (None, "five words are in here"), (2, "one two three"),
         (5, "nowhere-at-all"), (6, "ünï cödé ab rep a"), (7, " ".join(f"w{i}" for i in range(0, 9973, 50)))]


@pytest.mark.parametrize("items_a_block, top", [(4096, 50), (2, 3)])
def test_ranked_search(spark, docs, rows, monkeypatch, items_a_block, top):
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", items_a_block)
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, rank int")
    out = ranking.rank_documents(docs, items, top)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(out, *out.columns) == Counter(brute.ranked([r[:2] for r in rows], ITEMS, top))


def test_ranked_search_in_parts(spark, sf, monkeypatch):
    """Tasks that search their documents in several parts keep the best of all."""
    monkeypatch.setattr(ranking, "TASK_POSTINGS", 500)
    docs, items = (read(spark, sf, n, i, "text") for n, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    out = queries.op12_ranked_search(spark, sf)
    assert got(out, "item_id", "rank", "doc_id", "score") == Counter(brute.ranked(docs, items))


def test_ranked_search_empty(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.rank_documents(empty, items).count() == 0
    assert ranking.rank_documents(docs, items.limit(0)).count() == 0


def test_strata_stop_early():
    """Strata whose bound is under the 50th score are not scored."""
    rng = np.random.default_rng(5)
    m = np.repeat(np.arange(50, 2050), 5)
    terms = [np.array([0, 1], "<i4")] * len(m)
    tfs = [rng.integers(1, 4, 2).astype("<i4") for _ in m]
    strata = ranking.Strata(m, np.arange(len(m)), np.zeros(len(m), np.int64), terms, tfs)
    calls, bincount = [], np.bincount
    ranking.np.bincount, before = lambda *a, **k: calls.append(1) or bincount(*a, **k), np.bincount
    try:
        best = strata.search(np.array([0, 1]), np.array([900, 700]), [], 50)
    finally:
        ranking.np.bincount = before
    score = [sum(w * (1000000000 * int(t) // (1000 * int(t) + 20 * int(mm))) for w, t in zip((900, 700), tf)) for mm, tf in zip(m, tfs)]
    assert best == sorted((-s, 0, i) for i, s in enumerate(score))[:50]
    assert len(calls) < 200  # of 2000 strata


# ---------------------------------------------------------------- conversation repair

def made_up(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  \n", "ends here. ", None, "a.b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "USER", "", None, "Assistant"]
    out = []
    for conv in range(n):
        for turn in range(rng.randrange(0, 8)):
            out.append((conv if conv % 17 else None, None if rng.random() < .1 else turn + rng.randrange(2),
                        rng.choice(roles[:5] if conv % 2 else roles), rng.choice(texts)))
    return out


def check_repair(out, rows, ids):
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    have = got(out, "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256))
    assert have == Counter((i, *brute.repaired(rows.get(i, []))) for i in ids)


@pytest.mark.parametrize("batch_rows", [repair.BATCH_ROWS, 5])
def test_repair_made_up(spark, monkeypatch, batch_rows):
    monkeypatch.setattr(repair, "BATCH_ROWS", batch_rows)
    rows = made_up(300, 1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    ids = {r[0] for r in rows}
    damaged = brute.damaged(rows)
    assert any(not damaged.get(i) for i in ids)
    check_repair(repair.repair_conversations(repair.damage(df), df), damaged, ids)


def test_repair_long_conversation(spark):
    """A long conversation gets the path that a search finds, in the order of its turns."""
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "cut", ""]) + f" {t}" + rng.choice([".", ""])) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check_repair(repair.repair_conversations(repair.damage(df), df), brute.damaged(rows), [1])


def test_repair_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_conversations(repair.damage(df), df).count() == 0
    one = spark.createDataFrame([(5,)], "conv_id long")
    assert got(repair.repair_conversations(df, one), "conv_id", "gaps", "cost", "audit", F.size("turns")) == Counter([(5, 0, 0, "", 0)])


def test_registered_repair(spark, sf):
    rows = read(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    damaged = brute.damaged(rows)
    out = queries.op13_conversation_repair(spark, sf)
    assert got(out, *out.columns) == Counter((i, *brute.repaired(damaged.get(i, []))) for i in {r[0] for r in rows})


# ---------------------------------------------------------------- page extraction

def test_registered_extraction(spark, sf):
    rows = read(spark, sf, "pages", "page_id", "url", "html")
    want = Counter((i, u, brute.article(h), len(brute.article(h))) for i, u, h in rows)
    assert got(queries.op11_html_extraction(spark, sf), "page_id", "url", "text", "n_chars") == want


def soup(k, words, notice=True):
    """A page without elements that name their parts: the wrapper tells them from its text."""
    body = "".join(f"<div>{w} tells part {k} of it, at some length and &amp; with <i>marks</i>.</div>" for w in words)
    return (f"<html><head><title>T{k}</title></head><body><div class=top><div>Daily Example</div><div><a href=/a>Home</a> <a href=/b>All</a></div></div>"
            + ("<div>We changed our terms, read them before you go on reading here.</div>" if notice else "")
            + f"<div class=text><h1>Title {k}</h1>{body}<div>Write to us if you know more about this story.</div></div>"
              "<div class=low><div>Example Press, all rights kept, printed in three towns.</div></div></body></html>")


def test_wrapper_tells_template_from_slots(spark):
    words = [["Anna", "Bert"], ["Cara"], ["Dora", "Emil", "Finn"], ["Gina", "Hugo"], ["Ida"], ["Jan", "Kim", "Lea", "Max"]]
    rows = [(k, f"https://news.example.org/{k}", soup(k, w, k % 5 > 0)) for k, w in enumerate(words)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    out = {r["page_id"]: r["text"] for r in wrappers.extract_text(df).collect()}
    for k, w in enumerate(words):
        assert out[k] == "\n".join([f"Title {k}", *[f"{x} tells part {k} of it, at some length and & with marks." for x in w]])


def test_copies_are_no_template(spark):
    """Copies of a page are one seed, and what they share stays."""
    page = soup(1, ["Anna", "Bert"])
    rows = [(k, "http://h.example/x", page) for k in range(30)] + [(100 + k, "http://h.example/y", soup(k, [f"Name{k}"])) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = wrappers.extract_text(df).where("page_id < 30")
    assert out.count() == 30 and {r["text"].count("tells part") for r in out.collect()} == {2}


def many(n, say):
    """Pages of one host, and their articles; ``say`` gives what stands above and below the article of page k."""
    rows, want = [], {}
    for k in range(n):
        above, below = say(k)
        words = [f"Name{k}x{i}" for i in range(4 + k % 5)]
        body = "".join(f"<div>{w} tells part {k} of it, at some length and with care.</div>" for w in words)
        rows.append((k, f"https://news.example.org/{k}", f"<body><div class=post-{k}><div>Part of page {k}</div></div>" + "".join(f"<div>{x}</div>" for x in above)
                     + f"<div class=text><h1>Title {k}</h1>{body}" + "".join(f"<div>{x}</div>" for x in below) + "</div></body>"))
        want[k] = "\n".join([f"Title {k}", *[f"{w} tells part {k} of it, at some length and with care." for w in words]])
    return rows, want


def texts(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    return {r["page_id"]: r["text"] for r in wrappers.extract_text(df, **more).collect()}


def test_all_pages_make_the_wrapper(spark):
    """Notes that stand on three pages of ten are template, whichever pages they are."""
    rows, want = many(200, lambda k: ((), [f"Note {i}, which stands under some of the stories of this paper." for i in range(20) if (k * 7 + i) % 10 < 3]))
    assert texts(spark, rows) == want
    assert texts(spark, rows, fan=2) == want  # merged in rounds


def test_near_copies_are_no_template(spark):
    """What many near copies of a page say in common stays; what other pages say too goes."""
    lines = [f"Line {i} of a story that was printed again and again, with few changes." for i in range(12)]
    rows, want = many(30, lambda k: (["Daily Example, the paper of three towns"], ["Write to us if you know more about this story."]))
    for k in range(100, 130):
        told = [f"Changed line {k}" if i == k % 12 else x for i, x in enumerate(lines)]
        rows.append((k, f"https://news.example.org/{k}", "<body><div>Daily Example, the paper of three towns</div><div class=text>"
                     + "".join(f"<div>{x}</div>" for x in told) + "<div>Write to us if you know more about this story.</div></div></body>"))
        want[k] = "\n".join(told)
    assert texts(spark, rows) == want


def test_lines_that_articles_share_stay(spark):
    rows = [(k, f"http://h.example/{k}", f"<body><div>Every day</div><article><h1>Weather</h1><p>Today it is {k} degrees, {'and dry ' * k}</p></article></body>")
            for k in range(12)]
    assert texts(spark, rows) == {k: f"Weather\nToday it is {k} degrees, {'and dry ' * k}".strip() for k in range(12)}


PARTS = {
    "": "",
    "no tags, a &lt; b &eacute;&nbsp;x": "no tags, a < b é x",
    "<article><header><h1>A  title</h1></header><p>one<p>two<ul><li>x<li>y</ul></article><aside>z</aside>": "A title\none\ntwo\nx\ny",
    "<main><p>kept</p><div class='newsletter-signup'>no</div><section id=comments><article><p>I think so too, and at length, dear all</p></article></section></main>": "kept",
    "<p>a<b>b</b>c<br>d</p><script>if (a < b) '<p>no</p>'</script><form>f<input></form><p hidden>h</p>": "abc d",
    "<div role=navigation>n</div><table><tr><td>1<td>2</table><!-- <p>no</p> --><noscript>n</noscript>": "1\n2",
    "<article><p>text</p><ul><li><a href=1>more</a><li><a href=2>links</a></ul></article>": "text",
    "<p title=\"a > b\">x</p><p title='unclosed>y</p><p>z": "x\ny\nz",
    "<article class=\"post has-sidebar-left\"><div class=\"cookie-notice\">c</div><p>t</p></article>": "t",
    "<div>" * 3000 + "deep" + "</div>" * 3000: "deep",
    "<script>never closed <p>a</p>": "",
}


def test_page_parts(spark):
    rows = [(i, f"https://h{i}.example.org/", h) for i, h in enumerate(PARTS)] + [(None, None, None), (99, "", "<p>x</p>"), (99, "", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = got(wrappers.extract_text(df), "page_id", "text")
    assert out == Counter([*enumerate(PARTS.values()), (None, ""), (99, "x"), (99, "x")])
    assert wrappers.extract_text(df.where("page_id < 0")).count() == 0


def brute_match(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_match(x, y))
    return 1 + m[-1][-1]


def test_simple_tree_matching():
    rng = random.Random(3)

    def some(depth):
        if depth == 0 or rng.random() < .2:
            return "text "
        return "".join(f"<{t}>{some(depth - 1)}</{t}>" for t in rng.choices(["div", "section", "h2", "ul"], k=rng.randrange(1, 5)))

    for _ in range(60):
        a, b = htmltree.tree(some(3)), htmltree.tree(some(3))
        met = []
        htmltree.align(a, b, lambda x, y: met.append((x.label, y.label)))
        assert htmltree.matched(a, b) == brute_match(a, b) == len(met)
        assert all(x == y for x, y in met)
