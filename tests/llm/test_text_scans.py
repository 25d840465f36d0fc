import html as entities
import re

from courierworks.llm import html, licenses
from tests.llm.cases import frame, odd_texts

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def base_places(text):
    words, places, labels = WORD.findall((text or "").translate(LOWER)), [], set()
    for label, phrase in licenses.BASE.items():
        parts = phrase.split()
        hits = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_equal_a_plain_scan(spark):
    texts = odd_texts() + ["MIT License, mit-license; the GENERAL public  License", "Üapache license", "mit licensee apache\tlicense", "general public general public license"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_template_regions():
    automaton = licenses.Automaton("copyright [[c]] <<2>> all rights")
    say = lambda text: automaton.match(text.encode().split(), 0)
    assert say("copyright all rights") == 3 and say("copyright c me all rights") == 5 and say("copyright c me too all rights") == 6
    assert say("copyright a b c all rights") == 0 and say("copyright all wrongs") == 0
    labels = lambda text: licenses.scan_text(text.encode(), licenses.compiled())["labels"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0,gpl-notice"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc"
    assert labels("Copyright (c) 2020 Some Body. All rights reserved.") == "all-rights-reserved"
    assert labels("Permission is granted") == ""


def test_scan_of_nulls_and_empty_tables(spark):
    row = licenses.scan(frame(spark, [None], [None])).first()
    assert (row.doc_id, row.n_words, row.n_base, row.first_word, row.labels, row.score) == (None, 0, 0, None, "", 0.0)
    assert licenses.scan(frame(spark, [])).count() == 0


PAGE = ("<html><head><title>T</title><style>p{}</style></head><body class=home><header><p>Site head</p></header><nav><a href=/>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><div class='wrap-12'><div class='post-body'><h2>Head&amp;line &copy</h2><p>First  <b>bold</b>\n text<p>Second &lt;x&gt;"
        "<script>var a = '</p>';</script><div class=\"ad\">Buy now</div><form><input>Send</form><ul><li>one<li>two</ul></div></div>"
        "<aside>More</aside><section id=comments><p>Nice article, thank you very much indeed, I liked reading it a lot.</p></section><footer>End</footer></body></html>")


def test_the_article_without_its_surroundings():
    path, _ = html.best_path(html.parse(PAGE)[1])
    assert path.endswith("div.post-body")
    assert html.extract(PAGE, None) == "Head&line © First bold text Second <x> one two"
    assert html.extract(PAGE[:PAGE.index("<ul>") + 11], None) == "Head&line © First bold text Second <x> one"


def test_broken_markup_does_not_stop_the_parser():
    for page in ("", "<", "<<<a", "a < b", "<p", "<!-- open", "<script>never ends", "<div><span></div>x", "</div></p>text", "<a href='x>y</a>", "<p title=\"a>b\">c</p>", "<b>" * 3000 + "x", "&#xFFFFFFFF; &#0;"):
        html.extract(page, None)
    assert html.extract("a < b", None) == "a < b" and html.extract("</div></p>text", None) == "text" and html.extract("<p title=\"a>b\">c</p>", None) == "c"


def test_hosts_vote_and_pages_follow(spark):
    article = lambda k: f"<body><div class='c{k} main-col'>{'Real text of the page. ' * 20}</div><div class='x{k}'>{'Teaser words here. ' * (3 if k else 40)}</div></body>"
    rows = [(k, "https://www.h.org/a", article(k), "clash") for k in range(6)] + [(7, None, None, ""), (8, "http://[bad", "", ""), (9, "http://o.org", "<article>Own</article>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert {(r.host, r.path) for r in html.winners(pages).collect()} == {("h.org", "body>div.c#.main-col"), ("o.org", "article")}
    want = {k: " ".join(("Real text of the page. " * 20).split()) for k in range(6)} | {7: "", 8: "", 9: "Own"}
    for limit in (html.BROADCAST_BYTES, -1):
        html.BROADCAST_BYTES, kept = limit, html.BROADCAST_BYTES
        try:
            got = html.extract_pages(pages).collect()
        finally:
            html.BROADCAST_BYTES = kept
        assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_pages_of_the_tables_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    have = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract_pages(pages).collect():
        inner = re.search("<article>(.*?)</article>", have[r.page_id], re.S)[1]
        assert r.text == " ".join(entities.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())


def test_pages_of_a_mixed_host_keep_their_article(spark):
    from courierworks.llm import html

    sentence = "This is one sentence of an article with enough words in it to count. "
    posts = [f"<html><body><div class='post'><p>{sentence * 30}{i}</p></div></body></html>" for i in range(3)]
    odd = f"<html><body><div class='post'>Caption.</div><article><p>{sentence * 50}</p></article></body></html>"
    lost = f"<html><body><article><p>{sentence * 20}</p></article></body></html>"
    rows = [(i, f"https://h.example/{i}", p) for i, p in enumerate([*posts, odd])] + [(9, None, lost), (10, None, posts[0])]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == (sentence * 50).strip() and got[9] == (sentence * 20).strip()
    assert all(got[i] == (sentence * 30).strip() + f" {i}" for i in range(3)) and got[10] == got[0]
