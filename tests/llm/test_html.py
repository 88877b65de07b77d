import html as references
import re

from corpuslab.llm import html
from corpuslab.llm.html import extract, extract_main_text, frame, op2_extract_main_text, tokenise


def brute(source):
    """For the made pages: the blocks of the one article."""
    inner = re.split(r"</article>|<footer>", source.split("<article>", 1)[1])[0]
    blocks = re.split(r"</?(?:p|h1|br)>", inner)
    cleaned = (" ".join(references.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(b for b in cleaned if b)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op2_extract_main_text(spark, sf_dir).collect()
    assert len(got) == len(sources)
    for r in got:
        assert r["text"] == brute(sources[r["page_id"]]) and r["n_chars"] == len(r["text"])


def site(k, body):
    return (
        f"<html><head><title>t{k}</title></head><body><div id=top class='site-header'>Name of the site</div><div class=menu><a href=/a>A</a> <a href=/b>B</a></div>"
        f"<div class=content><div class='cookie-notice'>We use cookies.</div>{body}<div>Read more on our site.</div></div><div class=comments><p>Reader {k} says so.</p></div><form>Name <input></form><div>All rights kept.</div></body></html>"
    )


def test_template_without_article():
    bodies = [f"<p>First   part {k} &amp; more <b>bold</b>.</p>tail {k * 7}<br>line" for k in range(6)]
    texts = extract([site(k, b) for k, b in enumerate(bodies)])
    # "line" stands in one place on all pages: the template's, as far as pages can tell.
    assert texts == [f"First part {k} & more bold.\ntail {k * 7}" for k in range(6)]
    assert all("cookies" not in t and "rights" not in t and "Reader" not in t and "A B" not in t and "Name" not in t for t in texts)


def test_frame_is_ordered():
    pages = [tokenise(s) for s in ("<html><body><nav>x</nav><p>a</p><footer>f</footer></body></html>", "<html><body><footer>f</footer><nav>x</nav><p>b</p></body></html>", "<html><body><nav>y</nav><p>c</p>")]
    keys = frame(pages)
    for p in pages:
        at = [p.place[k][0] for k in keys if k in p.place]
        assert at == sorted(at)


def test_article_wins_and_asides_go():
    page = "<body><header><h1>Site</h1></header><main><article><h1>Title</h1><p>One <a href=x>link</a> text&nbsp;here<script>var x='<p>no</p>'</script></p><aside>Ad</aside><ul><li>a<li>b</ul><section class='reader-comments'><p>No</p></section></article></main><footer>f</footer>"
    assert extract([page]) == ["Title\nOne link text here\na\nb"]
    assert extract(["", "plain text only", "<article>cut off <b>here <a hre", "<div hidden>no</div><p>yes 1 < 2 and &lt;b&gt;"]) == ["", "plain text only", "cut off here", "yes 1 < 2 and <b>"]


def test_edges(spark):
    rows = [(1, None, None, "k"), (None, "http://a.test/", "", "k"), (2, "http://a.test/1", "<article>x</article>", None), (2, "http://a.test/1", "<article>x</article>", None), (3, "nonsense", "<p>" + "word " * 100_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and extract_main_text(df.limit(0)).count() == 0
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 499_999)]


def long(k):
    return " ".join(f"word{k}x{j}" for j in range(40))


def test_template_decides_inside_articles():
    """A notice and a menu without a telling class go; the headline, though a link, stays, and so does what varies."""
    pages = [
        f"<body><article><h1><a href=/{k}>Title {k}</a></h1><div class=x1>Our site is made by many hands.</div><p>{long(k)}</p>"
        f"<ul><li><a href=/a{k}>More {k}</a></li><li><a href=/b{k}>Other {k}</a></li></ul></article></body>"
        for k in range(6)
    ]
    assert extract(pages) == [f"Title {k}\n{long(k)}" for k in range(6)]


def test_text_outside_a_teaser_article():
    pages = [f"<body><div class=site>Name of it</div><div class=c1><p>{long(k)}</p></div><article class=t><p>Teaser {k}</p></article></body>" for k in range(6)]
    assert all(long(k) in t and "Name of it" not in t for k, t in enumerate(extract(pages)))


def test_records_are_an_inner_class():
    """A line of every record, on pages with unlike numbers of records, goes; what records hold otherwise stays."""
    pages = ["<body><main>" + "".join(f"<section class=r><h2>Part {k} {j}</h2><p>{long(k * 9 + j)}</p><p>Back to top</p></section>" for j in range(2 + k % 3)) + "</main></body>" for k in range(6)]
    want = ["\n".join(f"Part {k} {j}\n{long(k * 9 + j)}" for j in range(2 + k % 3)) for k in range(6)]
    assert extract(pages) == want


def test_copies_count_as_one_page(spark):
    """Mirrored pages and repeated rows of an article without a tag keep its text, and the template goes all the same."""
    page = lambda k, link="": f"<body><div class=x>Name of the site</div><div class=c><p><a href='/?utm={link}'>By hand</a> {long(k)}</p><p>line {k}</p></div></body>"
    article = f"By hand {long(0)}\nline 0"
    for n in (3, 200):
        assert all(article in t for t in extract([page(0, j) for j in range(n)]))
        mixed = extract([page(0, j) for j in range(n)] + [page(k) for k in range(1, 6)])
        assert mixed == [article] * n + [f"By hand {long(k)}\nline {k}" for k in range(1, 6)]
        rows = [(1, "http://a.test/1", page(0, j % 150)) for j in range(n)] + [(1, "http://a.test/1", page(k)) for k in range(1, 6)]
        got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert sorted(r["text"] for r in got) == sorted(mixed)


def neutral(k):
    """A page that tells nothing by tags or names: menu, notice, article, foot in containers alike; text differs everywhere."""
    body = "".join(f"<p>paragraph {k} {i} with some words of its own</p>" for i in range(3 + k % 4))
    links = "".join(f"<li><a href='/{k}{i}'>menu {k} {i}</a></li>" for i in range(5))
    page = f"<html><head><title>t{k}</title></head><body><div><ul>{links}</ul></div><div>notice of page {k}</div><div><h1>head {k}</h1>{body}</div><div>foot of page {k} &copy;</div></body></html>"
    return page, "\n".join([f"head {k}", *(f"paragraph {k} {i} with some words of its own" for i in range(3 + k % 4))])


def test_the_frame_finds_the_article_where_nothing_is_named(monkeypatch):
    pages, want = zip(*map(neutral, range(12)), strict=True)
    assert html.extract([*pages]) == [*want]
    monkeypatch.setattr(html, "frame", lambda pages: [])
    assert not any(a == b for a, b in zip(html.extract([*pages]), want, strict=True))


def test_pages_without_tags_and_names(spark):
    """Most of the given pages lose nothing when the tags and names that tell of an article are taken away."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html").collect()
    hosts = {}
    for r in rows:
        hosts.setdefault(r["url"].split("/")[2], []).append(r["html"])
    bare = lambda s: re.sub(r'\b(class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|main|aside|nav|header|footer)\b", r"<\1div", s))
    pairs = [x for v in hosts.values() for x in zip(html.extract(v), html.extract([*map(bare, v)]), strict=True)]
    assert sum(a == b for a, b in pairs) >= 0.8 * len(pairs)


BODIES = {
    "list": "<ul>{}</ul>",
    "section": "<section>{}</section>",
    "quote": "<blockquote>{}</blockquote>",
    "table": "<table><tr>{}</tr></table>",
    "div": "<div class=x2>{}</div>",
}


def test_nothing_of_an_article_is_lost_whatever_the_number_of_pages():
    """Headline, introduction and end stay beside a list, table, quote, section or div with most of the text."""
    for name, around in BODIES.items():
        item, want, pages = {"list": "li", "table": "td"}.get(name, "p"), [], []
        for k in range(64):
            parts = [f"item {k} {j} {long(k * 7 + j)}" for j in range(6)]
            inner = around.format("".join(f"<{item}>{p}</{item}>" for p in parts))
            pages.append(f"<html><body><nav><a href=/>Home</a></nav><div class=menu>Menu</div><article><h1>Head {k}</h1><p>Introduction {long(k)}</p>{inner}<p>The end of {k}.</p></article><footer>foot</footer></body></html>")
            want.append("\n".join([f"Head {k}", f"Introduction {long(k)}", *parts, f"The end of {k}."]))
        for n in (1, 2, 3, 8, 64):
            assert extract(pages[:n]) == want[:n], (name, n)


def test_sentences_that_most_pages_share_are_text_inside_articles():
    shared = "Both models are available now in shops."
    pages = [f"<body><article><h1>Head {k}</h1><p>{long(k)}</p><p>{shared if k < 6 else 'None is.'}</p></article></body>" for k in range(8)]
    assert extract(pages) == [f"Head {k}\n{long(k)}\n{shared if k < 6 else 'None is.'}" for k in range(8)]


def test_near_copies_of_an_article_keep_their_text():
    """Pages of a host that are one article with another headline each do not take it for the template."""
    pages = [f"<body><article><h1>Head {k}</h1><p>{long(1)}</p><p>{long(2)}</p></article></body>" for k in range(5)]
    assert extract(pages) == [f"Head {k}\n{long(1)}\n{long(2)}" for k in range(5)]


def test_given_pages_with_wrapped_paragraphs(spark):
    """All paragraphs but the first wrapped in one section: no given page loses anything."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html").collect()
    hosts, changed = {}, 0
    for r in rows:
        hosts.setdefault(r["url"].split("/")[2], []).append(r["html"])
    for sources in hosts.values():
        wrapped = []
        for s in sources:
            head, body = s.split("<article>", 1)
            inner, end = re.split(r"(?=</article>|<footer>)", body, maxsplit=1)
            parts = inner.split("<p>")
            again = "<p>".join(parts[:2]) + ("<section><p>" + "<p>".join(parts[2:]) + "</section>" if len(parts) > 2 else "")
            wrapped.append(f"{head}<article>{again}{end}")
            changed += len(parts) > 2
        assert html.extract(wrapped) == [brute(s) for s in sources]
    assert changed > 150
