import math
from html.parser import HTMLParser

import pytest

from sparkwarden.llm import common, html_extract
from sparkwarden.llm.html_extract import main_text

from .helpers import SF, clashing

BODY = "This is a paragraph of the article, with enough words in it to count as text of its own right."


def page(inner: str) -> str:
    return f"<html><head><title>T</title><style>p{{x}}</style><script>var a='<p>no</p>'</script></head><body><header>Site name</header><nav><ul><li><a href=/>Home</a></ul></nav>{inner}<footer>&copy; us</footer></body></html>"


def test_article():
    html = page(f"<article><h1>Head</h1><p><b>{BODY}<br><p>Short.<p>A &amp;&#65; &lt;b&gt;\n\n  c</p></article><aside>Related</aside>")
    assert main_text(html) == f"Head\n{BODY}\nShort.\nA &A <b> c"


@pytest.mark.parametrize("junk", ["<div class='cookie-notice'>We use cookies</div>", "<form><input><p>Search here please</p></form>", "<div id=comments><p>First!</p><article>reply</article></div>", "<div role=navigation>x</div>", "<ul class=menu><li>a</ul>", "<div class='ad'>Buy</div>", "<!-- hidden -->", "<section class=newsletter><p>Sign up</p></section>", "<noscript>on</noscript>"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_boilerplate_goes(junk, tag):
    paragraphs = "".join(f"<p>{BODY}{i}</p>" for i in range(4))
    want = "\n".join(f"{BODY}{i}" for i in range(4))
    assert main_text(page(f"{junk}<{tag}>{paragraphs}</{tag}>{junk}")) == want
    assert main_text(page(f"<{tag}>{paragraphs}{junk}</{tag}>")) == want


def test_unmarked_sidebar():
    side = "<div>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(20)) + "</div>"
    text = "".join(f"<p>{BODY}</p>" for _ in range(6))
    assert main_text(page(f"<div>{side}<div>{text}</div></div>")) == "\n".join([BODY] * 6)


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!--", "<script>x", "<div></div>", "&amp", "</p></p>", "<p>" * 3000 + "x"])
def test_odd_pages(html):
    assert main_text(html) in ("", "x", "<", "&", "<p")


def test_table(spark):
    pages = common.table(spark, SF, "pages")
    got = html_extract.extract(clashing(pages))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == pages.count()
    assert all(r.n_chars == len(r.text) > 0 for r in got.collect())
    odd = spark.createDataFrame([(None, None, None), (1, None, "<p>é</p>"), (1, None, "<p>é</p>")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(odd).collect()) == [(0, "", 0), (1, "é", 1), (1, "é", 1)]
    assert html_extract.extract(odd.limit(0)).count() == 0


@pytest.mark.parametrize("open_tag", ["<script>var s='<!--';</script>", "<style>/* <!-- */</style>", "<textarea><!--</textarea>", "<p title='<!--'></p>"])
def test_comment_marks_that_open_none(open_tag):
    text = "".join(f"<p>{BODY}{i}</p>" for i in range(4))
    want = "\n".join(f"{BODY}{i}" for i in range(4))
    assert main_text(page(f"{open_tag}<article>{text}</article>")) == want
    assert main_text(page(f"<article>{text}</article>{open_tag}<!-- without end <p>{BODY}</p>")) == want


@pytest.mark.parametrize("attrs", ["class='content with-sidebar'", "class=has-banner", "class='post no-comments'", "class=sidebar", "id=notice"])
def test_wrappers_with_marked_names(attrs):
    text = "".join(f"<p>{BODY}{i}</p>" for i in range(4))
    want = "\n".join(f"{BODY}{i}" for i in range(4))
    assert main_text(page(f"<div {attrs}><article>{text}</article></div>")) == want
    assert main_text(page(f"<div {attrs}>{text}</div>")) == want
    assert main_text(page(f"<article><div {attrs}>{text}</div></article>")) == want


def test_slugs_and_names_of_text_stay():
    inner = f"<h1>Head</h1><p>{BODY}</p><h2 id='social-impact'>Impact</h2><section id='cookie-law'><p>{BODY}1</p></section><h2 id=social>Social</h2><div id='related-work'><p>{BODY}2</p></div><p class='notice-text'>Note.</p>"
    assert main_text(page(f"<article>{inner}</article>")) == f"Head\n{BODY}\nImpact\n{BODY}1\nSocial\n{BODY}2\nNote."


@pytest.mark.parametrize("attrs", ["class=site_nav-links", "class='x related-posts'", "id=sidebar-left", "class=ad-1", "class='comment-list'"])
def test_compound_names_of_boilerplate_go(attrs):
    text = "".join(f"<p>{BODY}{i}</p>" for i in range(4))
    junk = f"<div {attrs}><p>{BODY} {BODY}</p></div>"
    assert BODY + " " not in main_text(page(f"<article>{text}{junk}</article>"))


class Tree(HTMLParser):
    """A page as nested lists, for the slow version: [tag, attributes, children]."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["page", [], []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.BLOCKS:
            for k in range(len(self.open) - 1, 0, -1):
                name = self.open[k][0]
                if name in html_extract.CLOSES.get(tag, ()) or name == "p" and tag != "br":
                    del self.open[k:]
                    break
                if name in html_extract.BLOCKS:
                    break
        node = [tag, attrs, []]
        self.open[-1][2].append(node)
        if tag not in html_extract.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        names = [x[0] for x in self.open[1:]]
        if tag in names:
            del self.open[len(names) - names[::-1].index(tag) :]
        self.open[-1][2].append(["/", [], []])

    def handle_data(self, data):
        self.open[-1][2].append(data)


def slow_text(html, nonsense=False):
    """Line by line and element by element, without numbers of elements; for pages whose marked elements hold less than half of the text."""
    lines, line = [], {"text": "", "tags": 0, "linked": 0, "other": False}

    def end(path):
        text = " ".join(line["text"].split())
        if text or line["other"]:
            lines.append((text, max(1, line["tags"]), min(len(text), line["linked"]), tuple(path)))
        line.update(text="", tags=0, linked=0, other=False)

    def walk(node, path, gone, unseen, link, article):
        tag, attrs, children = node
        if tag == "/":
            line["tags"] += 1
            return
        if tag in html_extract.BLOCKS:
            end(path)
        line["tags"] += tag != "page"
        if tag in html_extract.VOID:
            return
        inner = path + [id(node)] if tag in html_extract.CONTAINERS and not gone else path
        kinds[id(node)] = tag
        gone = gone or tag != "page" and html_extract._boilerplate(tag, attrs, article) > 0
        for child in children:
            if isinstance(child, list):
                walk(child, inner, gone, unseen or tag in html_extract.UNSEEN, link or tag == "a", article or tag == "article")
            elif not gone:
                line["text"] += child
                line["linked"] += len(child) if link or tag == "a" else 0
            elif not (unseen or tag in html_extract.UNSEEN) and child.strip():
                line["other"] = True
        if tag in html_extract.BLOCKS:
            end(inner)

    kinds = {}
    root = Tree(html or "").root
    walk(root, [id(root)], False, False, False, False)
    end([id(root)])
    if not lines:
        return ""
    raw = [(len(t) - n) / m for t, m, n, _ in lines]
    if nonsense:
        raw = [1 / (1 + x) for x in raw]
    ratio = []
    for i in range(len(raw)):
        near = [(math.exp(-((i - k) ** 2) / 2), raw[k]) for k in range(max(0, i - 2), min(len(raw), i + 3))]
        ratio.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    mean = sum(ratio) / len(ratio)
    bound = min(math.sqrt(sum((x - mean) ** 2 for x in ratio) / len(ratio)), max(ratio))
    content = [x >= bound - 1e-12 and len(line[0]) > 0 for x, line in zip(ratio, lines, strict=True)]

    def of(element, what):
        return sum(what(i) for i, (_, _, _, path) in enumerate(lines) if element in path)

    weight = lambda e: of(e, lambda i: len(lines[i][0]) if content[i] else 0)
    chars = lambda e: of(e, lambda i: len(lines[i][0]))
    links = lambda e: of(e, lambda i: lines[i][2])
    paths = {}
    for _, _, _, path in lines:
        for k in range(len(path)):
            paths.setdefault(path[k], path[: k + 1])
    if not weight(id(root)):
        return ""
    is_body = lambda e: kinds[e] in ("article", "main")
    region = [e for e in paths if weight(e) >= 0.7 * weight(id(root))][-1]  # elements come in page order, and those that hold most are nested
    if not any(is_body(e) for e in paths[region]):
        best = max([e for e in paths if region in paths[e] and is_body(e)], key=weight, default=region)
        region = best if 2 * weight(best) >= weight(region) else region
    while len(paths[region]) > 1:
        parent = paths[region][-2]
        a, b, c = (f(parent) - f(region) for f in (weight, links, chars))
        if 2 * a <= c and not (any(is_body(e) for e in paths[parent]) and 2 * b <= c):
            break
        region = parent
    body = any(is_body(e) for e in paths[region])
    return "\n".join(t for i, (t, _, n, path) in enumerate(lines) if t and region in path and (body or content[i] or 2 * n <= len(t)))


SOUP = [
    "<div><div>" + "".join(f"<li><a href=/{i}>Link number {i} of the menu</a></li>" for i in range(20)) + f"</div><div><h2>Head</h2><p>{BODY}</p><p>Short.</p><div><p>{BODY} {BODY}</p></div><p>{BODY}</p></div><div><a href=/>About</a> <a href=/>Terms of use</a></div></div>",
    f"<table><tr><td><a href=/>One</a><br><a href=/>Two</a></td><td><p>{BODY}<p>{BODY}<p>No.<p>{BODY}</td></tr></table>",
    f"<main><div class='content with-sidebar'><section><p>{BODY}</p><p>{BODY}</p></section><section><p>End of it.</p></section></div></main><script>if(s.indexOf('<!--')>-1)x()</script>",
    f"<article><p>{BODY}</p><math><mi>x</mi>=<mn>1</mn></math><p>{BODY}</p></article>",
    f"<div class=comments><article><p>{BODY * 9}</p></article></div><div><p>{BODY}</p><p>{BODY}</p></div>",
    f"<div class=teasers><article><p>{BODY}</p></article><article><p>{BODY * 4}</p></article></div>",
]


def test_slow_version_agrees_on_all_pages(spark):
    pages = [r.html for sf in (SF, "/root/testdata/sf0.01") for r in common.table(spark, sf, "pages").collect()]
    pages += [page(x) for x in SOUP]
    assert [main_text(h) for h in pages] == [slow_text(h) for h in pages]


def test_ratios_choose_the_region(spark, monkeypatch):
    """Without an article element or names: menus stay out and the text is whole; with the ratios turned round, nothing is as it was."""
    pages = [page(SOUP[0]), page(SOUP[1]), *[r.html for r in common.table(spark, SF, "pages").collect()]]
    want = [main_text(h) for h in pages]
    assert want[0] == f"Head\n{BODY}\nShort.\n{BODY} {BODY}\n{BODY}" and want[1] == f"{BODY}\n{BODY}\nNo.\n{BODY}"
    bare = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h in pages]
    assert all(main_text(h) == t for h, t in zip(bare, want, strict=True) if len(t) > 200)
    smoothed = html_extract.smoothed
    monkeypatch.setattr(html_extract, "smoothed", lambda r: smoothed(1 / (1 + r)))
    same = sum(a == b for a, b in zip([main_text(h) for h in pages], want, strict=True))
    assert same < 0.2 * len(pages)  # those of one line or so
