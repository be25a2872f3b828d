from opsframe.llm.page_text import FREQUENT, deduce, extract, page_texts, templates

SITE = (
    '<!DOCTYPE html><html><head><title>T {k}</title><script>var t="</p>";</script></head><body><header><p>Site name</p></header>'
    '<nav><ul><li><a href="/a">menu {k}</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy {k}</div>'
    '{open}<h1>Title {k} &amp; more</h1><p><b>First  line\n{k}.<br><p>Second&nbsp;one, 2 &lt; 3 <a href=x>with link</a>.</p>{extra}{close}'
    '<div id="comments"><p>A comment that is much longer than the article itself, on and on and on, word after word after word.</p></div>'
    '<aside>side</aside><form><p>mail?</p><input></form><footer>&copy; host</footer><!-- end'
)


def page(k, opened="<article>", close="</article>", extra=""):
    return SITE.replace("{k}", str(k)).replace("{open}", opened).replace("{close}", close).replace("{extra}", extra)


def want(k, extra=""):
    return f"Title {k} & more\nFirst line {k}.\nSecond one, 2 < 3 with link.{extra}"


def test_named_and_unnamed_articles(spark):
    plain = ('<div class="c7"><div class="inner">', "</div></div>")
    rows = [(k, f"http://a.com/{k}", page(k)) for k in range(6)]
    rows += [(10 + k, f"https://B.com/{k}", page(k, *plain, extra="<div class=x>Box</div>" if k else "")) for k in range(6)]
    rows += [(20, "http://one.org/", page(20)), (21, None, page(21)), (22, "no scheme", page(22, *plain))]
    df = spark.createDataFrame([(a, b, c, "text", 1) for a, b, c in rows], "page_id long, url string, html string, text string, host long")
    got = {r.page_id: r for r in page_texts(df).collect()}
    for k in range(6):
        assert got[k].text == want(k)
        assert got[10 + k].text == want(k, "\nBox" if k else "")
    assert [got[k].text for k in (20, 21, 22)] == [want(k) for k in (20, 21, 22)]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert {r.host for r in templates(df).collect()} == {"a.com", "b.com", "one.org", ""}
    assert FREQUENT == 0.5


def test_odd_pages(spark):
    long_ = "<article>" + "<p>word &amp; word</p>" * 30_000 + "</article>"
    deep = "<div>" * 3000 + "<p>deep</p>"
    pages = [None, "", "   ", "plain text only", "<p>open <b>tags", "<!-- only a comment", "<script>x", "<article></article>", long_, deep, "a < b > c", "</div></p><td>x"]
    rows = [(k, "http://h.com/x", p) for k, p in enumerate(pages)]
    df = spark.createDataFrame([*rows, rows[3], (None, None, None)], "page_id long, url string, html string")
    got = page_texts(df)
    assert got.count() == len(pages) + 2
    text = {r.page_id: r.text for r in got.collect()}
    assert (text[0], text[1], text[2], text[5], text[6], text[7], text[None]) == ("",) * 7
    assert text[8] == "\n".join(["word & word"] * 30_000) and text[9] == "deep"
    assert extract("plain text only", frozenset()) == "plain text only" and extract("a < b > c", frozenset()) == "a < b > c"
    assert page_texts(df.limit(0)).count() == 0


def test_submenu_and_unnamed_article(spark):
    item = "<li><a href=/a>menu</a>{}</li>"
    menu = "<ul>" + item.format("") * 5 + item.format("<ul><li><a href=/b>sub</a></li></ul>") + "</ul>"
    html = "<html><body><div class=top>" + menu + "</div><div class=c7><p>Text number {} of the host</p></div></body></html>"
    rows = [(k, f"http://menu.com/{k}", html.format(k)) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [len(r.slots) for r in templates(df).collect()] == [1]
    assert {r.page_id: r.text for r in page_texts(df).collect()} == {k: f"Text number {k} of the host" for k in range(6)}


def texts_of(spark, bodies):
    rows = [(k, f"http://h{k // 10}.com/{k}", f"<html><body>{b}</body></html>") for k, b in bodies.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in page_texts(df).collect()}


def test_all_slots_of_an_article(spark):
    nav, side = "<nav>menu</nav>", "<div class=sidebar>side words</div>"
    bodies, want = {}, {}
    for k in range(4):
        body = f"long body number {k} of the page"
        for host, (html, text) in enumerate([
            (f"<div class=c7><h1>Title {k}</h1><p>lead</p><div class=inner>{body}</div></div>", f"Title {k}\nlead\n{body}"),
            (f"<div class=a>{body}</div><div class=b>smaller box</div>", f"{body}\nsmaller box"),
            (f"<article class='post category-social'>{body}</article>", body),
            (f"<div class='content with-sidebar'>{body}{side}</div>", body),
            (f"<div class='post comments-open'>{body}</div>", body),
            (f"<div class='layout-with-sidebar'>{body}{side}</div><div class=c>brand</div>", f"{body}\nbrand"),
            (f"<article>{body}</article><article class=x>second one</article>", f"{body}\nsecond one"),
            (f"<div class=text-center>a caption</div><div class=c7>{body}</div>", f"a caption\n{body}"),
        ]):
            bodies[10 * host + k], want[10 * host + k] = nav + html, text
    bodies[69], want[69] = nav + "<article></article><div class=c>elsewhere on this page</div>", "elsewhere on this page"
    assert texts_of(spark, bodies) == want


def test_unnamed_boxes_of_constant_text_are_the_template(spark):
    menu, foot = "<div class=c1><ul><li>Home<li>About us<li>Contact</ul></div>", "<div class=c9>All rights reserved by host</div>"
    bodies, want = {}, {}
    for k in range(9):
        text = f"An article number {k} about the {k * 7919} words of page {k}"
        for host, (html, got) in enumerate([
            (f"{menu}<div class=c7>{text}</div>{foot}", text),
            (f"{menu}<div class=w><div class=c7>{text}</div><div class=c8>on day {k}</div></div>{foot}", f"{text}\non day {k}"),
            (f"{menu}<p>{text}<p>A line of all pages{foot}", f"{text}\nA line of all pages"),
            (f"{menu}<article><p>{text}</p></article><section class=c4><p>reader {k} wrote far more than the article has, more and more</section>", text),
            (f"<article><p>{text}<p class=advert>Buy now<p>end {k}<div class=responses>me too</div></article>", f"{text}\nend {k}"),
            (f"<div class=c7><p title=it's data-class=ad>{text}</p><p title='class=ad'>x {k}</p></div>{foot}", f"{text}\nx {k}"),
            (f"<div class=c7>the same words on all pages, {'more ' * 20}</div><article class=comment>{text}</article>", "the same words on all pages, " + "more " * 19 + "more"),
        ]):
            bodies[10 * host + k], want[10 * host + k] = html, got
    bodies[9], want[9] = f"{foot}<p>a page of another layout", "a page of another layout"  # one page of ten; the classes still hold
    assert texts_of(spark, bodies) == want


def test_repeated_pages_and_shared_passages_stay(spark):
    same = "<div class=c1>menu</div><div class=c7>one page again and again</div>"
    bodies = {k: same for k in range(8)}
    bodies |= {10 + k: f"<div class=c7>title {k}</div><div class=c8>{'a passage of most pages' if k < 6 else f'own {k}'}</div>" for k in range(8)}
    got = texts_of(spark, bodies)
    assert got[0] == "menu\none page again and again"
    assert got[10] == "title 0\na passage of most pages" and got[17] == "title 7\nown 7"


def test_vectors_tell_counts_apart():
    row = {"up": 1, "rank": 0, "side": 0, "pages": 8, "words": 8, "size": 8, "v1": 5, "v2": 5, "v3": 5, "low": 1, "high": 2, "all": 8}
    body = row | {"token": 1, "up": 0, "label": "body", "words": 80, "size": 80}
    box = row | {"token": 2, "label": "div a"}
    text = row | {"token": 3, "up": 2, "label": None}
    assert deduce([body, box, text]) == (frozenset([1]), frozenset([3]))
    assert deduce([body, box, text | {"v1": 6}])[1] == frozenset()
    assert deduce([body, box, text | {"pages": 7, "v1": 6}])[1] == frozenset()
