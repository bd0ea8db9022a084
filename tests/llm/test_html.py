import random
from html import escape
from html.parser import HTMLParser

from quillspark.llm import html


def page(rng):
    """A page and its article's text, from random parts."""
    words = lambda n: " ".join(rng.choice(["stone", "river", "lamp", "&", "<b", "naïve", "the", "of", "x"]) for _ in range(n))
    title, paras = words(rng.randint(1, 8)), [words(rng.choice([1, 3, 12, 80])) for _ in range(rng.randint(1, 6))]
    menu = "".join(f"<li><a href='/{i}'>{escape(words(1))}</a></li>" for i in range(rng.randint(1, 9)))
    chrome = [f"<nav><ul>{menu}</ul></nav>", f"<div class='ad'>{escape(words(9))}</div>", f"<aside class=side>{escape(words(40))}</aside>", f"<header><p>{escape(words(12))}</p></header>", f"<div id=cookie-notice>{escape(words(20))}</div>", f"<form><label>{escape(words(3))}</label><input name=q></form>"]
    rng.shuffle(chrome)
    inner = [f"<h1>{escape(title)}</h1>"] + [f"<p>{escape(p)}" + rng.choice(["</p>", "", "<br>", "</p>\n"]) for p in paras]
    inner.insert(rng.randint(1, len(inner)), f"<div class='advert'>{escape(words(30))}</div>")
    after = f"<section class=comments><p>{escape(words(50))}</p></section><footer>&copy; {escape(words(6))}</footer>"
    h = f"<!DOCTYPE html><html><head><title>{escape(title)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{''.join(chrome[:4])}<article>{''.join(inner)}</article>{''.join(chrome[4:])}{after}</body></html>"
    return h, " ".join(" ".join([title, *paras]).split())


def test_articles_come_whole_and_alone():
    rng = random.Random(2)
    for _ in range(300):
        h, want = page(rng)
        assert html.main_text(h) == want


def test_details():
    art = lambda x: html.main_text(f"<body><nav><a href=x>m</a></nav><article>{x}</article></body>")
    assert art("<p>a<b>b</b>c&nbsp;&amp;&eacute;&#x41;</p><p>d\n\t e</p>") == "abc &éA d e"
    assert art("<p>x<!-- <p>no</p> -->y<script>if (a<b) '</p>'</script>z") == "xyz"
    assert art("<p title='a>b'>in 3 < 4</p>") == "in 3 < 4"
    assert art("<ul><li>one<li>two</ul><table><tr><td>c<td>d</table>") == "one two c d"
    assert art("<p>open <i>tags <p>next") == "open tags next"
    assert html.main_text("just words") == "just words"
    assert html.main_text("<!-- never closed <p>x") == "" and html.main_text("<script>x") == "" and html.main_text("") == ""


def test_pages_without_an_article_go_by_density():
    menu = "".join(f"<li><a href='{i}'>menu {i}</a></li>" for i in range(8))
    text = "This paragraph has a good many words and no links at all, so that it is text. " * 2
    h = f"<body><ul>{menu}</ul><p>{text}</p><p>{text}</p><ul>{menu}</ul></body>"
    assert html.main_text(h) == " ".join((text + text).split())


def test_very_long_and_broken_pages_end():
    assert len(html.main_text("<article><p>" + "word " * 300_000)) == 5 * 300_000 - 1
    html.main_text("<" * 50_000 + "a='" * 20_000)
    html.main_text("<div>" * 20_000 + "x")


def test_tree_fits_its_table():
    x, y = html.labelled()
    assert (html.trained().predict(x) == y).mean() > 0.97


def test_parts_of_articles_stay_whatever_they_are_named():
    art = lambda x: html.main_text(f"<body><nav><a href=x>m</a></nav><article>{x}</article></body>")
    long = "Body text that goes on for a while and has no links at all in it, as texts do."
    assert art(f'<div class="entry-header"><h1>Real title</h1></div><p>{long}</p>') == f"Real title {long}"
    assert art(f'<p>{long}</p><p class="related">{long}</p>') == f"{long} {long}"
    assert art(f'<p>{long}</p><p class="form">The form of the poem is strict.</p>') == f"{long} The form of the poem is strict."
    links = "".join(f"<li><a href={i}>Another story {i}</a></li>" for i in range(5))
    assert art(f'<p>{long}</p><div class="related"><ul>{links}</ul></div>') == long
    assert art(f'<p>{long}</p><div class="advert">{long}</div><div class=comments><p>{long}</p></div>') == long


def test_words_and_link_density_decide():
    """Without them, of the blocks and of their neighbours, the tree says something else."""
    tree = html.trained()
    long = "Body text that goes on for a while and has no links at all in it, as texts do."
    links = "".join(f"<li><a href={i}>Another story {i}</a></li>" for i in range(5))
    pages = [f"<article><p>{long}</p><div class=related><ul>{links}</ul></div><div class=tags>{long}</div></article>", f"<body><ul>{links}</ul><p>{long}</p><p>Short one.</p><p>{long}</p><ul>{links}</ul><p>Imprint of the house</p><p>All rights are kept</p></body>", f"<body><p>{long}</p><p><a href=x>Up</a></p><p>{long}</p></body>"]
    for columns in ([0, 2, 4], [1, 3, 5]):
        changed = 0
        for p in pages:
            x = html.features(html.blocks(p))
            less = x.copy()
            less[:, columns] = 0
            changed += int((tree.predict(x) != tree.predict(less)).sum())
        assert changed > 0, columns


class Slow(HTMLParser):
    """The same blocks of a well-formed page, read by the standard library, a tag at a time."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.linked, self.blocks = [], "", "", []

    def flush(self):
        words = self.text.split()
        if words:
            has = lambda k: any(m[k] for _, m in self.open)
            self.blocks.append((" ".join(words), len(words), min(1.0, len(self.linked.split()) / len(words)), has(1), has(0), any(n in ("h1", "h2", "h3") for n, _ in self.open), has(2)))
        self.text = self.linked = ""

    def handle_starttag(self, name, attrs):
        if name == "br":
            self.text += " "
        if name in html.BLOCK:
            self.flush()
        if name in html.VOID or name == "br":
            return
        inside = any(m[1] for _, m in self.open)
        chrome, article, hint = html._marks(name, " ".join(f'{k}="{v or ""}"' for k, v in attrs), inside)
        self.open.append((name, (chrome or name == "header" and not inside, article, hint)))

    def handle_endtag(self, name):
        if name in html.BLOCK:
            self.flush()
        if name in [n for n, _ in self.open]:
            while self.open.pop()[0] != name:
                pass

    def handle_data(self, data):
        if not any(n in ("script", "style", "title", "textarea", "head") for n, _ in self.open):
            self.text += data
            if any(n == "a" for n, _ in self.open):
                self.linked += data + " "


def test_against_a_slow_version():
    """Another parser, and the tree walked a block at a time."""
    rng = random.Random(11)

    def walk(tree, row):
        while tree.feature is not None:
            tree = tree.below if row[tree.feature] <= tree.cut else tree.above
        return tree.value

    for _ in range(150):
        words = lambda n: " ".join(rng.choice(["stone", "river", "lamp", "&amp;", "naïve", "the"]) for _ in range(n))
        part = lambda: rng.choice([f"<p>{words(rng.randint(1, 50))}</p>", f"<h2>{words(3)}</h2>", f"<div class='{rng.choice(['related', 'tags', 'ad', 'box'])}'><p><a href='x'>{words(2)}</a> {words(rng.randint(0, 5))}</p></div>", f"<ul><li>{words(4)}</li><li><a href='y'>{words(2)}</a></li></ul>"])
        body = "".join(part() for _ in range(rng.randint(1, 8)))
        page = f"<html><head><title>t</title></head><body><nav><a href='m'>{words(2)}</a></nav>{part()}{f'<article>{body}</article>' if rng.random() < 0.6 else body}{part()}<footer>{words(5)}</footer></body></html>"
        slow = Slow()
        slow.feed(page)
        slow.flush()
        assert html.blocks(page) == slow.blocks
        x = html.features(slow.blocks)
        assert html.main_text(page) == " ".join(b[0] for b, row in zip(slow.blocks, x) if walk(html.trained(), row))


def test_on_spark(spark):
    rng = random.Random(4)
    pages = [page(rng) for _ in range(40)]
    df = spark.createDataFrame([(i, f"http://x/{i}", h, "extra") for i, (h, _) in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract_main_text(df).collect()}
    assert all(got[i].text == t and got[i].n_chars == len(t) and got[i].url == f"http://x/{i}" for i, (_, t) in enumerate(pages))
