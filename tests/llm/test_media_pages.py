"""Text of valid and slightly broken pages is not dropped."""

import pytest

from veritab.llm import media


def items(html):
    return [i["text"] if i["kind"] == "text" else (i["digest"], i["caption"]) for i in media.sequence_of(html)]


def img(name):
    return f'<img src="sha256:{name}" alt="alt">'


@pytest.mark.parametrize("html, want", [
    (f"<figure><figcaption>cap</figcaption>{img('a')}{img('b')}</figure><p>t</p>", [("a", "cap"), ("b", "cap"), "t"]),
    (f"<figure>{img('a')}<figcaption>cap</figcaption>{img('b')}</figure>", [("a", "cap"), ("b", "cap")]),
    ("<p>t</p><figure><figcaption>cap</figcaption><pre>code</pre></figure><p>u</p>", ["t", "cap", "code", "u"]),
    ("<p>t</p><figure>code<figcaption>cap</figcaption></figure>", ["t", "code", "cap"]),
    ("<p>t</p><figcaption>cap</figcaption><p>u</p>", ["t", "cap", "u"]),
    ("<figcaption>cap<p>u</p>" + img("a"), ["cap", "u", ("a", "alt")]),
    (f"<figure>{img('a')}<figcaption>cap</figure><p>t</p>{img('b')}", [("a", "cap"), "t", ("b", "alt")]),
    (f"<figure>{img('a')}<figcaption>cap", [("a", "cap")]),
    (f"<div><figure>{img('a')}<figcaption>cap</div><p>t</p>", [("a", "cap"), "t"]),
    (f"<figure>{img('a')}<figcaption>one<figcaption>two</figure><p>t</p>", [("a", "one two"), "t"]),
    (f"<figure><figure>{img('a')}<figcaption>in</figcaption></figure>{img('b')}<figcaption>out</figcaption></figure>", [("a", "in"), ("b", "out")]),
    (f"<figure>{img('a')}<figcaption></figcaption></figure>", [("a", "alt")]),
    (f"<html><head><title>no</title><meta charset=utf-8><body><p>t</p>{img('a')}", ["t", ("a", "alt")]),
    (f"<head><title>no</title><style>x</style><p>t</p>{img('a')}", ["t", ("a", "alt")]),
    ("<head><title>no</title>\n text<p>t", ["text", "t"]),
    ("<head><title>no<body><p>t", ["t"]),
    (f"<nav>menu<p>t</p>{img('a')}", ["menu", "t", ("a", "alt")]),
    (f"<div><nav>menu</div><p>t</p>{img('a')}<footer>foot", ["menu", "t", ("a", "alt"), "foot"]),
    (f"<nav>menu<p>m</p>{img('x')}</nav><p>t</p><footer><div>f</footer>u", ["t", "u"]),
    ("<nav>open<p>t</p><nav>menu</nav><p>u</p>", ["open", "t", "u"]),
])
def test_pages(html, want):
    assert items(html) == want
