"""Pages as trees of blocks: which branches their markup names as article or as not part of it, and the text of the others.

Elements that the language ends by implication end so; what is left open ends with the page. Inline elements belong to the text around them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import xxhash

# Elements of HTML by kind, landmark roles, and words that class names and ids are made of.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEAD = {"base", "basefont", "bgsound", "link", "meta", "noscript", "script", "style", "template", "title"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are never shown as text, wherever they stand.
UNSHOWN = {"audio", "canvas", "datalist", "embed", "head", "iframe", "noembed", "noframes", "noscript", "object", "script", "style", "svg", "template", "title", "video"}
CONTROLS = {"button", "fieldset", "label", "legend", "meter", "optgroup", "option", "output", "progress", "select", "textarea"}
SIDE = {"aside", "dialog", "footer", "menu", "nav", "search"}
SIDE_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "status", "toolbar"}
SIDE_WORDS = {
    "ad", "ads", "advert", "advertisement", "advertisements", "advertising", "adverts", "alert", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "feedback", "footer",
    "form", "gdpr", "login", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies",
    "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
}
HEADER_WORDS = {"header", "masthead"}
COMMENT_WORDS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
CONTENT_WORDS = {"article", "content", "entry", "post", "story"}
#: What an element's start ends, and the elements that this doesn't reach beyond.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"})}
ENDS |= {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})} | dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, {"table"}))
SCOPE = {"td", "th", "caption", "table", "button", "object", "template", "html"}
TABLE_PARTS = {"caption", "table", "tbody", "td", "tfoot", "th", "thead", "tr"}

#: Blocks whose start leaves an open paragraph open.
WITHIN_P = TABLE_PARTS - {"table"} | {"body", "head", "html", "legend", "optgroup", "option"}
#: Deeper branches are taken as one node each.
DEPTH = 24
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element that is a block or whose markup says what it is. ``side``: why it isn't part of an article, or None; ``keep``: an article."""

    __slots__ = ("tag", "label", "side", "keep", "block", "closed", "children", "holds_article", "holds_text", "holds_h1", "n_chars")

    def __init__(self, tag: str, label: str, side: str | None, keep: bool, block: bool):
        self.tag, self.label, self.side, self.keep, self.block = tag, label, side, keep, block
        self.closed = self.holds_article = self.holds_text = self.holds_h1 = False
        self.n_chars = 0
        self.children: list[Node | str] = []


def judged(tag: str, attrs: list, in_article: bool) -> tuple[str | None, bool, str]:
    """What an element's name, role, class and id say: why it isn't part of an article ("shown", "element" or "word") or None, whether it is one, and its label."""
    if tag in UNSHOWN:
        return "shown", False, tag
    named = {k: v or "" for k, v in attrs if k in ("class", "id", "role")} if attrs else {}
    role = named.get("role", "").strip().lower()
    label = tag
    keep = tag in ("article", "main") or role in ("article", "main")
    words: set[str] = set()
    if named and tag not in ("html", "body"):
        words = {w.lower() for k in ("class", "id") for w in _WORDS.findall(named.get(k, ""))}
        label = f"{tag}.{' '.join(sorted(w.lower() for w in _WORDS.findall(named.get('class', ''))))}" if "class" in named else tag
    if keep:
        return ("word", False, label) if words & COMMENT_WORDS else (None, True, label)
    if tag in SIDE or role in SIDE_ROLES or tag in CONTROLS or (tag == "header" and not in_article):
        return "element", False, label
    if tag == "form" or words & SIDE_WORDS or (words & HEADER_WORDS and not in_article and not words & CONTENT_WORDS):
        return "word", False, label
    return None, False, label


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "html", None, False, True)
        self.stack: list[tuple[str, Node | None]] = [("html", self.root)]
        self.at = self.root
        self.counts = Counter(["html"])
        self.articles = 0
        self.doubtful: list[list[Node]] = []
        self.title: list[str] = []

    def leave(self, k: int, closed: bool = False) -> None:
        """End the open elements from the k-th on; ``closed``: the k-th by its own end tag."""
        while len(self.stack) > k:
            tag, node = self.stack.pop()
            self.counts[tag] -= 1
            if node is None:
                continue
            node.closed = closed and len(self.stack) == k
            if node.keep:
                self.articles -= 1
                if node.tag == "main" and node.holds_article:
                    node.keep = False
            # markup that surrounds an article and isn't ended, or is but a word or a form, says nothing of it
            if node.side and node.holds_article and (node.side == "word" or (node.side == "element" and not node.closed)):
                node.side = None
            self.at = next(n for _, n in reversed(self.stack) if n is not None)
            if node.side != "shown":
                self.at.n_chars += node.n_chars
                self.at.holds_h1 |= node.holds_h1 or tag == "h1"
            if node.side == "word" and node.holds_h1:
                self.doubtful.append([node, *(n for _, n in reversed(self.stack) if n is not None)])
            if not node.side:
                self.at.holds_text |= node.holds_text
                self.at.holds_article |= node.holds_article or (node.keep and node.holds_text)

    def open_at(self, tags: set[str], bounds: set[str]) -> int:
        if not any(self.counts[t] for t in tags):
            return 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in tags:
                return k
            if self.stack[k][0] in bounds:
                return 0
        return 0

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and len(self.stack) > 1:
            k = self.open_at({"head"}, set())
            if k:
                self.leave(k)
            if tag == "html" or self.open_at({"body"}, set()):
                return
        elif tag == "html":
            return
        if tag not in HEAD and self.stack[-1][0] == "head":
            self.leave(len(self.stack) - 1)
        if tag in BLOCKS:
            if tag not in WITHIN_P:
                k = self.open_at({"p"}, SCOPE)
                if k:
                    self.leave(k)
            if tag in HEADINGS and self.stack[-1][0] in HEADINGS:
                self.leave(len(self.stack) - 1)
            if tag in ENDS:
                k = self.open_at(*ENDS[tag])
                if k:
                    self.leave(k)
        if tag in VOID:
            if tag == "br":
                self.at.children.append(" ")
            elif tag == "hr":
                self.at.children.append(Node(tag, tag, None, False, True))
            return
        side, keep, label = judged(tag, attrs, self.articles > 0)
        block = tag in BLOCKS and tag != "head"
        node = None
        if block or side or keep:
            node = Node(tag, label, side, keep, block or keep)
            self.at.children.append(node)
            self.at = node
            self.articles += keep
        self.stack.append((tag, node))
        self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and len(self.stack) > 1 and self.stack[-1][0] == tag:
            self.leave(len(self.stack) - 1, True)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.at.children.append(" ")
            return
        inline = tag not in BLOCKS and tag not in CONTROLS and tag not in UNSHOWN
        open_tags = range(len(self.stack) - 1, 0, -1) if self.counts[tag] or tag in HEADINGS else ()
        for k in open_tags:
            name = self.stack[k][0]
            if name == tag or (tag in HEADINGS and name in HEADINGS):
                self.leave(k, True)
                return
            if (inline and name in BLOCKS) or (tag in HEADINGS and name not in HEADINGS and not self.counts[tag]) or (name in SCOPE and tag not in TABLE_PARTS) or (name == "table" and tag != "table"):
                break
        if tag == "p":
            self.at.children.append(Node("p", "p", None, False, True))

    def handle_data(self, data):
        top = self.stack[-1][0]
        if top == "title":
            self.title.append(data)
        elif top == "head" and data.strip():
            self.leave(len(self.stack) - 1)
        self.at.children.append(data)
        self.at.n_chars += len(data)
        if not self.at.holds_text and not self.at.side and not data.isspace():
            self.at.holds_text = True

    def done(self) -> None:
        """End what is open. A form, or an element set aside by a word, that holds a first heading and most of the page is what the page stands in."""
        self.close()
        self.leave(1)
        for node, *around in self.doubtful:
            if node.side and 2 * node.n_chars > self.root.n_chars:
                node.side = None
                for outer in around:
                    if outer.side:
                        break
                    outer.holds_text |= node.holds_text
                    outer.holds_article |= node.holds_article


def parse(html: str | None) -> tuple[Node, str]:
    """A page's root and its title."""
    builder = _Builder()
    builder.feed(html or "")
    builder.done()
    return builder.root, " ".join("".join(builder.title).split())


def parts(node: Node) -> list[Node | str]:
    """A node's branches: elements that are blocks, and the runs of text between them, white space as one blank."""
    out: list[Node | str] = []
    run: list[str] = []
    for child in node.children:
        if isinstance(child, str):
            run.append(child)
        elif child.block:
            if run:
                out.append(" ".join("".join(run).split()))
                run = []
            out.append(child)
        elif not child.side:
            run += inline_text(child)
    if run:
        out.append(" ".join("".join(run).split()))
    return [x for x in out if x != ""]


def inline_text(node: Node) -> list[str]:
    """The text of an inline element whose markup named something that it turned out not to be."""
    out, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            out.append(child)
        elif not child.side:
            todo += reversed(child.children)
    return out


def blocks(node: Node) -> Iterator[str]:
    """The texts of a branch's blocks in page order, without what its markup sets aside."""
    todo = [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            yield part
        elif not part.side:
            todo += reversed(parts(part))


def everything(node: Node) -> str:
    """All text of a branch, for a look at whether it is the same on other pages."""
    out, todo = [], [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        elif part.side != "shown":
            todo += reversed(part.children)
    return " ".join("".join(out).split())


def articles(node: Node) -> Iterator[str]:
    """The texts of the articles' blocks in a branch that is no article itself."""
    todo = [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str) or part.side:
            continue
        if part.keep:
            yield from blocks(part)
        elif part.holds_article:
            todo += reversed(parts(part))


def digest(*of) -> int:
    """A signed 64-bit digest."""
    x = xxhash.xxh64_intdigest("\x1f".join(map(str, of)))
    return x - (1 << 64) if x >> 63 else x


class Branch:
    """A node's place in its site's tree. ``style``: digest of its branches' labels, or of its text where ``size``, the number of its branches, is 0."""

    __slots__ = ("path", "style", "size", "spread", "node", "branches")

    def __init__(self, path: list[int], spread: float, node: Node | str):
        self.path, self.spread, self.node, self.branches = path, spread, node, []


def site_branches(root: Node) -> list[Branch]:
    """A page's branches, a branch before those it holds. What markup settles, an article or what isn't part of one, has no branches here.

    A branch is known by its parent, the labels beside it, its position among them and its own label; its spread is the part of the page that it gets if all branches of a node share alike.
    """
    first = Branch([digest("root", root.holds_article)], 1.0, root)
    out, todo = [], [first]
    while todo:
        branch = todo.pop()
        out.append(branch)
        node = branch.node
        if isinstance(node, str):
            branch.style, branch.size = digest(node), 0
            continue
        held = [] if node.side or node.keep or len(branch.path) >= DEPTH else [p for p in parts(node) if isinstance(p, str) or p.children]
        if not any(isinstance(p, Node) for p in held):
            branch.style, branch.size = digest(everything(node)), 0
            continue
        labels = ["#" if isinstance(p, str) else p.label for p in held]
        branch.style, branch.size = digest(*labels), len(held)
        for k, (label, part) in enumerate(zip(labels, held)):
            branch.branches.append(Branch([*branch.path, digest(branch.path[-1], branch.style, k, label)], branch.spread / len(held), part))
        todo += reversed(branch.branches)
    return out


def main_text(root: Node, low: set[int], high: set[int]) -> tuple[str, int, int]:
    """A page's main text; how many branches the site's tree removed, and how many others the markup set aside.

    A branch goes if it and all that it holds are ``low``. Where the page has an article, what stands outside goes as well, but for ``high`` branches and headings of the first rank.
    """
    lines: list[str] = []
    by_tree = by_markup = 0
    branches = site_branches(root)
    noisy: set[int] = set()
    for branch in reversed(branches):
        if branch.path[-1] in low and all(b.path[-1] in noisy for b in branch.branches):
            noisy.add(branch.path[-1])
    todo = [(branches[0], not root.holds_article)]
    while todo:
        branch, keep = todo.pop()
        node, name = branch.node, branch.path[-1]
        if isinstance(node, Node) and (node.keep or node.holds_article) and not node.side:
            if node.keep:
                lines += blocks(node)
            elif branch.branches:
                todo += ((b, keep) for b in reversed(branch.branches))
            else:
                lines += articles(node)
            continue
        if name in noisy:
            by_tree += 1
            continue
        if isinstance(node, Node) and node.side:
            by_markup += 1
            continue
        keep = keep or name in high or (isinstance(node, Node) and node.tag == "h1")
        if branch.branches:
            todo += ((b, keep) for b in reversed(branch.branches))
        elif keep:
            lines += [node] if isinstance(node, str) else blocks(node)
        else:
            by_tree += 1
    return "\n".join(x for x in lines if x), by_tree, by_markup
