"""Reading nested markup inside Spark tasks: one page in, a few flat records out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_SAME = frozenset(("p", "li", "td", "th", "tr", "option"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                stack.extend(reversed(item.children))
        return "".join(out)

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_SAME and self.here.tag == tag:
            self.here = self.here.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def tree(html: str | Node | None) -> Node:
    """The tree of a page; one that is read already is itself."""
    if isinstance(html, Node):
        return html
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def tidy(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def has_class(*names: str) -> Callable[[Node], bool]:
    return lambda n: any(c in names for c in n.classes)


def _text_of(node: Node | None) -> str:
    return node.text() if node is not None else ""


# Class marks of the tagged fields of a course block.
BLOCK_FIELDS = {
    "courseblocktitle": "title",
    "courseblockdesc": "desc",
    "courseblockextra": "extra",
    "courseblockterms": "terms",
    "courseblockhours": "hours",
    "courseblockinstructors": "names",
}
DETAIL_CODE = re.compile(r"detail-\w*code")


def _block_parts(block: Node) -> tuple[dict[str, Node], list[Node], list[Node]]:
    """First node of each tagged field, the prose nodes and the links, in one walk."""
    first: dict[str, Node] = {}
    prose, links = [], []
    for n in block.walk():
        classes = n.classes
        if n.tag == "a":
            if "href" in n.attrs:
                links.append(n)
        elif n.tag in ("h3", "h4", "strong"):
            first.setdefault("bold", n)
        if not classes:
            continue
        for c in classes:
            if c in BLOCK_FIELDS:
                first.setdefault(BLOCK_FIELDS[c], n)
        if "courseblockextra" in classes or "noindent" in classes:
            prose.append(n)
        if "courseblockprereq" in classes or "detail-prerequisites" in n.attrs["class"]:
            first.setdefault("prereq", n)
        if n.tag in ("span", "div"):
            for c in classes:
                if c == "detail-title":
                    first.setdefault("detail_title", n)
                elif DETAIL_CODE.fullmatch(c):
                    first.setdefault("detail_code", n)
                elif c.startswith("detail-hours"):
                    first.setdefault("detail_hours", n)
    return first, prose, links


def course_blocks(html: str) -> Iterator[dict]:
    """Tagged fields of each course block; headings keep their spacing."""
    for block in tree(html).all(has_class("courseblock")):
        first, prose, links = _block_parts(block)

        def said(field: str) -> str:
            return tidy(_text_of(first.get(field)))

        number = re.sub(r"[.\s]+$", "", said("detail_code"))
        title = re.sub(r"\.$", "", said("detail_title"))
        detail = bool(number and title)
        hours = re.sub(r"\.$", "", re.sub(r"^\((.*)\)$", r"\1", said("detail_hours")))
        heading = _text_of(first.get("title")) or _text_of(first.get("bold"))
        link = next((a for a in links if "schedlink" in a.classes), None) or next(
            (a for a in links if a.attrs["href"].startswith(("/courses", "/subjects"))), None
        )
        yield {
            "detail_number": number if detail else None,
            "detail_title": title if detail else None,
            "detail_credits": hours or None,
            "heading": None if detail else heading,
            "description": said("desc") or said("extra") or None,
            "extras": tidy("".join(n.text() for n in prose)),
            "prerequisites": said("prereq") if "prereq" in first else None,
            "terms": said("terms") or None,
            "hours": said("hours") or None,
            "instructors": said("names"),
            "href": link.attrs["href"] if link else None,
        }


def search_results(html: str) -> Iterator[dict]:
    """Heading, description and link of each search-result article."""
    for article in tree(html).all(lambda n: n.tag == "article" and "search-courseresult" in n.classes):
        link = article.first(lambda n: n.tag == "a" and "href" in n.attrs)
        yield {
            "heading": _text_of(article.first(lambda n: n.tag == "h3")),
            "description": tidy(_text_of(article.first(has_class("courseblockdesc")))) or None,
            "href": link.attrs["href"] if link else None,
        }


def listed_links(html: str) -> Iterator[dict]:
    """Course links of a list page with the text of the element around them."""
    for link in tree(html).all(lambda n: n.tag == "a" and "preview_course" in n.attrs.get("href", "")):
        around = link.parent
        while around.parent is not None and around.tag not in ("li", "td", "div"):
            around = around.parent
        label = tidy(link.text())
        inside = tidy(around.text()) if around.parent is not None else ""
        yield {
            "heading": label,
            "description": inside.replace(label, "", 1) or None,
            "href": link.attrs["href"],
        }


def title_cells(html: str) -> Iterator[dict]:
    """Title cells of a class listing with the text cell of the next row."""
    root = tree(html)
    after: dict[int, Node] = {}  # the element that follows each row
    for holder in [root, *root.walk()]:
        inside = [c for c in holder.children if isinstance(c, Node)]
        after.update((id(a), b) for a, b in zip(inside, inside[1:]) if a.tag == "tr")
    for cell in root.all(lambda n: n.tag == "td" and "nttitle" in n.classes):
        row = cell.parent
        while row is not None and row.tag != "tr":
            row = row.parent
        follower = after.get(id(row))
        below = None
        if follower is not None and follower.tag == "tr":
            below = follower.first(lambda n: n.tag == "td" and "ntdefault" in n.classes)
        yield {"heading": tidy(cell.text()), "description": tidy(_text_of(below)) or None, "href": None}


def menu_options(html: str) -> Iterator[dict]:
    """Options of every menu: the menu's name, and each option's value and label."""
    for menu in tree(html).all(lambda n: n.tag == "select"):
        for option in menu.all(lambda n: n.tag == "option"):
            yield {
                "menu": menu.attrs.get("name", ""),
                "value": tidy(option.attrs.get("value", "")),
                "label": tidy(option.text()),
            }


def block_passages(html: str) -> Iterator[dict]:
    """Title of each course block and then its passages, each passage once; a page without blocks whole."""
    root = tree(html)
    seen: set[str] = set()
    blocks = root.all(has_class("courseblock"))
    for block in blocks:
        yield {"passage": "## " + tidy(_text_of(block.first(has_class("courseblocktitle"))))}
        for node in block.all(lambda n: n.tag in ("p", "div")):
            said = tidy(node.text())
            if said and said not in seen:
                seen.add(said)
                yield {"passage": said}
    if not blocks:
        yield {"passage": tidy(root.text())}
