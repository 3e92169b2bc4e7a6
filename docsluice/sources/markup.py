"""XML and HTML texts to trees, and CSS selectors over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

from docsluice.lang.values import Raised

# fixed values: elements of HTML without content, and what closes an open element of the same family
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, **{t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
}
FENCES = frozenset("table ul ol dl div section article body html td th button".split())


def xml_tree(text: str) -> Element:
    if re.search(r"<!(DOCTYPE|ENTITY)", text):
        raise Raised("XML with a document type is refused")
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise Raised(f"XML: {e}") from None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html")
        self.head, self.body = ElementTree.SubElement(self.root, "head"), ElementTree.SubElement(self.root, "body")
        self.open: list[Element] = [self.root, self.body]

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head", "body"):
            target = {"html": self.root, "head": self.head, "body": self.body}[tag]
            for k, v in attributes.items():
                target.attrib.setdefault(k, v)
            if tag != "html":
                self.open = [self.root, target]
            return
        if tag in ("title", "meta", "link", "base", "style") and len(self.open) == 2 and not len(self.body) and not (self.body.text or "").strip():
            self.open = [self.root, self.head]
        elif self.open[1] is self.head and len(self.open) == 2 and tag not in ("script", "title", "meta", "link", "base", "style"):
            self.open = [self.root, self.body]
        gone = CLOSES.get(tag, ())
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k].tag in gone:
                del self.open[k:]
                break
            if self.open[k].tag in FENCES:
                break
        e = ElementTree.SubElement(self.open[-1], tag, dict(reversed(attributes.items())))
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if len(self.open) == 2 and self.open[1] is self.head and data.strip():
            self.open = [self.root, self.body]
        e = self.open[-1]
        if len(e):
            e[-1].tail = (e[-1].tail or "") + data
        else:
            e.text = (e.text or "") + data


def html_tree(text: str) -> Element:
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def text_of(e: Element) -> str:
    return "".join(e.itertext())


_SIMPLE = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<w>[\w-]+))\s*(?P<i>[iI])?\s*)?\]|:(?P<pseudo>[\w-]+)(?P<open>\()?""")


class _Compound:
    def __init__(self) -> None:
        self.tests: list = []


def _selector(text: str) -> list[list[tuple[str, list]]]:
    """Alternatives, each a chain of (combinator, tests)."""
    at, out, chain, join = 0, [], [], " "
    while at < len(text):
        if m := re.compile(r"\s*([>+~,])\s*|\s+").match(text, at):
            at = m.end()
            if m[1] == ",":
                out.append(chain)
                chain, join = [], " "
            else:
                join = m[1] or " "
            continue
        tests = []
        while at < len(text) and (m := _SIMPLE.match(text, at)):
            at = m.end()
            if m["open"]:
                depth, start = 1, at
                while depth and at < len(text):
                    depth += {"(": 1, ")": -1}.get(text[at], 0)
                    at += 1
                tests.append(("pseudo", m["pseudo"], text[start : at - 1]))
            elif m["pseudo"]:
                tests.append(("pseudo", m["pseudo"], None))
            elif m["attr"]:
                tests.append(("attr", m["attr"], m["op"], next((x for x in (m["q"], m["s"], m["w"]) if x is not None), None), bool(m["i"])))
            else:
                tests.append(next((k, m[k]) for k in ("tag", "id", "cls") if m[k] is not None))
        if not tests:
            raise Raised(f"CSS: unexpected {text[at]!r}")
        chain.append((join if chain else "", tests))
        join = " "
    return [*out, chain]


def _nth(formula: str, k: int) -> bool:
    formula = {"odd": "2n+1", "even": "2n"}.get(formula.strip(), formula.replace(" ", ""))
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", formula):
        a = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
        b = int(m[2] or 0)
        return (k - b) % a == 0 and (k - b) // a >= 0 if a else k == b
    return k == int(formula)


def select(root: Element, text: str) -> list[Element]:
    parents = {c: p for p in root.iter() for c in p}
    alternatives = _selector(text.strip())

    def simple(e: Element, t: tuple) -> bool:
        kind = t[0]
        if kind == "tag":
            return t[1] == "*" or e.tag == t[1].lower()
        if kind == "id":
            return e.attrib.get("id") == t[1]
        if kind == "cls":
            return t[1] in e.attrib.get("class", "").split()
        if kind == "attr":
            if t[1] not in e.attrib:
                return False
            if t[2] is None:
                return True
            v, w = (e.attrib[t[1]].lower(), t[3].lower()) if t[4] else (e.attrib[t[1]], t[3])
            return {"=": v == w, "~=": w in v.split(), "|=": v == w or v.startswith(w + "-"), "^=": bool(w) and v.startswith(w), "$=": bool(w) and v.endswith(w), "*=": bool(w) and w in v}[t[2]]
        name, arg = t[1], t[2]
        p = parents.get(e)
        siblings = list(p) if p is not None else [e]
        same = [s for s in siblings if s.tag == e.tag]
        if name in ("not", "is", "where"):
            return any(matches(e, c) for c in _selector(arg)) != (name == "not")
        if name == "has":
            return any(d is not e and any(matches(d, c) for c in _selector(arg)) for d in e.iter())
        if name == "root":
            return p is None
        if name == "empty":
            return not len(e) and not (e.text or "")
        if name in ("first-child", "last-child", "only-child"):
            return (name == "last-child" or siblings[0] is e) and (name == "first-child" or siblings[-1] is e)
        if name in ("first-of-type", "last-of-type", "only-of-type"):
            return (name == "last-of-type" or same[0] is e) and (name == "first-of-type" or same[-1] is e)
        if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
            among = same if name.endswith("type") else siblings
            k = among.index(e)
            return _nth(arg, len(among) - k if "last" in name else k + 1)
        raise Raised(f"CSS: no pseudo-class {name}")

    def matches(e: Element, chain: list, upto: int | None = None) -> bool:
        k = len(chain) - 1 if upto is None else upto
        join, tests = chain[k]
        if not all(simple(e, t) for t in tests):
            return False
        if k == 0:
            return True
        return any(matches(x, chain, k - 1) for x in related(e, join))

    def related(e: Element, join: str) -> Iterator[Element]:
        p = parents.get(e)
        if join == ">":
            if p is not None:
                yield p
        elif join == " ":
            while p is not None:
                yield p
                p = parents.get(p)
        elif p is not None:
            before = list(p)[: list(p).index(e)]
            yield from before[-1:] if join == "+" else before

    return [e for e in root.iter() if any(matches(e, c) for c in alternatives)]
