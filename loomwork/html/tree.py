"""A small element tree over the standard library's parser, and what is read off it. Broken markup never raises."""

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

VOID = set("area base br col embed hr img input link meta source track wbr".split())
SILENT = {"script", "style", "noscript", "template"}
BLOCKS = set("p div section article main li ul ol dl dt dd table tr td th h1 h2 h3 h4 h5 h6 header footer nav aside form br blockquote pre figure".split())
FRAME = {"nav", "header", "footer", "aside", "form"}
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *tags):
        return [n for n in self.walk() if n.tag in tags]

    def classes(self):
        return (self.attrs.get("class") or "").split()

    def text(self, sep="\n"):
        """Visible text, blocks apart by ``sep``, white space collapsed within."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in SILENT:
                edge = ["\0"] if node.tag in BLOCKS else []
                todo.extend(edge + list(reversed(node.children)) + edge)
        parts = (re.sub(r"\s+", " ", x).strip() for x in "".join(out).split("\0"))
        return sep.join(x for x in parts if x)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        node = self.at
        stop = {"ul", "ol", "dl", "table", "div", "section", "#root"} if tag in ("li", "p", "dt", "dd") else {"table", "#root"}
        while node.tag not in stop:
            if node.tag in CLOSES.get(tag, ()):
                self.at = node.parent
            node = node.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.tag not in (tag, "#root"):
            node = node.parent
        if node.tag == tag and node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html):
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


STEP = re.compile(r"^([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+|\[[^\]]+\]|:first-child)*)$")


def _fits(node, simple):
    m = STEP.match(simple)
    if not m or node.tag == "#root" or m[1] not in (None, "*", node.tag):
        return False
    for part in re.findall(r"[#.][\w-]+|\[[^\]]+\]|:first-child", m[2]):
        if part[0] == "#" and node.attrs.get("id") != part[1:] or part[0] == "." and part[1:] not in node.classes():
            return False
        if part == ":first-child" and next((c for c in node.parent.children if isinstance(c, Node)), None) is not node:
            return False
        if part[0] == "[":
            name, op, value = re.match(r"\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*['\"]?([^'\"\]]*)['\"]?)?\s*\]", part).groups()
            have = node.attrs.get(name)
            if have is None or op and not {"=": have == value, "~=": value in have.split(), "^=": have.startswith(value), "$=": have.endswith(value), "*=": value in have}[op]:
                return False
    return True


def select(root, selector):
    """Nodes matching a selector of tags, ids, classes, attributes, ' ' and '>' in document order; ',' unites."""
    wanted = [re.findall(r">|[^\s>]+", one) for one in selector.split(",")]

    def matches(node, steps):
        if not _fits(node, steps[-1]):
            return False
        rest, up = steps[:-1], node.parent
        if not rest:
            return True
        if rest[-1] == ">":
            return up is not None and matches(up, rest[:-1])
        while up is not None:
            if matches(up, rest):
                return True
            up = up.parent
        return False

    return [n for n in root.walk() if n.tag != "#root" and any(matches(n, s) for s in wanted)]


def cleaned(html, level="moderate"):
    """Text without scripts and styles (light), without page furniture (moderate), without forms, media and comments (aggressive)."""
    root = parse(html)
    drop = SILENT | (FRAME if level != "light" else set()) | ({"iframe", "svg", "video", "audio", "button", "input", "select"} if level == "aggressive" else set())
    return _without(root, drop).text()


def _without(root, tags):
    for n in list(root.walk()):
        n.children = [c for c in n.children if not (isinstance(c, Node) and (c.tag in tags or "display:none" in c.attrs.get("style", "").replace(" ", "").lower()))]
    return root


def threats(html):
    """Names of what could run code: handlers, script addresses, embedded frames."""
    found = set()
    for n in parse(html).walk():
        found |= {"handler" for k in n.attrs if k.lower().startswith("on")} | {"script address" for v in n.attrs.values() if v.strip().lower().startswith("javascript:")} | {n.tag for _ in [0] if n.tag in ("script", "iframe", "object")}
    return sorted(found)


def main_content(html):
    """Text of the densest container: length times share of text outside links, furniture left out; the deepest on a tie."""
    root = _without(parse(html), FRAME)
    for n in root.walk():
        if n.tag in ("main", "article") or n.attrs.get("role") == "main":
            return n.text()
    best, score = root, -1.0
    for n in root.walk():
        if n.tag in ("div", "section", "td", "body"):
            own = " ".join(c.text(" ") if isinstance(c, Node) and c.tag in ("p", "ul", "ol", "h1", "h2", "h3", "span", "b", "i", "a") else c if isinstance(c, str) else "" for c in n.children).strip()
            linked = sum(len(a.text(" ")) for a in n.find("a"))
            value = len(own) * (1 - min(1.0, linked / max(1, len(n.text(" ")))))
            if value > score:
                best, score = n, value
    return best.text()


def tables(html):
    out = []
    for k, t in enumerate(parse(html).find("table")):
        caption = next((c.text(" ") for c in t.find("caption")), None)
        rows = []
        for tr in t.find("tr"):
            cells = [(c, c.text(" ")) for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
            flat = [x for c, x in cells for _ in range(max(1, int(c.attrs.get("colspan") or 1) if (c.attrs.get("colspan") or "1").isdigit() else 1))]
            if cells:
                rows.append((all(c.tag == "th" for c, _ in cells), flat))
        headers = rows[0][1] if rows and rows[0][0] else []
        out.append({"table_no": k, "caption": caption, "headers": headers, "rows": [r for head, r in rows if not (head and r is headers)]})
    return out


def lists(html):
    return [{"kind": n.tag, "items": [c.text(" ") for c in n.children if isinstance(c, Node) and c.tag in ("li", "dt", "dd")]} for n in parse(html).find("ul", "ol", "dl")]


def links(html, base=""):
    host = urlsplit(base).netloc.lower()
    out = []
    for a in parse(html).find("a"):
        href = a.attrs.get("href", "").strip()
        if href and not href.lower().startswith(("javascript:", "mailto:", "#")):
            try:
                full = urljoin(base, href)
                out.append({"url": full, "text": a.text(" "), "rel": a.attrs.get("rel", ""), "internal": urlsplit(full).netloc.lower() == host})
            except ValueError:
                continue
    return out


def metadata(html):
    """Flat map: title, meta names and properties, canonical address, then JSON-LD strings; later sources do not replace earlier ones."""
    root, out = parse(html), {}
    for n in root.find("title"):
        out.setdefault("title", n.text(" "))
    for n in root.find("meta"):
        name = n.attrs.get("property") or n.attrs.get("name")
        if name and "content" in n.attrs:
            out.setdefault(name.lower(), n.attrs["content"])
    for n in root.find("link"):
        if "canonical" in n.attrs.get("rel", "").split():
            out.setdefault("canonical", n.attrs.get("href", ""))
    for n in root.find("script"):
        if n.attrs.get("type") == "application/ld+json":
            try:
                data = json.loads("".join(c for c in n.children if isinstance(c, str)))
            except ValueError:
                continue
            if isinstance(data, dict):
                for k, v in data.items():
                    out.setdefault(f"ld:{k}", v if isinstance(v, str) else json.dumps(v, sort_keys=True))
    for n in root.walk():
        if "itemprop" in n.attrs:
            out.setdefault(f"item:{n.attrs['itemprop']}", n.attrs.get("content") or n.text(" "))
    return out


def headings(html):
    return [{"level": int(n.tag[1]), "text": n.text(" ")} for n in parse(html).find("h1", "h2", "h3", "h4", "h5", "h6")]


def forms(html):
    return [{"action": f.attrs.get("action", ""), "method": (f.attrs.get("method") or "get").lower(), "fields": [i.attrs.get("name", "") for i in f.find("input", "select", "textarea")]} for f in parse(html).find("form")]


def repeated_items(html, least=3):
    """Sibling groups of one shape: the shape (tags and classes of a child) and how often it repeats."""
    out = []
    for n in parse(html).walk():
        shapes = {}
        for c in n.children:
            if isinstance(c, Node) and c.tag not in SILENT:
                shape = ".".join([c.tag, *sorted(c.classes())])
                shapes[shape] = shapes.get(shape, 0) + 1
        out += [{"parent": n.tag, "shape": s, "n": k} for s, k in shapes.items() if k >= least]
    return sorted(out, key=lambda x: (-x["n"], x["parent"], x["shape"]))


def structure(html):
    """n_elements, depth, n_links, n_scripts, share of text in links, share of markup."""
    root, depth, todo, n = parse(html), 0, [], 0
    todo.append((root, 0))
    while todo:
        node, d = todo.pop()
        depth, n = max(depth, d), n + 1
        todo.extend((c, d + 1) for c in node.children if isinstance(c, Node))
    text = root.text(" ")
    linked = sum(len(a.text(" ")) for a in root.find("a"))
    return {"n_elements": n - 1, "depth": depth, "n_links": len(root.find("a")), "n_scripts": len(root.find("script")), "link_share": linked / max(1, len(text)), "markup_share": 1 - len(text) / max(1, len(html or ""))}


def pagination(html, base=""):
    """The next page's address and the largest page number linked."""
    root, following, last = parse(html), None, 0
    for a in root.find("a", "link"):
        label = a.text(" ").lower() if a.tag == "a" else ""
        if following is None and ("next" in a.attrs.get("rel", "").split() or label in ("next", "next page", "older", ">", "»", "weiter", "suivant", "siguiente")):
            following = urljoin(base, a.attrs.get("href", ""))
        if label.isdigit() and len(label) < 7:
            last = max(last, int(label))
    return {"next": following, "last": last}


def needs_scripts(html):
    """0..1: little text, root elements of script frameworks, many scripts."""
    root = parse(html)
    text = len(root.text(" "))
    apps = any(n.attrs.get("id") in ("root", "app", "__next") for n in root.walk())
    return round(0.5 * (text < 200) + 0.3 * apps + 0.2 * min(1.0, len(root.find("script")) / 10), 6)
