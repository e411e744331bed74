"""HTML pages to annotated Markdown, with the standard library's parser.

A small element tree is built once for each page; the clean-up steps work on it and one walk writes Markdown. Only
``convert_column`` meets Spark: an Arrow UDF, one page at a time, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that are no content, and headers that become bold text when their level is wrong.
NOISE = (("class", "toolbar"), ("class", "edit-page-link"), ("class", "feedback--title"), ("class", "pagehead"), ("id", "third-party-content-disclaimer"))
SPECIAL_HEADERS = ("概要", "摘要", "清理", "我何时该使用")
FEEDBACK = "## 反馈"
TITLE_SUFFIX = "| Kubernetes"


class Element:
    """A tag with attributes and children; strings are its text."""

    def __init__(self, tag: str, attrs: dict | None = None, parent: "Element | None" = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def add(self, child: "Element | str") -> None:
        self.children.append(child)
        if isinstance(child, Element):
            child.parent = self

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator["Element"]:
        """All elements below, in document order."""
        ahead = self.children[::-1]
        while ahead:
            e = ahead.pop()
            if isinstance(e, Element):
                ahead.extend(e.children[::-1])
                yield e

    def all(self, *tags: str) -> list["Element"]:
        return [e for e in self.walk() if e.tag in tags]

    def first(self, *tags: str) -> "Element | None":
        return next((e for e in self.walk() if e.tag in tags), None)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def tight(self) -> str:
        """Text with every string stripped, as used for titles and anchors."""
        return "".join(c.strip() if isinstance(c, str) else c.tight() for c in self.children)

    def up(self, *tags: str) -> "Element | None":
        e = self.parent
        while e is not None and e.tag not in tags:
            e = e.parent
        return e

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def replace(self, *new: "Element | str") -> None:
        at, parent = self.index(), self.parent
        for n in new:
            if isinstance(n, Element):
                n.parent = parent
        parent.children[at : at + 1] = new
        self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("document")

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p", "td", "th", "tr") and self.at.tag == tag:
            self.at = self.at.parent
        e = Element(tag, dict(attrs))
        self.at.add(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.at.add(Element(tag, dict(attrs)))

    def handle_endtag(self, tag):
        e = self.at
        while e is not self.root and e.tag != tag:
            e = e.parent
        if e is not self.root:
            self.at = e.parent

    def handle_data(self, data):
        self.at.add(data)


def parse(html: str) -> Element:
    """Element tree of a page; unclosed and stray tags are tolerated."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def drop_noise(root: Element) -> None:
    for e in [e for e in root.walk() if e.attrs]:
        names = {"class": e.classes, "id": [e.attrs.get("id")]}
        if e.parent is not None and any(value in names[kind] for kind, value in NOISE):
            e.replace()


def breadcrumb(root: Element) -> str:
    """Texts of ``nav ol li a`` joined; the nav is taken out."""
    nav = root.first("nav")
    if nav is None:
        return ""
    items = [a.text().strip() for a in nav.all("a") if (li := a.up("li")) is not None and li.up("ol") is not None]
    nav.replace()
    return " / ".join(items)


def move_out_of_alerts(root: Element) -> None:
    """A header that isn't an alert's first child, and the elements after it, leave the alert and follow it."""
    for div in [e for e in root.all("div") if "alert" in e.classes]:
        header = div.first("h1", "h2", "h3")
        if header is None or div.children[0] is header:
            continue
        holder = header.parent
        tail = [c for c in holder.children[header.index() :] if isinstance(c, Element)]
        holder.children = [c for c in holder.children if not any(c is t for t in tail)]
        at = div.index() + 1
        for t in tail:
            t.parent = div.parent
        div.parent.children[at:at] = tail


def header_levels(levels: list[int]) -> list[int]:
    """Corrected levels: one below the nearest earlier header of smaller level, else 1."""
    open_, out = [], []
    for level in levels:
        while open_ and open_[-1][0] >= level:
            open_.pop()
        out.append(open_[-1][1] + 1 if open_ else 1)
        open_.append((level, out[-1]))
    return out


def fix_headers(root: Element) -> None:
    """Levels of the first h1 and its later siblings follow their nesting; special headers become bold instead."""
    h1 = root.first("h1")
    if h1 is None:
        return
    names = {f"h{i}": i for i in range(1, 7)}
    after = h1.parent.children[h1.index() :]
    headers = [c for c in after if isinstance(c, Element) and c.tag in names]
    if len(headers) < 2:
        return
    for e, level in zip(headers, header_levels([names[e.tag] for e in headers])):
        if names[e.tag] == level:
            continue
        if any(c in SPECIAL_HEADERS for c in e.children if isinstance(c, str)):
            strong = Element("strong")
            strong.add(e.tight())
            e.replace(strong)
        else:
            e.tag = f"h{level}"


def flatten_cells(root: Element) -> None:
    """Lists, ``pre`` and line breaks in table cells become one line with escaped breaks."""
    brk = "&lt;br&gt;"
    for cell in [c for t in root.all("table") for c in t.all("td", "th")]:
        for lst in cell.all("ul", "ol"):
            if lst.parent is None:
                continue
            items = [li.tight().removeprefix("::marker").strip() for li in lst.all("li")]
            lst.replace(brk.join(f" * {x}" if lst.tag == "ul" else f" {i}. {x}" for i, x in enumerate(items, 1) if x))
        for pre in cell.all("pre"):
            if pre.parent is not None:
                pre.replace(brk.join(x.strip() for x in pre.text().strip().splitlines() if x.strip()))
        for br in cell.all("br"):
            br.replace(brk)


def flatten_code(root: Element) -> None:
    """Empty ``tt`` and ``code`` go; nested ones are unwrapped until none is inside another."""
    for e in root.all("tt", "code"):
        if e.parent is not None and not e.tight() and not any(True for _ in e.walk()):
            e.replace()
    while nested := [e for e in root.all("tt", "code") if e.up("tt", "code") is not None]:
        nested[-1].replace(*nested[-1].children)


def mark_links(root: Element, url: str) -> None:
    """Headers with an id get an entry marker; anchors with a target become exit markers with the absolute url."""
    for h in root.all("h1", "h2", "h3", "h4", "h5", "h6"):
        if h.attrs.get("id"):
            h.add(f" [HLINK: {urljoin(url, '#' + h.attrs['id'])}]")
    for a in root.all("a"):
        href = a.attrs.get("href")
        if href and not href.startswith(("javascript:", "mailto:", "tel:")) and a.attrs.get("aria-hidden") != "true":
            a.children = [f"[ANCHOR: {a.tight() or 'link'}, HLINK: {urljoin(url, href)}]"]


class _Writer:
    """Block-level Markdown of an element tree."""

    def __init__(self):
        self.out: list[str] = []

    def inline(self, e: Element | str) -> str:
        if isinstance(e, str):
            return re.sub(r"[ \t\r\n]+", " ", e)
        inner = "".join(self.inline(c) for c in e.children)
        if e.tag in ("strong", "b") and inner.strip():
            return f"**{inner.strip()}**"
        if e.tag in ("em", "i") and inner.strip():
            return f"_{inner.strip()}_"
        if e.tag in ("code", "tt") and inner:
            return f"`{inner}`"
        if e.tag == "br":
            return "  \n"
        if e.tag == "img":
            return f"![{e.attrs.get('alt') or ''}]({e.attrs.get('src') or ''})"
        return "" if e.tag in ("script", "style") else inner

    def block(self, e: Element, indent: int = 0) -> None:
        line: list[str] = []

        def flush() -> None:
            text = "".join(line).strip()
            line.clear()
            if text:
                self.out.append(text + "\n")

        for c in e.children:
            if isinstance(c, str) or c.tag in ("strong", "b", "em", "i", "code", "tt", "a", "span", "br", "img", "small", "sup", "sub", "label"):
                line.append(self.inline(c))
                continue
            flush()
            if c.tag in ("script", "style", "title", "head"):
                continue
            if re.fullmatch("h[1-6]", c.tag):
                self.out.append(f"{'#' * int(c.tag[1])} {self.inline(c).strip()}\n")
            elif c.tag in ("ul", "ol"):
                self.listing(c, indent)
            elif c.tag == "table":
                self.table(c)
            elif c.tag == "pre":
                self.out.append("[code]\n" + c.text().strip("\n") + "\n[/code]\n")
            elif c.tag == "hr":
                self.out.append("* * *\n")
            elif c.tag == "blockquote":
                inner = _Writer()
                inner.block(c)
                self.out += ["> " + x.replace("\n", "\n> ").rstrip("> ") + "\n" for x in inner.out]
            else:
                self.block(c, indent)
        flush()

    def listing(self, lst: Element, indent: int) -> None:
        rows, n = [], 0
        for li in (c for c in lst.children if isinstance(c, Element) and c.tag == "li"):
            n += 1
            inline = [c for c in li.children if isinstance(c, str) or c.tag not in ("ul", "ol")]
            text = "".join(self.inline(c) for c in inline).strip()
            rows.append("  " * (indent + 1) + ("* " if lst.tag == "ul" else f"{n}. ") + text)
            for sub in (c for c in li.children if isinstance(c, Element) and c.tag in ("ul", "ol")):
                below = _Writer()
                below.listing(sub, indent + 1)
                rows += [x.rstrip("\n") for x in below.out]
        if rows:
            self.out.append("\n".join(rows) + "\n")

    def table(self, t: Element) -> None:
        rows = []
        for i, tr in enumerate(t.all("tr")):
            cells = [self.inline(c).strip() for c in tr.all("td", "th")]
            rows.append("| ".join(cells) + " ")
            if i == 0:
                rows.append("|".join(["---"] * len(cells)))
        self.out.append("\n".join(rows) + "\n")


def _markdown(e: Element) -> str:
    w = _Writer()
    w.block(e)
    return "\n".join(w.out)


def convert(html: str | None, url: str, root: str = "main") -> str:
    """Annotated Markdown of a page, '' if it has no content element ``root``.

    The head is the title, the page's url and the breadcrumb; what follows the feedback header is cut. The text of a
    ``pre`` with ``code`` becomes a fenced block, alerts become ``:::`` blocks.
    """
    page = parse(html or "")
    main = page.first(root)
    if main is None:
        return ""
    title_tag = page.first("title")
    title = (title_tag.text() if title_tag else "").replace(TITLE_SUFFIX, "").strip()
    drop_noise(main)
    move_out_of_alerts(main)
    fix_headers(main)
    crumbs = breadcrumb(main)
    blocks: list[str] = []

    def lift(e: Element, text: str) -> None:
        holder = Element("div")
        holder.add(f"\x00{len(blocks)}\x00")
        blocks.append(text)
        e.replace(holder)

    for div in main.all("div"):
        if div.parent is not None and "alert " in (div.attrs.get("class") or ""):
            lift(div, f"\n:::{' '.join(div.classes)}\n{_markdown(div).strip()}\n:::\n")
    for pre in main.all("pre"):
        code = pre.first("code")
        if pre.parent is not None and code is not None and pre.up("td", "th") is None:
            lift(pre, f"\n```{(code.attrs.get('data-lang') or '').strip()}\n{code.text().strip()}\n```\n")
    flatten_cells(main)
    flatten_code(main)
    mark_links(main, url)
    body = re.sub("\x00(\\d+)\x00", lambda m: blocks[int(m[1])], _markdown(main))
    text = f"# {title}\n[HLINK: {url}]\n{crumbs}\n\n{body}"
    text = re.sub(r"```\s*\n", "```\n", text)
    text = re.sub(r"\n-{3,}\n", "\n\n", text).replace("| :--- ", "| :--- | ").replace("&lt;br&gt;", "<br>")
    return text.split(FEEDBACK)[0]


def span_path(html: str, url: str, base: str) -> str:
    """Names on the way to the page in the navigation tree, joined with ``_``; else the marked h1; else "unknown"."""
    page = parse(html)
    clean = lambda e: e.tight().replace("/", "和")
    link = next((a for a in page.all("a") if a.attrs.get("href") == url[len(base) :]), None)
    span = link.first("span") if link else None
    if span is None:
        h1 = next((h for h in page.all("h1") if h.attrs.get("data-pagefind-weight") == "10"), None)
        return clean(h1) if h1 else "unknown"
    path, li = [clean(span)], span.up("li")
    while li is not None and (ul := li.up("ul")) is not None and (above := ul.up("li")) is not None:
        label = next((c for c in above.children if isinstance(c, Element) and c.tag == "label"), None) or above.first("label")
        name = label.first("span") if label else None
        if name is None or name.up("a") is None:
            break
        path.insert(0, clean(name))
        li = above
    return "_".join(path)


def move_text(text: str, source: str, target: str, after_group: int = 0) -> str:
    """Move the first match of ``source`` to the first match of ``target``: -1 before it, 0 behind it, n behind its group n.

    A space is put before the moved text. Without both matches the text stays. Dots match line breaks, ``^`` matches at lines.
    """
    s, t = re.search(source, text, re.M | re.S), re.search(target, text, re.M | re.S)
    if not s or not t:
        return text
    at = t.start() if after_group == -1 else t.end() if after_group == 0 else t.end(after_group)
    if s.start() < at < s.end():
        return text
    rest = text[: s.start()] + text[s.end() :]
    if at >= s.end():
        at -= s.end() - s.start()
    return rest[:at] + " " + s.group() + rest[at:]


def convert_column(html: Column, url: Column, root: str = "main") -> Column:
    """``convert`` as a column."""

    @F.pandas_udf(StringType())
    def run(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([convert(p, u or "", root) for p, u in zip(pages, urls)])

    return run(html, url)


def new_urls(html: Column, page_url: Column, base: str, excluded: tuple[str, ...]) -> Column:
    """Absolute urls of the links inside ``ul`` lists of class ``ul-1``: under ``base``, no fragment, not the page itself.

    ``excluded`` texts are looked for in the link as written. Repeated urls stay; the frontier removes them.
    """
    lists = F.array_join(F.regexp_extract_all(html, F.lit(r'(?s)<ul[^>]*class="[^"]*\bul-1\b[^"]*"[^>]*>(.*?)</ul>'), F.lit(1)), " ")
    raw = F.regexp_extract_all(lists, F.lit(r'<a[^>]*\bhref="([^"]*)"'), F.lit(1))
    kept = F.filter(raw, lambda h: ~F.exists(F.array(*(F.lit(x) for x in excluded)), lambda x: h.contains(x)) if excluded else F.lit(True))
    full = F.transform(kept, lambda h: absolute_url(page_url, h))
    return F.filter(full, lambda u: u.startswith(base) & ~u.contains("#") & (u != page_url))


def absolute_url(base: Column, href: Column) -> Column:
    """Absolute form of a link: absolute, protocol-relative, root-relative, fragment or relative to the page's folder."""
    scheme, host = F.regexp_extract(base, r"^(https?:)", 1), F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder, page = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/)?)", 1), F.regexp_extract(base, r"^([^#]*)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(host, F.lit("/")))
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(host, href)).when(href.startswith("#"), F.concat(page, href)).otherwise(F.concat(folder, href))
