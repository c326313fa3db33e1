"""Main text of web pages: flat text blocks, classified by a decision tree on their words, links, neighbours and place.

Markup is read into a flat list of blocks; block elements end a block, inline ones and `<br>` do not. The features of a block
are its number of words, its share of words in links, both of the block before and of the block after, and hints of its place:
`strong` and `weak` say how small a part of the page's words lies in an enclosing element that is named like page chrome (0: none, or one
that holds the whole page; near 1: a small one), `article` and `outside` whether it stands in or beside what the page marks
as its article, and `heading`. A strong name is that of an element (nav, footer, aside, form, button, menu, dialog, a header outside the
article), a whole word of class, id or role, or the mark of a hidden element; a weak one is a part of such a word
(`ad-box`) that does not follow `no-`, `has-` and the like. html, body, main and article are named nothing. A decision tree
fitted to the blocks of labelled pages keeps or drops each block; the pages are made by the rules in `labelled_pages`.
Scripts, styles, comments, the head and other elements without running text are no text.

Null or empty pages and pages without main text give the empty string. Cut-off pages are read to their end; a tag cut off
at the end is dropped. End tags that may be left out (head, p, li, dd, dt, td, th, tr, option) are. Character references are
decoded, white space (no-break spaces too) becomes one space. Reading takes time in proportion to the page's length.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.shared import series_udf, small_batches

# Element names by their role in HTML.
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template svg annotation annotation-xml iframe object head title textarea select canvas audio video".split())
RAW = set("script style textarea title iframe".split())
HEAD = set("head title base link meta style script noscript template".split())
CHROME = set("nav footer aside form button menu dialog".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that name page chrome.
NAMES = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus dropdown footer form gdpr login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted promotion recommended related replies respond search share sharing shares sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split())
OUTER_NAMES = {"header"}
# Names of chrome as whole words only; as a part of a word they are more often the article's (`immune-responses`).
WHOLE_NAMES = set("alert alertdialog commentlist responses".split())
# Words that turn a chrome name beside them into a property of the element (`no-sidebar`, `has-share`), and elements that hold the page.
MODIFIERS = set("no not has have with without hide show is".split())
KEPT = set("html body main article".split())
# Elements that a start tag ends, and what stops the search for them.
ENDED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table tbody thead tfoot"), "option": ("option", "select")}
ENDED = {k: (set(a.split()), set(b.split())) for k, (a, b) in ENDED.items()}

_token = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_attribute = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_parts = re.compile(r"[a-z]+")
_raw_ends = {name: re.compile(f"</{name}\\s*>", re.I) for name in RAW}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "strong", "weak", "article", "outside", "heading")
PAGES, DEPTH, LEAF = 1600, 12, 5


def labelled_pages(n: int = PAGES, seed: int = 7) -> list[tuple[str, list[str]]]:
    """(html, main text by block) of pages made by rules: with and without a marked article, in frames of all kinds of names, with end tags left out."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        main: list[str] = []
        some = lambda lo, hi: " ".join(f"w{r.randrange(10**8)}" for _ in range(r.randint(lo, hi)))
        link = lambda lo, hi: f"<a href='/{r.randrange(999)}'>{some(lo, hi)}</a>"
        either = lambda p: r.random() < p

        def kept(text: str) -> str:
            main.append(text)
            return text

        def partly_linked(lo: int, hi: int) -> str:
            words = kept(some(lo, hi)).split()
            a = r.randrange(len(words))
            b = min(len(words), a + r.randint(1, 5))
            return " ".join([*words[:a], "<a href=x>" + " ".join(words[a:b]) + "</a>", *words[b:]])

        def called(*names: str, tag: str = "div") -> str:
            """An element with one of the names, whole or as a part of a word, or the element of that name."""
            name = r.choice(names)
            if name in CHROME | {"header"} and either(0.5):
                return f"<{name}>{{}}</{name}>"
            full = r.choice([name, name, f"{name}-box", f"top-{name}", f"{name}_1"])
            return f"<{tag} {r.choice(['class', 'id'])}='{full}'>{{}}</{tag}>"

        def piece(lists: bool) -> str:
            k = r.random()
            if k < 0.3:
                return f"<p>{kept(some(30, 120))}</p>"
            if k < 0.42:
                return f"<p>{kept(some(10, 30))}" + ("</p>" if either(0.7) else "")
            if k < 0.54:
                return f"<p>{kept(some(1, 9))}</p>"
            if k < 0.68:
                return f"<p>{partly_linked(12, 90)}</p>"
            if k < 0.7 and lists:
                return f"<p><a href=y>{kept(some(4, 12))}</a></p>"
            if k < 0.72 and lists:
                return "<ol>" + "".join(f"<li><a href=z>{kept(some(3, 14))}</a></li>" for _ in range(r.randint(2, 9))) + "</ol>"
            if k < 0.8:
                return f"<{(h := r.choice(['h2', 'h3']))}>{kept(some(2, 8))}</{h}><p>{kept(some(15, 90))}</p>"
            if k < 0.88:
                return "<ul>" + "".join(f"<li>{kept(some(6, 25)) if either(0.6) else partly_linked(8, 25)}" for _ in range(r.randint(2, 6))) + "</ul>"
            if k < 0.94:
                return f"<div class='{r.choice(['social-care', 'menu-planning', 'ad-vantage', 'share-prices', 'text', 'widget-making', 'search-history'])}'><p>{kept(some(25, 90))}</p><p>{kept(some(20, 60))}</p></div>"
            return f"<blockquote>{kept(some(12, 50))}</blockquote>"

        menu = lambda: "<ul>" + "".join(f"<li>{link(1, 2)}</li>" for _ in range(r.randint(3, 8))) + "</ul>"
        advert = lambda: called("ad", "ads", "advert", "sponsored", "promo", "banner").format(some(5, 40))
        comments = lambda: called("comments", "replies", "discussion", tag="section").format("".join((f"<article class=comment>{some(4, 60)}</article>" if either(0.3) else f"<div class=comment><p>{some(4, 60)}</p></div>" if either(0.5) else f"<p>{some(4, 60)}</p>") for _ in range(r.randint(1, 9))))
        side = lambda: called("aside", "sidebar", "widget").format(f"<h3>{some(1, 4)}</h3><p>{some(8, 50)}</p>{menu()}")
        related = lambda: called("related", "recommended").format("".join(f"<p>{link(3, 12)}</p>" for _ in range(r.randint(2, 6))))
        sign_up = lambda: called("form", "newsletter", "signup", "subscribe").format(f"<label>{some(1, 5)}</label> {some(3, 25)} <button>{some(1, 2)}</button>")

        marked = r.choice(["article", "main", "role", "", "", ""])
        before = [f"<header><h2>{some(1, 4)}</h2>{some(2, 9)}</header>" if either(0.5) else called("header", "masthead").format(f"<h2>{some(1, 4)}</h2>")]
        before.append(f"<nav>{menu()}</nav>" if either(0.4) else called("menu", "nav", "navbar").format(menu()) if either(0.4) else f"<div>{menu()}</div>")
        before += [x() for x, p in ((advert, 0.5), (side, 0.2), (lambda: called("notice", "cookie", "consent").format(some(8, 30)), 0.3), (lambda: called("breadcrumb").format(f"{link(1, 2)} / {link(1, 2)}"), 0.2)) if either(p)]
        body = [f"<h1>{kept(some(3, 12))}</h1>"] if either(0.85) else []
        count = r.choice([1, 1, 2, 3, 4, 6, 9, 14])
        for i in range(count):
            body.append(f"<p>{kept(some(25, 90))}</p>" if i == 0 and not marked else piece(bool(marked)))
            body += [x() for x, p in ((advert, 0.05), (related, 0.03), (sign_up, 0.03), (lambda: called("share", "social", "tags").format(menu()), 0.04), (menu, 0.04)) if either(p)]
        text = "".join(body)
        classes = r.choice(["", "", " class='post has-share'", " class='entry comments-open tags-news'", " class='social widget'"])
        text = {"article": f"<article{classes}>{text}</article>", "main": f"<main{classes}>{text}</main>", "role": f"<div role='main'>{text}</div>", "": r.choice(["<div id='content'>{}</div>", "{}", "<section>{}</section>", "<div><div>{}</div></div>"]).format(text)}[marked]
        after = [x() for x, p in ((side, 0.35), (comments, 0.45), (related, 0.3), (sign_up, 0.25), (advert, 0.25)) if either(p)]
        after.append(called("footer", "copyright", "contentinfo").format(f"&copy; {some(2, 14)}" + (menu() if either(0.5) else "")) if either(0.8) else f"<div>{link(1, 2)} | {link(1, 3)} | {link(1, 2)}</div>")
        whole = "".join([*(before if either(0.75) else []), text, *(after if either(0.75) else [])])
        whole = r.choice(["{}", "{}", "{}", "<div id='page' class='has-sidebar'>{}</div>", "<form id='f' action='/'>{}</form>", "<div class='sidebar-left' id='page'>{}</div>", "<div class='widget'><div>{}</div></div>", "<div class='search'>{}</div>"]).format(whole)
        frame = r.choice(["<html><head><title>t</title></head><body>{}</body></html>", "<html><head><title>t</title><meta name=a><body class='page has-sidebar'>{}", "<body class='search widget'>{}</body>", "{}"])
        out.append((frame.format(whole), main))
    return out


def labelled_blocks(pages: list[tuple[str, list[str]]] | None = None) -> np.ndarray:
    """The features of the blocks of labelled pages, then 1 for main text."""
    rows = []
    for page, main in pages or labelled_pages():
        found, wanted = blocks(page), set(main)
        rows += [(*row, text in wanted) for (text, *_), row in zip(found, described(found), strict=True)]
    return np.array(rows, float)


def fitted(rows: np.ndarray, depth: int = DEPTH):
    """A decision tree (feature, threshold, tree up to it, tree above it) or a leaf 0 or 1, by Gini impurity; leaves hold LEAF rows or more."""
    y, n = rows[:, -1], len(rows)
    best = None
    if depth and 0 < y.sum() < n:
        for f in range(rows.shape[1] - 1):
            order = np.argsort(rows[:, f], kind="stable")
            x, ones = rows[order, f], np.cumsum(y[order])
            low = np.arange(1, n)
            left, right = ones[:-1], ones[-1] - ones[:-1]
            gini = left * (1 - left / low) + right * (1 - right / (n - low))
            gini[(x[1:] == x[:-1]) | (low < LEAF) | (n - low < LEAF)] = np.inf
            i = int(np.argmin(gini)) if n > 1 else 0
            if n > 1 and np.isfinite(gini[i]) and (best is None or gini[i] < best[0] - 1e-12):
                best = (gini[i], f, (x[i] + x[i + 1]) / 2)
    if best is None:
        return int(y.mean() >= 0.5) if n else 0
    _, f, cut = best
    low = rows[:, f] <= cut
    return f, float(cut), fitted(rows[low], depth - 1), fitted(rows[~low], depth - 1)


@functools.cache
def standard_tree():
    """The tree of the pages that `labelled_pages` makes."""
    return fitted(labelled_blocks())


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def attributes(text: str) -> dict[str, str]:
    """Names and values, in lower case, of the attributes of a tag; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _attribute.findall(text):
        out.setdefault(name.lower(), (a or b or c).lower())
    return out


def naming(named: dict[str, str], names: set[str]) -> int:
    """2 if a whole word of class, id or role is one of the names, 1 if a part is that follows no modifier, else 0."""
    out = 0
    for one in " ".join(named.get(k, "") for k in ("class", "id", "role")).split():
        if one in names or one in WHOLE_NAMES:
            return 2
        parts = _parts.findall(one)
        if not MODIFIERS.isdisjoint(parts):
            parts = parts[: min(i for i, x in enumerate(parts) if x in MODIFIERS)]
        out |= not names.isdisjoint(parts)
    return int(out)


def is_article(name: str, named: dict[str, str]) -> bool:
    return name in ("article", "main") or "articlebody" in named.get("itemprop", "") or named.get("role") in ("main", "article")


def blocks(page: str) -> list[tuple[str, int, int, float, float, bool, bool]]:
    """(text, words, words in links, strong, weak, article, heading) of each block that has words."""
    out: list[list] = []
    parts: list[str] = []
    total = linked = hidden = linked_in = 0
    link = heading = False
    stack: list[tuple[str, bool, int]] = []  # element, inside an article, its nearest hint
    opened: dict[str, int] = {}
    article, hint = False, -1
    hints: list[list] = []  # (strength, hint around it, words before it, words up to its end)
    at, n = 0, len(page)

    def close() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                size = text.count(" ") + 1
                total += size
                out.append([text, size, min(size, linked), hint, 0.0, article, heading])
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if hidden or not piece:
            return
        piece = html.unescape(piece) if "&" in piece else piece
        parts.append(piece)
        if link:
            linked += len(piece.split())

    def pop(k: int) -> None:
        """Ends the elements from the k-th on."""
        nonlocal article, hint, hidden, link
        outer = stack[k - 1][2] if k else -1
        if stack[-1][2] != outer:
            close()
        for name, _, _ in stack[k:]:
            opened[name] -= 1
            hidden -= name in HIDDEN
        while hint != outer:
            hints[hint][3] = total
            hint = hints[hint][1]
        del stack[k:]
        article = stack[-1][1] if stack else False
        if len(stack) < linked_in:
            link = False

    while at < n:
        m = _token.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                link = False
            if name in BLOCK:
                close()
                if name in HEADINGS:
                    heading = False
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop(k)
            continue
        if name == "br":
            add(" ")
            continue
        if name not in HEAD and opened.get("head"):
            k = len(stack) - 1
            while stack[k][0] != "head":
                k -= 1
            pop(k)
        if name in BLOCK:
            close()
            while stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if name in ENDED:
                ended, stop = ENDED[name]
                if any(opened.get(x) for x in ended):
                    k = len(stack) - 1
                    while k >= 0 and stack[k][0] not in ended and stack[k][0] not in stop:
                        k -= 1
                    if k >= 0 and stack[k][0] in ended:
                        pop(k)
            heading = name in HEADINGS or (heading and name not in ("p", "div", "ul", "section", "article", "main", "table"))
        elif name == "a":
            # one with a name and no address is a mark in the text; one that is not ended ends with the element round it
            named = attributes(m[3]) if m[3] else {}
            link, linked_in = "href" in named or not named.keys() & {"name", "id"}, len(stack)
        if name in VOID:
            continue
        if name in RAW:
            end = _raw_ends[name].search(page, at)
            at = end.end() if end else n
            continue
        if m[3].endswith("/") and name not in BLOCK:
            continue
        named = attributes(m[3]) if m[3] else {}
        marks = is_article(name, named)
        strength = 0
        if name not in KEPT:
            strength = 2 if name in CHROME else 0 if marks or not named else naming(named, NAMES)
            if strength < 2 and not article and not marks:
                strength = max(strength, 2 if name == "header" else naming(named, OUTER_NAMES) if named else 0)
        if "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", ""):
            strength = 2
        if strength or name in BLOCK or name in HIDDEN:
            if strength:
                if name not in BLOCK:
                    close()
                hints.append([strength, hint, total, None])
                hint = len(hints) - 1
            article = article or marks
            stack.append((name, article, hint))
            opened[name] = opened.get(name, 0) + 1
            hidden += name in HIDDEN
    close()
    values: list[tuple[float, float]] = []
    for strength, around, start, stop in hints:
        small = 1 - ((total if stop is None else stop) - start) / max(total, 1)
        strong, weak = values[around] if around >= 0 else (0.0, 0.0)
        values.append((max(strong, small) if strength == 2 else strong, max(weak, small) if strength == 1 else weak))
    for b in out:
        b[3], b[4] = values[b[3]] if b[3] >= 0 else (0.0, 0.0)
    return [tuple(b) for b in out]


def described(found: list[tuple]) -> list[tuple]:
    """The features of each block."""
    marked = any(article and strong < 0.3 for _, _, _, strong, _, article, _ in found)
    size = [(0, 0.0), *((n, k / n) for _, n, k, *_ in found), (0, 0.0)]
    return [(*size[i + 1], *size[i], *size[i + 2], strong, weak, article, marked and not article, heading) for i, (_, _, _, strong, weak, article, heading) in enumerate(found)]


def main_text(page: str | None, tree) -> str:
    found = blocks(page) if page else []
    return "\n".join(b[0] for b, row in zip(found, described(found), strict=True) if decide(tree, row))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[tuple] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): one row per input row. labelled: rows of FEATURES and 0 or 1, a small table; by default the blocks of `labelled_pages`."""
    small_batches(pages.sparkSession)
    tree = standard_tree() if labelled is None else fitted(np.array(labelled, float))

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.Series([main_text(x, tree) for x in batch], dtype=object)

    text = series_udf(run, "string")(F.col(html_col).cast("string"))
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
