"""Main text of html pages: flat text blocks, classified by a decision tree.

A page is cut into blocks of running text at every tag that is not inline. A
block is described by its own word count and link density and those of the
blocks before and after it, and by what encloses it: names that speak for or
against the article, how much of the page's words the nearest such element
holds, and whether it is one of several like elements. A decision tree, trained
here on a small labelled table, says which blocks are the article.
"""

import html
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import small_batches, table

# Fixed values of the language: tags within running text, tags whose content is never text, tags without content, tags that a head may hold.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SKIPPED = frozenset("script style noscript template head title textarea select option button svg math iframe object canvas audio video datalist".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("title style script noscript template meta link base head html".split())
# Elements that a tag ends, if they are open, as their own end tags may be left out.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
_ENDS |= dict.fromkeys(("tbody", "thead", "tfoot"), {"td", "th", "tr", "tbody", "thead", "tfoot"})
# What encloses a block: elements, and words in class, id, role and similar attributes.
_HARD_TAGS = frozenset("nav aside footer dialog menu".split())
_SOFT_TAGS = frozenset("form fieldset".split())
_OUTSIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget related recommended share sharing social "
    "cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription signup login search comment comments respond reply discussion disqus pagination pager toolbar copyright legal hidden complementary contentinfo skip tags".split()
)
_INSIDE_WORDS = frozenset("article content post entry story main body text".split())
# Words that say little beside a word for the article, or on one paragraph: topics, and what may well be part of an article.
_WEAK_WORDS = frozenset("side header notice alert tags skip legal widget search discussion overlay banner related recommended social promotion".split())
# Names of a state, not of a thing: has-sidebar, comments-open.
_STATE_FIRST = frozenset("has with without no not is show hide".split())
_STATE_LAST = frozenset("open opened closed on off enabled disabled active visible collapsed expanded".split())
# Elements that hold one paragraph.
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th figcaption caption".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAMES = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)

# What an element says of its content: nothing, the article's element or name, an element or name beside the article, a header, a paragraph whose name hints at something beside it.
_NOTHING, _TAGGED, _NAMED, _HARD, _SOFT, _HEADER, _HINT = range(7)

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "hard", "soft", "soft_share", "main", "page", "hinted", "repeats", "item_words", "item_heads", "sub", "sub_share", "sub_words", "sub_last", "own_share")


def _says(tag, attributes):
    """What an element's tag and names say of its content, and its class as the mark by which like elements are known."""
    names, mark = [], ""
    if attributes:
        if _HIDDEN.search(attributes):
            return _HARD, ""
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "class":
                mark = " ".join(_NAMES.findall(value.lower()))
            if name in ("class", "id", "role", "itemprop", "data-component"):
                names += [_NAMES.findall(x.lower()) for x in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).split()]
    if tag in _HARD_TAGS:
        return _HARD, mark
    inside = strong = weak = False
    for words in names:
        if not words or words[0] in _STATE_FIRST or words[-1] in _STATE_LAST:
            continue
        out, within = _OUTSIDE_WORDS.intersection(words), not _INSIDE_WORDS.isdisjoint(words)
        strong = strong or bool(out - _WEAK_WORDS)
        weak = weak or bool(out) and not within
        inside = inside or within and not out - _WEAK_WORDS
    if tag in ("article", "main"):
        return _SOFT if strong else _TAGGED, mark
    if tag in ("body", "html"):
        return _NOTHING, mark
    if strong or weak and not inside:
        return _HINT if tag in _PARAGRAPHS and not strong else _SOFT, mark
    return _SOFT if tag in _SOFT_TAGS else _HEADER if tag == "header" else _NAMED if inside else _NOTHING, mark


class Page:
    """The blocks of a page, as (text, words, link words, heading, element), and its elements, each after what encloses it."""

    def __init__(self, page):
        self.blocks, self.parent, self.says, self.mark = [], [-1], [_NOTHING], [("", "")]
        self._read(page)

    def _read(self, page):
        parts, stack, open_ = [], [("", 0)], Counter()  # stack: tag, element; as deep as the page, and looked at from its top alone
        skipping = links = words_linked = heading = at = 0

        def close():
            nonlocal words_linked
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                n = len(text.split(" "))
                self.blocks.append((text, n, min(n, words_linked), int(heading > 0), stack[-1][1]))
            words_linked = 0

        def pop():
            nonlocal skipping
            tag, _ = stack.pop()
            open_[tag] -= 1
            skipping -= tag in _SKIPPED
            return tag

        def end_head():
            while open_["head"]:
                pop()

        while True:
            found = _TAG.search(page, at)
            piece = page[at : found.start()] if found else page[at:]
            if skipping and stack[-1][0] == "head" and piece.strip():
                end_head()
            if piece and not skipping:
                parts.append(piece)
                if links:
                    words_linked += len(piece.split())
            if not found:
                break
            at = found.end()
            ends, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if not ends and open_["head"] and tag not in _HEAD and stack[-1][0] == "head":
                end_head()  # the first element that a head can't hold ends it
            if not ends and tag in _RAW and not attributes.endswith("/"):
                end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
                at = end.start() if end else len(page)
                if end:
                    at = page.find(">", at) + 1 or len(page)
                continue
            if tag == "br":
                parts.append(" ")
            elif tag not in _INLINE:
                close()
                if not ends:
                    while stack[-1][0] == "p" or stack[-1][0] in _ENDS.get(tag, ()):  # as the page may leave out their ends
                        pop()
                if tag[0] == "h" and tag[1:].isdigit():
                    heading = 0 if ends else 1
            if tag == "a":
                links = 0 if ends else 1
            if tag in _VOID or tag in _INLINE and tag not in _SKIPPED or attributes.endswith("/"):
                continue
            if not ends:
                said, mark = _says(tag, attributes)
                self.parent.append(stack[-1][1])
                self.says.append(said)
                self.mark.append((tag, mark))
                stack.append((tag, len(self.parent) - 1))
                open_[tag] += 1
                skipping += tag in _SKIPPED
            elif open_[tag]:
                while pop() != tag:
                    pass
        close()

    def features(self):
        """A row of FEATURES per block, in time linear in blocks and elements."""
        n, m = len(self.blocks), len(self.parent)
        out = np.zeros((n, len(FEATURES)))
        if not n:
            return out
        words, plain, heads, blocks = [0] * m, [0] * m, [0] * m, [0] * m
        for _, w, linked, head, e in self.blocks:
            words[e] += w
            plain[e] += w - linked
            heads[e] += head
            blocks[e] += 1
        for e in range(m - 1, 0, -1):
            for sums in (words, plain, heads, blocks):
                sums[self.parent[e]] += sums[e]
        # The article's element: the only one of its tag, else that with the most plain words, else the same among named ones.
        hard = [False] * m
        for e in range(1, m):
            hard[e] = hard[self.parent[e]] or self.says[e] == _HARD
        free = [e for e in range(1, m) if not hard[e] and plain[e]]
        articles = [e for e in free if self.says[e] == _TAGGED and self.mark[e][0] == "article"]
        tagged = articles if len(articles) == 1 else [e for e in free if self.says[e] == _TAGGED]
        named = [] if tagged else [e for e in free if self.says[e] == _NAMED]
        main = max(tagged or named, key=lambda e: (plain[e], e), default=-1)
        around, e = set(), main
        while e > 0:
            around.add(e)
            e = self.parent[e]
        # Like elements side by side: how many, their words and headings on average. What holds little else counts as one of them.
        like = {}
        for e in range(1, m):
            if blocks[e] and (self.mark[e][0] not in _PARAGRAPHS or self.mark[e][0] == "li" and self.mark[e][1]):
                like.setdefault((self.parent[e], *self.mark[e]), []).append(e)
        items = {}
        for (holder, _, name), g in like.items():
            if len(g) > 1:
                held = sum(words[x] for x in g)
                item = len(g), held / len(g), sum(heads[x] for x in g) / len(g)
                items |= dict.fromkeys(g, item)
                if name and holder not in around and held >= 0.7 * words[holder]:
                    items[holder] = item
        # Named parts of the article's element, as which its own text doesn't count: the outermost one around each element.
        sub, within = [0] * m, [False] * m
        for e in range(1, m):
            up = self.parent[e]
            within[e] = within[up] or up == main
            starts = within[e] and self.says[e] == _NOTHING and self.mark[e][1] and self.mark[e][0] not in _PARAGRAPHS
            sub[e] = sub[up] or (e if starts else 0)
        own = [(k, b) for k, b in enumerate(self.blocks) if (within[b[4]] or b[4] == main) and not sub[b[4]]]
        own_share = sum(b[1] for _, b in own) / max(words[main], 1) if main > 0 else 1.0
        last = own[-1][0] if own else -1
        # From the root down: what encloses each element.
        context = [(0, 0, 0.0, 0, 0, (1, 0.0, 0.0))] * m  # hard, soft, soft share, main, hinted, items
        whole = max(words[0], 1)
        for e in range(1, m):
            h, soft, share, inside, hint, item = context[self.parent[e]]
            said = self.says[e]
            inside = int(inside or e == main)
            if said == _HARD or said == _HEADER and not inside:
                h = 1
            elif said == _SOFT and e not in around:
                soft, share = soft + 1, words[e] / whole
            elif said == _HINT:
                hint = 1
            context[e] = (h, soft, share, inside, hint, items.get(e, item))
        rows = np.array([b[1:4] for b in self.blocks], dtype=np.float64)
        out[:, 0], out[:, 1], out[:, 6] = rows[:, 0], rows[:, 1] / rows[:, 0], rows[:, 2]
        out[1:, 2:4], out[:-1, 4:6] = out[:-1, 0:2], out[1:, 0:2]
        kind = 2 if tagged else 1 if named else 0
        out[:, 7:16] = [(h, soft, share, inside, kind, hint, *item) for h, soft, share, inside, hint, item in (context[b[4]] for b in self.blocks)]
        for k, (_, _, _, _, e) in enumerate(self.blocks):
            if sub[e]:
                out[k, 16:20] = 1, words[sub[e]] / max(words[main], 1), words[sub[e]] / blocks[sub[e]], k > last
        out[:, 20] = own_share
        return out


def text_blocks(page):
    """The texts of a page's blocks."""
    return [b[0] for b in Page(page).blocks]


class DecisionTree:
    """A binary tree by Gini impurity; nodes are (feature, threshold, low child, high child) or a label."""

    def __init__(self, x, y, depth=8, least=2):
        self.nodes = []
        self._grow(np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.int64), depth, least)

    def _grow(self, x, y, depth, least):
        here = len(self.nodes)
        self.nodes.append(int(2 * y.sum() > len(y)))
        if depth == 0 or y.min() == y.max():
            return here
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            values, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            low, high = ones[:-1], ones[-1] - ones[:-1]
            impurity = low * (n - low) / n + high * (len(y) - n - high) / (len(y) - n)
            impurity[(values[1:] == values[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
            k = int(impurity.argmin()) if len(impurity) else 0
            if len(impurity) and np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0] - 1e-12):
                best = impurity[k], f, (values[k] + values[k + 1]) / 2
        if best is None or best[0] >= y.sum() * (len(y) - y.sum()) / len(y) - 1e-12:
            return here
        _, f, threshold = best
        low = x[:, f] <= threshold
        self.nodes[here] = (f, threshold, self._grow(x[low], y[low], depth - 1, least), self._grow(x[~low], y[~low], depth - 1, least))
        return here

    def predict(self, rows):
        out = []
        for row in rows.tolist():
            node = self.nodes[0]
            while isinstance(node, tuple):
                f, threshold, low, high = node
                node = self.nodes[low if row[f] <= threshold else high]
            out.append(node)
        return out


def _words(n):
    return " ".join(["word"] * n)


def _menu(n):
    return "<ul>" + "".join(f"<li><a href='/'>{_words(1 + k % 2)}</a></li>" for k in range(n)) + "</ul>"


def _article(*sizes):
    """Paragraphs whose first character marks them as part of the article."""
    return "".join(f"<p>§{_words(n)}</p>" for n in sizes)


def _plain_name(draw):
    """A name that means nothing here, as those of unlisted sections."""
    return draw.choice(("reader-responses", "reactions", "voices", "lounge", "thread-list", "box", "block-x", "c-area"))


def labelled_pages(count=1200, seed=7):
    """The labelled table, as pages: blocks that begin with § belong to the article.

    Pages are put together at random from the usual parts. A third tell the
    article by elements, a third by class and id, a third by nothing but words
    and links. A third of each kind end with the article, others with a script,
    and some are nothing but text. Wrappers around all of it bear names of states
    and of things beside the article; comments come under listed names and under
    others, in the article's element and behind it; heads, bodies, cells and items
    may leave out their tags.
    """
    draw = random.Random(seed)
    some, chance = draw.randint, draw.random
    pages = []
    for k in range(count):
        how, end = k % 3, k // 3 % 3  # end: 0 with the article, 1 with a script, 2 with other parts
        sizes = [draw.choice((1, 2, some(3, 12), some(15, 40), some(30, 120))) if how < 2 else some(18, 120) for _ in range(some(1, 9))]
        linked = f"<p>§{_words(some(4, 30))} <a href='y'>{_words(some(1, 4))}</a> {_words(some(4, 20))}</p>"
        listed = f"<ul><li>§{_words(some(1, 9))}</li><li>§{_words(some(1, 5))} <a href='x'>{_words(1)}</a></li><li><a href='w'>§{_words(some(1, 12))}</a></li></ul>" if how < 2 else ""
        name = draw.choice(("side-note", "notice", "legal", "alert", "related", "banner"))
        named = draw.choice((f"<p class='{name}'>§{_words(some(15, 90))}</p>", f"<div class='{draw.choice(('story', 'post', 'article'))}-{name}'><p>§{_words(some(1, 60))}</p></div>")) if how < 2 else ""
        hint = f"<p class='{name}'><a href='v'>{_words(some(2, 9))}</a>{_words(some(0, 2))}</p>" if how < 2 else ""
        cells = f"<table><tr><td>§{_words(some(1, 6))}<td>§{_words(some(1, 9))}<tr><td>§{_words(some(1, 6))}<td>§{_words(some(1, 9))}</table>" if how < 2 else ""
        sections = "".join(f"<section><h2>§{_words(some(1, 7))}</h2>{_article(*[some(12, 90) for _ in range(some(1, 3))])}</section>" for _ in range(some(2, 4)))
        within = draw.choice(("", f"<div class='{draw.choice(('ad', 'sponsored', 'share-bar', 'related'))}'>{_words(some(1, 40))}</div>", f"<aside>{_words(some(2, 60))}</aside>", hint)) if how < 2 else ""
        head = f"<h1>§{_words(some(2, 12))}</h1>" if how < 2 or chance() < 0.5 else ""
        item = draw.choice(("div", "li", "article")) if how < 2 else "div"
        # Comments under a name that means nothing: several like items of a name and a few words, after the article's text.
        mark = "comment" if item == "article" else draw.choice(("item", "r", "entry-row"))
        who = draw.choice(("p", "b", "span", "h4", "div"))
        said = "".join(f"<{item} class='{mark}'><{who}>{_words(some(1, 2))}</{who}><p>{_words(some(2, 60))}</p></{item}>" for _ in range(some(2, 6)))
        said = f"<{(box := draw.choice(('section', 'div')))} class='{_plain_name(draw)}'>" + (f"<h3>{_words(some(1, 3))}</h3>" if chance() < 0.4 else "") + said + f"</{box}>"
        boxed = f"<div class='{_plain_name(draw)}'>" + "".join(f"<p>{_words(some(2, 40))}</p>" for _ in range(some(1, 5))) + "</div>"
        after = draw.choice(("", said, boxed, f"<div class='comments'><p>{_words(some(1, 60))}</p><p>{_words(some(1, 30))}</p></div>", f"<footer>{_words(some(2, 12))}</footer>")) if how < 2 and (end == 2 or chance() < 0.4) else ""
        # Under a name that means nothing, they are told from the article only where it has more text of its own.
        unlisted = after in (said, boxed)
        after = "" if unlisted and after.count("word") > 0.7 * sum(sizes) else after
        source = f"<p>§{_words(some(1, 4))} <a href='s'>{_words(some(2, 9))}</a></p>" if how < 2 else ""
        half = some(0, len(sizes))
        parts = [some(12, 120) for _ in range(some(2, 6))]
        divided = draw.choice(("".join(f"<div class='par'><p>§{_words(n)}</p></div>" for n in parts), f"<div class='copy'>{_article(*parts)}</div>"))
        lead = draw.choice(("", f"<p>§{_words(some(5, 30))}</p>"))
        intro = f"<div class='intro'><p>§{_words(some(5, 60))}</p></div>" if how < 2 and chance() < 0.15 and half < len(sizes) else ""
        body = head + intro + _article(*sizes[:half]) + within + draw.choice((linked, listed, named, source, cells, "", sections)) + _article(*sizes[half:]) + after
        if how < 2 and chance() < 0.2:  # its paragraphs one in a box each, or all in one
            body = head + lead + divided + ("" if unlisted else after)
        notice = f"<div class='{draw.choice(('cookie-notice', 'banner', 'ad', 'alert'))}'>{_words(some(3, 50))}</div>"
        side = f"<h3>{_words(some(1, 6))}</h3><p>{_words(some(3, 70))}</p>" + _menu(some(1, 4))
        behind = f"<section class='{_plain_name(draw)}'>" + "".join(f"<p>{_words(some(2, 60))}</p>" for _ in range(some(1, 5))) + "</section>"
        if how == 0:
            before = [f"<header><a href='/'>{_words(2)}</a><h1>{_words(some(1, 6))}</h1><p>{_words(some(1, 20))}</p></header>", f"<nav>{_menu(some(2, 9))}</nav>", notice]
            article = f"<article{draw.choice(('', '', '', ' class=post', chr(32) + 'class=' + chr(34) + 'post comments-open' + chr(34)))}>{body}</article>"
            rest = [f"<aside>{side}</aside>", f"<section id='comments'><p>{_words(some(1, 60))}</p></section>", behind, said, f"<form><p>{_words(some(1, 30))}</p></form>", f"<footer>{_words(some(2, 30))}</footer>"]
        elif how == 1:
            before = [f"<div id='masthead'>{_words(some(1, 15))}</div>", f"<div id='top-menu'>{_menu(some(2, 9))}</div>", notice]
            article = f"<div class='{draw.choice(('content', 'post-body', 'entry', 'legal article', 'story'))}'>{body}</div>"
            rest = [f"<div class='sidebar'>{side}</div>", f"<div class='comment-list'><div>{_words(some(1, 60))}</div></div>", behind, said, f"<div id='footer'>{_words(some(2, 30))}</div>"]
        else:
            row = "".join(f"<td><a href='/'>{_words(some(1, 2))}</a></td>" for _ in range(some(2, 7)))
            before, article = [f"<table><tr>{row}</tr></table>"], f"<div>{body}</div>"
            rest = [f"<div>{_menu(some(3, 9))}</div>", f"<p><a href='z'>{_words(some(2, 7))}</a> {_words(1)}</p>", f"<div>{_words(some(1, 4))} <a href='q'>{_words(some(4, 9))}</a></div>", f"<div>{_words(some(2, 6))}</div>"]
            if chance() < 0.4:  # nothing but a text
                before, article, rest = [], _article(*[some(1, 40) for _ in range(some(1, 4))]), []
        if how < 2:
            before, rest = ([x for x in parts if chance() < 0.75] for parts in (before, rest))
        rest = [] if end == 0 else ["<script>x()</script>"] if end == 1 else rest
        middle = f"<main>{article}</main>" if how == 0 and chance() < 0.3 else f"<main>{article}{behind if end == 2 else ''}</main>" if how == 0 and chance() < 0.2 else article
        if chance() < 0.3:  # around the article, or around all there is
            wrap = draw.choice(("<div class='page has-sidebar'>", "<div class='layout nav-open'>", "<div class='legal'>", "<form id='form1'>", "<div class='widget'>", "<div class='side'>", "<div id='search-page'>"))
            whole = wrap + (middle if chance() < 0.5 else "".join(before) + middle + "".join(rest)) + f"</{wrap[1:].split()[0]}>"
            page = whole if whole.count("<script>") or "".join(rest) and "".join(rest) in whole else "".join(before) + whole + "".join(rest)
        else:
            page = "".join(before) + middle + "".join(rest)
        pages.append(draw.choice(("<body>", "<html><head><title>t</title></head><body>", "<html><head><title>t</title>")) + page + draw.choice(("</body>", "")))
    return pages


def train_tree():
    """The tree, and how many blocks of the labelled table it gets right and wrong."""
    x, y = [], []
    for source in labelled_pages():
        page = Page(source)
        y += [int(b[0].startswith("§")) for b in page.blocks]
        x.append(page.features())
    x, y = np.concatenate(x), np.array(y)
    tree = DecisionTree(x, y, depth=12)
    right = int((np.array(tree.predict(x)) == y).sum())
    return tree, right, len(y) - right


def main_text(source, tree):
    """The article's blocks, a line each; empty for null, for no text and for no article."""
    page = Page(source or "")
    return "\n".join(b[0] for b, keep in zip(page.blocks, tree.predict(page.features()), strict=True) if keep) if page.blocks else ""


def extract_text(pages, id_col="page_id", url_col="url", html_col="html"):
    """Per row: id_col, url_col, text, n_chars (code points).

    Whole pages are read, nothing is capped. Null or empty html gives an empty
    text. Repeated rows give repeated results, an empty table an empty one;
    further columns of pages are ignored.
    """
    small_batches(pages.sparkSession)
    tree, _, _ = train_tree()

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": [main_text(h, tree) for h in batch["html"]]})

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInPandas(run, f"id {kind}, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_block_tree(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
