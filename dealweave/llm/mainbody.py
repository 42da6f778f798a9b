"""Main body of stored web pages: boosted trees over DOM nodes, decoded along the tree.

A tolerant tokenizer turns markup into a preorder list of elements, so every
subtree statistic is a difference of prefix sums.  The trees are trained here,
on a bounded sample of pages, from the elements whose tag or attribute words say
what they are; each such element is also shown with its tag and attribute words
hidden, so that text density, links, wording, depth and siblings must suffice on
pages that name nothing.  Decoding minimises the summed cost under the rule that
nothing inside an element of the site belongs to the body.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.boosting import BoostedTrees
from dealweave.llm.samples import fit_in_task, hashed_sample

#: Most pages in the training sample (those with the smallest hashes).
TRAIN_PAGES = 800
#: Longer pages are left out of the sample, so that its size is bounded; they are decoded like all others.
TRAIN_CHARS = 200_000
#: Places that attribute words are hashed into.
ATTRIBUTE_PLACES = 1 << 14

# Tags and attribute words that mark parts of the site around a page's body.
SITE_TAGS = frozenset("nav footer aside header form".split())
SITE_WORDS = frozenset(
    """
    nav menu navbar navigation footer foot sidebar side cookie cookies consent gdpr privacy banner breadcrumb breadcrumbs crumbs
    share social promo promotion signup subscribe newsletter paywall ad ads advert advertisement sponsor more related recommended
    teaser widget comments login toolbar masthead legal copyright
    """.split()
)
BODY_TAGS = frozenset("main article".split())
BODY_WORDS = frozenset("content article story main body post entry text filing document".split())

_INSIDE = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style|textarea)\b{_INSIDE}>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)({_INSIDE})>|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"(class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("head title script style noscript template svg iframe object select textarea".split())
_SELF_CLOSING = frozenset("li p tr option dt dd".split())
_INLINE = frozenset("a b i em strong font span u small sup sub br".split())

_KINDS = {"p": 1, "li": 2, "td": 3, "th": 3, "tr": 4, "table": 5, "ul": 6, "ol": 6, "a": 7, "h1": 8, "h2": 8, "h3": 8, "h4": 8, "h5": 8, "h6": 8, "span": 9, "b": 10, "font": 10, "i": 10, "em": 10, "strong": 10}


class Page:
    """Elements of one page in preorder and the visible text chunks with their lines."""

    __slots__ = ("tag", "parent", "end", "depth", "mark", "chunks", "link", "names")

    def __init__(self, markup: str):
        # Element 0 is a root that stands for the page.
        self.tag, self.parent, self.end, self.depth = ["#page"], [-1], [0], [0]
        self.mark = [0]  # 1: named as site, 2: named as body, 3: has no attribute words
        self.names: list[tuple[int, ...]] = [()]  # hashed words of class, id and role
        self.link = [0]  # 1: link away from the page, 2: link inside it
        self.chunks: list[tuple[int, str, int]] = []  # element, text, line
        stack, hidden, line = [0], 0, 0
        for m in _TOKEN.finditer(markup):
            text = m.group(5)
            name = m.group(3)
            if text is not None:
                if not hidden:
                    top = stack[-1]
                    if "\n" in text:
                        for k, part in enumerate(text.split("\n")):
                            if part and not part.isspace():
                                self.chunks.append((top, part, line + k))
                    elif not text.isspace():
                        self.chunks.append((top, text, line))
                line += text.count("\n")
                continue
            if name is None:
                line += m.group(0).count("\n")
                continue
            name = name.lower()
            if m.group(2):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        for gone in stack[k:]:
                            self.end[gone] = len(self.tag)
                            hidden -= self.tag[gone] in _HIDDEN
                        del stack[k:]
                        break
            else:
                attrs = m.group(4)
                top = self.tag[stack[-1]]
                if len(stack) > 1 and ((top == name and name in _SELF_CLOSING) or (name in ("td", "th") and top in ("td", "th") and self.tag[stack[-2]] == "tr")):
                    gone = stack.pop()
                    self.end[gone] = len(self.tag)
                node = len(self.tag)
                self.tag.append(name)
                self.parent.append(stack[-1])
                self.depth.append(len(stack))
                self.end.append(node + 1)
                mark = 1 if name in SITE_TAGS else 2 if name in BODY_TAGS else 0
                link = 0
                names: tuple[int, ...] = ()
                if attrs:
                    words = {w for a in _ATTR.finditer(attrs) for w in _WORD.findall(a.group(2).lower())}
                    names = tuple(sorted({crc32(w.encode()) % ATTRIBUTE_PLACES for w in words}))
                    if not mark:
                        mark = 1 if words & SITE_WORDS else 2 if words & BODY_WORDS else 0
                    if name == "a":
                        link = 2 if re.search(r"href\s*=\s*[\"']?#", attrs) else 1
                self.mark.append(mark)
                self.link.append(link)
                self.names.append(names)
                if name not in _VOID and not attrs.endswith("/"):
                    stack.append(node)
                    hidden += name in _HIDDEN
            line += m.group(0).count("\n")
        for k in stack:
            self.end[k] = len(self.tag)


FEATURES = (
    "depth", "kind", "site_word", "body_word", "elements", "chars", "words", "away_share", "inside_share", "chars_per_piece", "separators",
    "sentence_share", "lexical", "lexical_low", "digit_share", "index", "siblings", "before_chars", "after_chars", "parent_away", "parent_lexical",
    "page_share", "page_away", "first_lexical", "position", "lead_lexical", "attribute", "parent_attribute",
)
_NAMED = (2, 3, 26, 27)  # columns of attribute words, hidden in the second showing of a training element


def _visible(text: str) -> str:
    return html.unescape(text).strip() if "&" in text else text.strip()


def featurise(page: Page, lexicon: dict[str, float], naming: np.ndarray) -> np.ndarray:
    """Feature matrix of the page's elements; ``naming`` weighs the hashed words of their class, id and role."""
    n = len(page.tag)
    own = np.zeros((n, 8))  # chars, words, away chars, inside chars, pieces, separators, ends, lexical
    digits = np.zeros(n)
    links = page.link
    parent = page.parent
    away = [0] * n
    for k in range(1, n):
        away[k] = links[k] or away[parent[k]]
    get = lexicon.get
    low = np.full(n, 9.0)
    first = np.full(n, np.nan)
    for node, chunk, _ in page.chunks:
        text = _visible(chunk)
        if not text:
            continue
        size = len(text)
        words = _WORD.findall(text.lower())
        score = sum([get(w, 0.0) for w in words])
        row = own[node]
        row[0] += size
        row[1] += len(words)
        if away[node] == 1:
            row[2] += size
        elif away[node] == 2:
            row[3] += size
        row[4] += 1
        row[5] += text.count("|") + text.count("·")
        row[6] += text[-1] in ".;:"
        row[7] += score
        digits[node] += sum(map(text.count, "0123456789"))
        mean = score / (len(words) + 1)
        if mean < low[node]:
            low[node] = mean
        if first[node] != first[node]:
            first[node] = mean
    total = np.zeros((n + 1, 9))
    total[1:, :8] = own
    total[1:, 8] = digits
    np.cumsum(total, axis=0, out=total)
    start = np.arange(n)
    end = np.array(page.end)
    sub = total[end] - total[start]
    # Lowest piece and first piece of each subtree, bottom up.
    for k in range(n - 1, 0, -1):
        p = parent[k]
        if low[k] < low[p]:
            low[p] = low[k]
        if first[k] == first[k]:
            first[p] = first[k] if page.chunks else np.nan
    par = np.array(parent)
    par[0] = 0
    depth = np.array(page.depth)
    kind = np.array([_KINDS.get(t, 0) for t in page.tag], dtype=float)
    chars, words = sub[:, 0], sub[:, 1]
    safe = np.maximum(chars, 1)
    lexical = sub[:, 7] / (words + 1)
    out = np.zeros((n, len(FEATURES)))
    mark = np.array(page.mark)
    order_index = np.zeros(n)
    count: dict[int, int] = {}
    last: dict[int, int] = {}
    before = np.zeros(n)
    after = np.zeros(n)
    for k in range(1, n):
        p = parent[k]
        order_index[k] = count.get(p, 0)
        count[p] = count.get(p, 0) + 1
        q = last.get(p)
        if q is not None:
            before[k] = chars[q]
            after[q] = chars[k]
        last[p] = k
    siblings = np.array([count.get(p, 1) for p in parent], dtype=float)
    page_chars = max(chars[0], 1)
    attribute = np.array([naming[list(w)].mean() if w else 0.0 for w in page.names])
    cols = (
        depth, kind, mark == 1, mark == 2, end - start, chars, words, sub[:, 2] / safe, sub[:, 3] / safe, chars / np.maximum(sub[:, 4], 1), sub[:, 5] / np.maximum(sub[:, 4], 1),
        sub[:, 6] / np.maximum(sub[:, 4], 1), lexical, np.minimum(low, 9), sub[:, 8] / safe, order_index, siblings, before, after, (sub[:, 2] / safe)[par], lexical[par],
        chars / page_chars, np.full(n, sub[0, 2] / page_chars), np.nan_to_num(first), (total[start, 0]) / page_chars, np.nan_to_num(first)[par], attribute, attribute[par],
    )
    for j, c in enumerate(cols):
        out[:, j] = c
    return out


def weak_labels(page: Page) -> list[int]:
    """1 body, 0 site, -1 unknown for each element, from what tags and attribute words say.

    On pages with marked parts, what lies in a part of the site is site, what lies
    in a marked body (and in no part of the site) is body, and so is what holds it.
    A page without marks and without links that lead away has no site around it.
    """
    n = len(page.tag)
    state = [0] * n
    has_site, has_body = 1 in page.mark, 2 in page.mark
    for k in range(1, n):
        up = state[page.parent[k]]
        own = page.mark[k]
        state[k] = 1 if up == 1 or own == 1 else 2 if up == 2 or own == 2 else 0
    if has_site and has_body:
        return [-1 if s == 0 else int(s == 2) for s in state]
    if has_site or has_body:
        return [0 if s == 1 else 1 if s == 2 else -1 for s in state]
    if 1 not in page.link:
        return [1] * n
    return [-1] * n


class BodyModel:
    """Word weights and boosted trees fitted on a sample of pages."""

    def __init__(self, pages: list[str]):
        parsed = [Page(p) for p in pages]
        labels = [weak_labels(p) for p in parsed]
        self.lexicon = self._words(parsed, labels)
        self.naming = self._names(parsed, labels)
        rows, ys = [], []
        for page, label in zip(parsed, labels):
            y = np.array(label)
            keep = (y >= 0) & (np.arange(len(y)) > 0) & np.array([t not in _HIDDEN and t not in ("html", "body") for t in page.tag])
            if keep.any():
                rows.append(featurise(page, self.lexicon, self.naming)[keep])
                ys.append(y[keep])
        self.trees = None
        if rows:
            x, y = np.concatenate(rows), np.concatenate(ys).astype(float)
            if 0 < y.sum() < len(y):
                hidden = x.copy()
                hidden[:, _NAMED] = 0
                self.trees = BoostedTrees().fit(np.concatenate([x, hidden, hidden]), np.concatenate([y, y, y]))

    @staticmethod
    def _words(pages: list[Page], labels: list[list[int]]) -> dict[str, float]:
        """Log odds of words in body against site pieces, each word once per piece."""
        body, site = Counter(), Counter()
        for page, label in zip(pages, labels):
            for node, chunk, _ in page.chunks:
                if label[node] >= 0:
                    (body if label[node] else site).update(set(_WORD.findall(_visible(chunk).lower())))
        nb, ns = sum(body.values()) + 1, sum(site.values()) + 1
        kept = [w for w in body.keys() | site.keys() if body[w] + site[w] >= 3]
        return {w: float(np.clip(np.log((body[w] + 0.5) / nb) - np.log((site[w] + 0.5) / ns), -4, 4)) for w in kept}

    @staticmethod
    def _names(pages: list[Page], labels: list[list[int]]) -> np.ndarray:
        """Log odds of each hashed attribute word in body against site elements."""
        seen = np.zeros((2, ATTRIBUTE_PLACES))
        for page, label in zip(pages, labels):
            for y, names in zip(label, page.names):
                if y >= 0 and names:
                    seen[y, list(names)] += 1
        share = (seen + 0.5) / (seen.sum(1, keepdims=True) + 1)
        odds = np.clip(np.log(share[1]) - np.log(share[0]), -4, 4)
        odds[seen.sum(0) < 3] = 0
        return odds

    def decode(self, pages: list[Page]) -> list[list[bool]]:
        """For each page, whether each element belongs to the body; pages are scored together."""
        if self.trees is None or not pages:
            return [[True] * len(p.tag) for p in pages]
        sizes = [len(p.tag) for p in pages]
        odds = self.trees.log_odds(np.concatenate([featurise(p, self.lexicon, self.naming) for p in pages]))
        cuts = np.cumsum([0, *sizes])
        return [self._decode(p, odds[i:j]) for p, i, j in zip(pages, cuts, cuts[1:])]

    def bodies(self, markups: list[str]) -> list[list[tuple[int, str]]]:
        """(line, visible text) of the body's pieces, in page order, for each page."""
        out: list[list[tuple[int, str]]] = []
        for at in range(0, len(markups), 128):
            pages = [Page(m) for m in markups[at : at + 128]]
            for page, keep in zip(pages, self.decode(pages)):
                pieces = ((line, _visible(text)) for node, text, line in page.chunks if keep[node])
                out.append([p for p in pieces if p[1]])
        return out

    @staticmethod
    def _decode(page: Page, odds: np.ndarray) -> list[bool]:
        n = len(page.tag)
        # Inline and structural elements follow what holds them or what they hold.
        body_cost, site_cost = np.logaddexp(0, -odds), np.logaddexp(0, odds)
        for k, t in enumerate(page.tag):
            if t in _INLINE and page.tag[page.parent[k]] not in ("html", "body", "#page") and t not in ("a", "span"):
                body_cost[k] = site_cost[k] = 0.0
            elif t in ("#page", "html", "body"):
                body_cost[k], site_cost[k] = 0.0, 1e9
        # Bottom up: cost of an all-site subtree against the best with this element in the body.
        total = np.zeros(n + 1)
        np.cumsum(site_cost, out=total[1:])
        whole = total[np.array(page.end)] - total[np.arange(n)]
        best, whole = body_cost.tolist(), whole.tolist()
        choice = [True] * n
        for k in range(n - 1, 0, -1):
            choice[k] = best[k] <= whole[k]
            best[page.parent[k]] += best[k] if choice[k] else whole[k]
        keep = [False] * n
        keep[0] = True
        for k in range(1, n):
            keep[k] = keep[page.parent[k]] and choice[k]
        return keep


def train_model(pages: DataFrame, key: list[str], text: str, limit: int = TRAIN_PAGES) -> BodyModel:
    """Fit on at most ``limit`` pages, those whose keys have the smallest hashes.

    Pages of over ``TRAIN_CHARS`` characters are not in the sample.  One task
    reads the pages; only the model reaches the driver.
    """
    sample = hashed_sample(pages.filter(F.length(text) <= TRAIN_CHARS), key, limit).select(F.col(text).alias("t")).distinct()
    return fit_in_task(sample, lambda rows: BodyModel(rows["t"].tolist()))


def body_lines(pages: DataFrame, key: list[str], text: str, model: BodyModel) -> DataFrame:
    """One row (keys, line_no) per line of a page that holds visible text of its body.

    ``line_no`` counts from 0 after splitting at ``\\n``.  Null and empty pages
    and pages of markup alone have no rows; a page without surroundings has a row
    for each of its visible lines.  Other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in key) + ", line_no bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            lines = [sorted({line for line, _ in body}) for body in m.bodies(pdf["_text"].tolist())]
            at = np.repeat(np.arange(len(pdf)), [len(x) for x in lines])
            out = {k: pdf[k].to_numpy()[at] for k in key}
            out["line_no"] = np.array([n for x in lines for n in x], dtype=np.int64)
            yield pd.DataFrame(out)

    return pages.select(*key, F.col(text).alias("_text")).filter("_text is not null").mapInPandas(run, schema)


def body_text(pages: DataFrame, key: list[str], text: str, model: BodyModel) -> DataFrame:
    """One row (keys, body) per non-null page: the visible text of its body, line by line."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in key) + ", body string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = []
            for body in m.bodies(pdf["_text"].tolist()):
                lines: dict[int, list[str]] = {}
                for line, text in body:
                    lines.setdefault(line, []).append(text)
                out.append("\n".join(" ".join(v) for _, v in sorted(lines.items())))
            yield pd.DataFrame({**{k: pdf[k].to_numpy() for k in key}, "body": out})

    return pages.select(*key, F.col(text).alias("_text")).filter("_text is not null").mapInPandas(run, schema)
