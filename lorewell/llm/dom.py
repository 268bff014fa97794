"""DOM nodes of pages as flat arrays in document order, and their features.

The parser knows void elements, implied end tags, raw text (script, style, title),
comments, quoted attributes and unclosed tags; it keeps a stack in a list, so that
depth is not limited, and its time grows with the length of the page.  A node's
descendants follow it without a gap, so that sums over subtrees are differences of
running sums.

A node's names are its tag and the words of its class, id and role.  They are hashed
to ``BUCKETS`` numbers, and what each says about content is learned (``learn_names``).
"""

from __future__ import annotations

import html as _html
import re
import zlib
from dataclasses import dataclass

import numpy as np

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?][^>]*+>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")  # a slash at the end of a bare value belongs to it
_SPLIT = re.compile(r"[^a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(f"</{t}", re.I) for t in ("script", "style", "title")}
_BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li"}
_IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
BUCKETS = 4096
FEATURES = ("tag", "parent_tag", "is_text", "depth", "log_text", "link_share", "node_density", "punctuation", "digits", "children", "log_size", "place_among_siblings", "siblings", "like_siblings", "siblings_log_text", "share_of_parent", "share_of_page", "begins_at", "names", "least_name", "above", "least_above", "parent_log_text", "parent_link_share", "mean_word", "upper")


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


_KNOWN: dict[str, int] = {}


def _tag(tag: str) -> int:
    if tag not in _KNOWN and len(_KNOWN) < 10_000:
        _KNOWN[tag] = bucket(f"<{tag}>")
    return _KNOWN.get(tag) or bucket(f"<{tag}>")


_A, _TEXT = _tag("a"), _tag("#text")


@dataclass
class Tree:
    """Nodes of one page in document order; text nodes have a text, a block number and the flag of preformatted text."""

    parent: list[int]
    tag: list[int]  # buckets of the tags
    names: list[tuple[int, ...]]  # and of the words of class, id and role
    end: list[int]
    text: list[str | None]
    block: list[int]
    pre: list[bool]


def parse(page: str | None) -> Tree:
    parent, group, names, end, text, block_of, pre_of = [-1], [_tag("html")], [()], [0], [None], [0], [False]
    stack, tags, open_now = [0], ["#root"], {}
    block, at, page, head = 0, 0, page or "", 0

    def close() -> None:
        end[stack.pop()] = len(parent)
        open_now[tags.pop()] -= 1

    def add_text(s: str) -> None:
        if s and not open_now.get("head") and not s.isspace():
            parent.append(stack[-1])
            group.append(_TEXT)
            names.append(())
            end.append(len(parent))
            text.append(_html.unescape(s) if "&" in s else s)
            block_of.append(block)
            pre_of.append(bool(open_now.get("pre")))
        elif s and text[-1] is not None and block_of[-1] == block and not open_now.get("head"):
            text[-1] += " "  # white space between inline elements still separates words

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add_text(page[at:])
            break
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        slash, tag, attrs = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            block += 1
        if slash:
            if open_now.get(tag):
                while tags[-1] != tag:
                    close()
                close()
            continue
        if tag == "body" and open_now.get("head"):
            while open_now["head"]:
                close()
        if tag in _CLOSES_P and open_now.get("p"):
            while open_now["p"]:
                close()
        if tag in _IMPLIED:
            ends, stops = _IMPLIED[tag]
            k = len(tags) - 1
            while k > 0 and tags[k] not in ends and tags[k] not in stops:
                k -= 1
            if tags[k] in ends:
                while k > 0 and tag == "tr" and tags[k] != "tr" and tags[k - 1] in ends:
                    k -= 1
                while len(tags) > k:
                    close()
        if tag in _RAW and not _CLOSED.search(attrs):
            found = _RAW[tag].search(page, at)
            after = page.find(">", found.start()) if found else -1
            at = after + 1 if after >= 0 else len(page)
            continue
        if tag in _VOID:
            continue
        me = len(parent)
        parent.append(stack[-1])
        group.append(_tag(tag))
        names.append(tuple(bucket(w) for value in _NAMES.findall(attrs) for w in _SPLIT.split(value.lower()) if w) if attrs else ())
        end.append(0)
        text.append(None)
        block_of.append(block)
        pre_of.append(False)
        if not _CLOSED.search(attrs) or tag in _BLOCK:
            stack.append(me)
            tags.append(tag)
            open_now[tag] = open_now.get(tag, 0) + 1
        else:
            end[me] = me + 1
    while len(stack) > 1:
        close()
    end[0] = len(parent)
    return Tree(parent, group, names, end, text, block_of, pre_of)


def _inside(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum over each node's subtree."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[end] - run[:-1]


def _below(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum over each node's ancestors."""
    mark = np.zeros(len(values) + 1)
    np.add.at(mark, np.arange(len(values)), values)
    np.add.at(mark, end, -values)
    return np.cumsum(mark)[:-1] - values


def learn_names(trees: list[Tree], label: np.ndarray) -> np.ndarray:
    """(BUCKETS,) log-odds that a name speaks for content, from nodes of label 1 (content) and 0 (not); others, and unknown names, say nothing."""
    counts = np.ones((2, BUCKETS))
    at = 0
    for t in trees:
        for tag, names, y in zip(t.tag, t.names, label[at : at + len(t.tag)].tolist()):
            if y >= 0:
                for k in (tag, *names):
                    counts[y, k] += 1
        at += len(t.tag)
    share = np.log(counts[1].sum() / counts[0].sum())
    return np.clip(np.log(counts[1] / counts[0]) - np.where(counts.sum(axis=0) > 2, share, 0), -4, 4).astype(np.float32)


def features(trees: list[Tree], learned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, len(FEATURES)) of all nodes of all pages, each node's parent and end, and the characters of text below it."""
    sizes = np.array([len(t.parent) for t in trees], np.int64)
    first = np.cumsum(sizes) - sizes
    shift = np.repeat(first, sizes)
    n = int(sizes.sum())

    def column(get, kind=np.int64):
        return np.fromiter((x for t in trees for x in get(t)), kind, n)

    parent = column(lambda t: t.parent)
    root = parent < 0
    parent = np.where(root, np.arange(n), parent + shift)
    end = column(lambda t: t.end) + shift
    group = column(lambda t: t.tag)
    tag = np.where(group == _TEXT, 0, learned[group])
    times = column(lambda t: map(len, t.names))
    word = learned[np.fromiter((k for t in trees for own in t.names for k in own), np.int64, int(times.sum()))]
    owner = np.repeat(np.arange(n), times)
    names, least_name = np.bincount(owner, word, n), np.zeros(n)
    np.minimum.at(least_name, owner, word)
    own = tag + names
    above, least_above = _below(own, end), _below(np.minimum(own, 0), end)
    texts = [x for t in trees for x in t.text]
    size_of = np.fromiter((0 if x is None else len(x) for x in texts), np.int64, n)
    count = lambda f: np.fromiter((0 if x is None else f(x) for x in texts), np.float64, n)
    punct = _inside(count(lambda x: x.count(".") + x.count(",") + x.count("!") + x.count("?") + x.count(";") + x.count(":")), end)
    words = _inside(count(lambda x: x.count(" ") + 1), end)
    digits = _inside(count(lambda x: sum(map(x.count, "0123456789"))), end)
    upper = _inside(count(lambda x: x[:1].isupper()), end)
    length = _inside(size_of, end)
    # text inside links: that of the outermost <a>; nested links count once
    link = np.zeros(n + 1, np.int64)
    a = np.flatnonzero(group == _A)
    np.add.at(link, a, 1)
    np.add.at(link, end[a], -1)
    linked = _inside(np.where(np.cumsum(link)[:-1] > 0, size_of, 0), end)
    size = end - np.arange(n)
    begin = np.concatenate([[0], np.cumsum(size_of)])[:-1]
    child = np.flatnonzero(~root)
    children = np.bincount(parent[child], minlength=n)
    total = np.repeat(length[first], sizes) if len(trees) else length
    depth = _below(np.ones(n), end)
    turn = np.zeros(n, np.int64)
    order = child[np.argsort(parent[child], kind="stable")]
    turn[order] = np.arange(len(order)) - np.searchsorted(parent[order], parent[order])
    siblings = np.where(root, 1, children[parent])
    kind = parent * BUCKETS + group
    like = np.zeros(n)
    if n:
        _, back, times = np.unique(kind, return_inverse=True, return_counts=True)
        like = times[back].astype(np.float64)
    least = np.maximum(length, 1)
    up = length[parent]
    x = np.stack(
        [tag, tag[parent], group == _TEXT, np.minimum(depth, 64), np.log1p(length), linked / least, size / (1 + length / 100), punct / least * 100, digits / least, children, np.log1p(size), turn / np.maximum(siblings, 1), np.log1p(siblings), np.log1p(like), np.log1p((up - length) / np.maximum(siblings - 1, 1)), length / np.maximum(up, 1), length / np.maximum(total, 1), (begin - np.repeat(begin[first], sizes)) / np.maximum(total, 1), names, least_name, above, least_above, np.log1p(up), linked[parent] / np.maximum(up, 1), length / np.maximum(words, 1), upper / np.maximum(words, 1)],
        axis=1,
    ).astype(np.float32)
    return x, parent, end, length
