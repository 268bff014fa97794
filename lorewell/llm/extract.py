"""The main text of web pages: gradient-boosted trees judge DOM nodes, hierarchical decoding makes their judgements agree.

Each element and text node gets log-odds of being content from its features
(``dom.FEATURES``), among them what its tag and the words of its attributes, and those
above it, were learned to say.  A node is then kept whole, dropped whole, or mixed, which
leaves the choice to its children; below a kept node all is kept, below a dropped
one all is dropped, so that no descendant contradicts an ancestor.  Of all such
choices the one with the largest sum of log-odds (those of text nodes weighed by their
length) is found exactly from the leaves up.

The trees are trained on made-up pages (``made_page``) whose text nodes are known to
be content or not; ``forest.npz`` beside this file has them, ``train`` makes it anew.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.llm import dom, trees
from lorewell.llm.bytetext import slices

FOREST = os.path.join(os.path.dirname(__file__), "forest.npz")
MIX, SURE = 0.5, 6.0
TEXTS = "page_id long, url string, text string, n_nodes int, n_kept int"
KEEP, DROP, MIXED = 1, 0, 2
_SPACE = re.compile(r"\s+")


def decode(parent: np.ndarray, end: np.ndarray, length: np.ndarray, score: np.ndarray, mix: float = MIX) -> np.ndarray:
    """KEEP, DROP or MIXED for every node (document order, roots are their own parents); nodes without text are dropped.

    Maximises the sum of +score (kept) and -score (dropped) of the nodes that have
    text, less ``mix`` for each mixed node; equal sums prefer keep, then drop.
    """
    n = len(parent)
    value = np.where(length > 0, score, 0.0)
    run = np.concatenate([[0.0], np.cumsum(value)])
    whole = run[end] - run[:-1]
    below = [0.0] * n  # best sums of the children so far
    choice = [DROP] * n
    has, up, single = (length > 0).tolist(), parent.tolist(), (end - np.arange(n) == 1).tolist()
    sums = whole.tolist()
    for v in range(n - 1, -1, -1):
        if not has[v]:
            continue
        keep = sums[v]
        best, pick = (keep, KEEP) if keep >= 0 else (-keep, DROP)
        if not single[v] and below[v] - mix > best + 1e-9:
            best, pick = below[v] - mix, MIXED
        choice[v] = pick
        if up[v] != v:
            below[up[v]] += best
    for v in range(n):
        p = up[v]
        if p != v and choice[p] != MIXED:
            choice[v] = choice[p] if has[v] else DROP
    return np.array(choice, np.int64)


@dataclass
class Model:
    names: np.ndarray
    forest: trees.Forest


def load() -> Model:
    with np.load(FOREST) as f:
        return Model(f["names"].astype(np.float32), trees.Forest(f["feature"].astype(np.int64), f["cut"], f["leaf"], float(f["base"])))


def judge(model: Model, pages: list[dom.Tree]) -> np.ndarray:
    """Choice for every node of all pages."""
    x, parent, end, length = dom.features(pages, model.names)
    some = np.flatnonzero(length > 0)
    score = np.zeros(len(x))
    text = x[some, dom.FEATURES.index("is_text")] > 0
    score[some] = np.clip(model.forest.log_odds(x[some]), -SURE, SURE) * np.where(text, np.log1p(length[some]), 1.0)
    return decode(parent, end, length, score)


def render(tree: dom.Tree, choice: np.ndarray) -> tuple[str, int, int]:
    """(text, text nodes, kept text nodes): white space collapses but in preformatted text, blocks stand on lines."""
    lines: list[str] = []
    parts: list[str] = []
    block, kept, every = -1, 0, 0

    def flush() -> None:
        line = "".join(parts).strip()
        if line:
            lines.append(line)
        parts.clear()

    for text, own, pre, c in zip(tree.text, tree.block, tree.pre, choice.tolist()):
        if text is None:
            continue
        every += 1
        if c != KEEP:
            continue
        kept += 1
        if own != block:
            flush()
            block = own
        parts.append(text if pre else _SPACE.sub(" ", text))
    flush()
    return "\n".join(lines), every, kept


def extract(model: Model, pages: list[str | None]) -> list[tuple[str, int, int]]:
    parsed = [dom.parse(p) for p in pages]
    choice, at, out = judge(model, parsed), 0, []
    for t in parsed:
        out.append(render(t, choice[at : at + len(t.parent)]))
        at += len(t.parent)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_nodes, n_kept), a row for every row of ``pages``: the text, and how many of its text nodes are in it.

    A null page has a null text and no nodes; an empty page, one without text
    or one that is all boilerplate has the empty text.  A null page_id or url
    stays null; repeated rows are treated alike.  Other columns are ignored; an
    empty table gives an empty result.  Pages of any length are parsed whole, one
    by one; nothing is shuffled.
    """
    model = load()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html", 1 << 20):
                html = batch.column("html").to_pylist()
                found = extract(model, html)
                texts = [None if h is None else t for h, (t, _, _) in zip(html, found)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([n for _, n, _ in found], pa.int32()), pa.array([k for _, _, k in found], pa.int32())],
                    names=["page_id", "url", "text", "n_nodes", "n_kept"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, TEXTS)


CONTENT, BOILERPLATE = "\x01", "\x02"  # marks at the head of every text of a made-up page
_BAD = "nav menu navbar navigation footer foot sidebar aside ad ads advert advertisement banner cookie consent social share sharing related recommend recommended comments promo sponsor sponsored breadcrumb breadcrumbs copyright subscribe newsletter popup modal widget login signup search pager pagination toolbar tags byline legal topbar links masthead skip teaser rail gdpr disclaimer follow sitemap".split()
_GOOD = "article content post entry main body text story blog prose hentry maincontent paragraph document chapter lead intro abstract section news detail".split()
_WRONG = _BAD + ["comments", "related", "sidebar", "widget"] * 6  # what parts are called that deserve it not
_ANY = "container wrapper page row col column box block inner outer left right center grid item list card clearfix group panel module region view field large small first last primary secondary".split()


def made_page(rng: np.random.Generator) -> str:
    """A page of invented words in one of many layouts; each text begins with the mark of what it is.

    Tags, attribute words, order and nesting are drawn independently, so that each
    is evidence and none is proof; some pages leave tags open, some mislabel parts.
    """
    pick = lambda items: items[int(rng.integers(len(items)))]
    chance = lambda p: rng.random() < p
    several = lambda low, high: range(int(rng.integers(low, high)))
    syllables = "ba co di fe gu ha in jo ka le mi no or pa qu re si to un ve wa en er st th".split()
    shut, bare = chance(0.8), rng.choice([0.1, 0.4, 0.9])

    def words(n: int, end: str = "") -> str:
        made = " ".join("".join(pick(syllables) for _ in several(1, 5)) for _ in range(n))
        return made.capitalize() + end

    def sentence() -> str:
        n, noise = int(rng.integers(3, 20)), pick(["", "", "", "", ",", ";", " -"])
        return words(n).replace(" ", noise + " ", 1 + n // 4) + pick([".", ".", ".", "!", "?", ":"])

    def prose(sentences: int, mark: str = CONTENT) -> str:
        out = []
        for _ in range(sentences):
            s = sentence()
            if chance(0.12):
                tag, at = pick("b i em strong a span code u mark sub abbr".split()), s.find(" ") + 1
                s = f"{s[:at]}<{tag}{' href=/x' if tag == 'a' else ''}>{mark}{words(int(rng.integers(1, 4)))}</{tag}>{mark} {s[at:]}"
            out.append(s)
        return mark + pick([" ", " ", "\n", "<br>" + mark, "<br/><br/>" + mark]).join(out)

    def attrs(names: list[str]) -> str:
        if chance(bare):
            return ""
        made = pick(names) if chance(0.9) else pick(_ANY)
        made += pick(["", "", "", "-" + pick(_ANY), " " + pick(_ANY), "_" + pick(names), str(int(rng.integers(0, 20)))])
        quote = pick(['"', '"', "'"])
        return f" {pick(['class', 'class', 'class', 'id', 'role'])}={quote}{made}{quote}"

    def links(n: int) -> str:
        item = lambda: f'<a href="/{words(1)}">{BOILERPLATE}{words(int(rng.integers(1, 5)))}</a>'
        form = pick(["ul", "ul", "plain", "div", "table", "select"])
        each = [item() for _ in range(n)]
        if form == "ul":
            return "<ul>" + "".join(f"<li>{x}" + "</li>" * shut for x in each) + "</ul>"
        if form == "table":
            return "<table><tr>" + "".join(f"<td>{x}</td>" for x in each) + "</tr></table>"
        if form == "select":
            return "<select>" + "".join(f"<option>{BOILERPLATE}{words(1)}</option>" for _ in each) + "</select>" if chance(0.3) else " ".join(each)
        return "".join(f"<{form}>{x}</{form}>" for x in each) if form == "div" else f" {BOILERPLATE}{pick(['|', '·', '/', ''])} ".join(each)

    def nav() -> str:
        tag = pick(["nav", "nav", "div", "div", "header", "section", "td"])
        title = f"<h1>{BOILERPLATE}{words(2)}</h1>" if tag == "header" and chance(0.4) else ""
        return f"<{tag}{attrs(_BAD)}>{title}{links(int(rng.integers(2, 12)))}</{tag}>"

    def notice() -> str:
        text = BOILERPLATE + words(int(rng.integers(1, 8))) if chance(0.35) else prose(int(rng.integers(1, 5)), BOILERPLATE)
        tag = pick(["div", "div", "div", "aside", "aside", "section", "p", "form", "noscript", "dialog"])
        heading = f"<h{pick('2345')}>{BOILERPLATE}{words(int(rng.integers(1, 4)))}</h3>" if chance(0.3) else ""
        inner = pick([text, f"<p>{text}</p>", f"<span>{text}</span>", f"{heading}<p>{text}</p>{links(int(rng.integers(1, 6)))}", heading + "".join(f"<p>{prose(1, BOILERPLATE)}</p>" for _ in several(1, 4))])
        own = f' {pick(["class", "id"])}="{pick(_BAD)}{pick(["", "-" + pick(_ANY), " " + pick(_BAD)])}"' if tag in ("div", "section", "p") and not chance(0.03) else attrs(_BAD)
        return f"<{tag}{own}>{inner if tag != 'p' else text}</{tag}>"

    def comments() -> str:
        each = "".join(f"<div{attrs(['comment', 'reply', 'user'])}><b>{BOILERPLATE}{words(1)}</b><p>{prose(int(rng.integers(1, 4)), BOILERPLATE)}</p></div>" for _ in several(1, 6))
        return f"<{pick(['div', 'section'])} {pick(['class', 'id'])}=\"{pick(['comments', 'comment-list', 'discussion', 'replies'])}\"><h3>{BOILERPLATE}{words(1)}</h3>{each}</div>"

    def foot() -> str:
        tag = pick(["footer", "footer", "div", "address"])
        text = BOILERPLATE + pick(["© 2024 " + words(3), words(int(rng.integers(1, 12)), "."), "Copyright " + words(2), words(4)])
        text = prose(int(rng.integers(1, 4)), BOILERPLATE) if chance(0.3) else text
        return f"<{tag}{attrs(_BAD)}>{pick([text, '<p>' + text + '</p>', text + links(3), '<small>' + text + '</small>'])}</{tag}>"

    def block() -> str:
        text = prose(int(pick([1, 1, 2, 3, 5, 9])))
        close = lambda tag: f"</{tag}>" if shut else ""
        form = pick(["p"] * 9 + ["h", "h", "list", "quote", "pre", "table", "div", "dl", "figure", "bare", "math", "notice"])
        if form == "h":
            return f"<h{pick('23456')}>{CONTENT}{words(int(rng.integers(1, 9)))}</h2>"
        if form == "list":
            tag = pick(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{prose(1)}{close('li')}" for _ in several(2, 7)) + f"</{tag}>"
        if form == "quote":
            return f"<blockquote>{pick([text, '<p>' + text + '</p>'])}</blockquote>"
        if form == "pre":
            return f"<pre>{CONTENT}{words(6)}\n  {words(3)}</pre>"
        if form == "table":
            return "<table>" + "".join(f"<tr><td>{CONTENT}{words(2)}{close('td')}<td>{CONTENT}{int(rng.integers(1, 999))}{close('td')}" for _ in several(2, 6)) + "</table>"
        if form == "dl":
            return "<dl>" + "".join(f"<dt>{CONTENT}{words(1)}{close('dt')}<dd>{prose(1)}{close('dd')}" for _ in several(1, 4)) + "</dl>"
        if form == "figure":
            return f"<figure><img src=/x><figcaption>{prose(1)}</figcaption></figure>"
        if form == "math":
            return f"<p>{text} <math><mi>{CONTENT}x</mi><mo>{CONTENT}=</mo><mn>{CONTENT}{int(rng.integers(0, 99))}</mn></math></p>"
        if form == "bare":
            return text + pick(["<br>", "<br><br>", "<hr>"])
        if form == "notice":
            return notice() if chance(0.5) else comments() if chance(0.2) else f"<div>{text}</div>"
        tag = "p" if form == "p" else "div"
        head = f"<{pick(['b', 'strong', 'i'])}>{CONTENT}{words(2)}{pick(['</b>', '</strong>', '</i>', ''])}{pick(['', '<br>'])}" if chance(0.06) else ""
        return f"<{tag}{attrs(_ANY) if chance(0.2) else ''}>{head}{text}{close(tag) if tag == 'p' else '</div>'}"

    def body() -> str:
        out = [f"<h1>{CONTENT}{words(int(rng.integers(1, 12)))}</h1>"] if chance(0.75) else []
        out += [block() for _ in range(int(pick([1, 1, 2, 3, 5, 8, 15, 30, 120] if chance(0.2) else [1, 1, 2, 3, 5, 8, 15])))]
        tag = pick(["article", "article", "article", "main", "div", "div", "div", "section", "td", "bare"])
        inner = "".join(out)
        if chance(0.15):
            inner = f"<div{attrs(_ANY + _GOOD if chance(0.7) else _WRONG)}>{inner}</div>"
        if tag == "bare":
            return inner
        own = attrs(_GOOD if chance(0.88) else _WRONG)  # a page may name its parts badly
        return f"<{tag}{own}>{inner}</{tag}>" if tag != "td" else f"<table><tr><td{own}>{inner}</td></tr></table>"

    before = [pick([nav, nav, notice])() for _ in range(pick([0, 1, 1, 2, 3]))]
    after = [pick([notice, notice, nav, comments])() for _ in range(pick([0, 0, 1, 2, 3]))]
    if chance(0.03):
        return pick(["", "<html><body>", "<p>", "<pre>", "<body><div>"]) + prose(int(rng.integers(1, 30)))
    parts = before + [body()] + after + [foot() for _ in range(pick([0, 1, 1, 1]))]
    inner = pick(["", "\n"]).join(parts)
    for _ in range(pick([0, 0, 1, 2])):
        inner = f"<div{attrs(_ANY if chance(0.9) else _WRONG)}>{inner}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(5)}</title><style>p{{margin:0}}</style></head><body>{inner}" + pick(["</body></html>", ""])


def labelled(rng: np.random.Generator, pages: int) -> tuple[list[dom.Tree], np.ndarray]:
    """Parsed pages without marks, and 1 (all text below is content), 0 (none is) or -1 (both, or no text) for each of their nodes."""
    parsed, labels = [], []
    for _ in range(pages):
        t = dom.parse(made_page(rng))
        good = np.array([0 if x is None else CONTENT in x for x in t.text])
        bad = np.array([0 if x is None else BOILERPLATE in x for x in t.text])
        t.text = [None if x is None else x.replace(CONTENT, "").replace(BOILERPLATE, "") for x in t.text]
        end = np.array(t.end)
        g, b = dom._inside(good, end), dom._inside(bad, end)
        parsed.append(t)
        labels.append(np.where((g > 0) & (b == 0), 1, np.where((b > 0) & (g == 0), 0, -1)))
    return parsed, np.concatenate(labels)


def train(pages: int = 3000, seed: int = 11) -> Model:
    """Names are learned from half as many pages of their own, so that the trees see them as they come on new pages."""
    rng = np.random.default_rng(seed)
    names = dom.learn_names(*labelled(rng, pages // 2))
    parsed, y = labelled(rng, pages)
    x, _, _, length = dom.features(parsed, names)
    some = np.flatnonzero((y >= 0) & (length > 0))
    return Model(names, trees.fit(x[some], y[some], trees=100, depth=5))


def save(model: Model, path: str = FOREST) -> None:
    f = model.forest
    np.savez_compressed(path, names=model.names.astype(np.float16), feature=f.feature.astype(np.uint8), cut=f.cut, leaf=f.leaf, base=f.base)


if __name__ == "__main__":
    save(train())
