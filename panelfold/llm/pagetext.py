"""Main text of web pages: a tree-structured graphical model over the DOM."""

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelfold.llm.textscan import pieces

# Pages whose documents are known and that the model learns from, at most.
TRAIN_PAGES = 600
_TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
                  r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\shidden(?:[\s=]|$)|display\s*:\s*none", re.I)
_WORD = re.compile("[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Never shown as text.
SILENT = frozenset("head title script style noscript template iframe object svg math canvas audio video "
                   "select option datalist button textarea".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
# Tags that end an open paragraph, and tags that end an open one of their kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
                   "h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"),
          "th": ("table", "tr"), "option": ("select",)}
# What names of tags, classes and ids say before any page is seen.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination popup popular promo promoted related reply replies search share sharing sidebar signup social "
    "sponsor sponsored subscribe tags toolbar topbar widget".split())
TEXT_WORDS = frozenset("article body content entry main page post story text".split())
ASIDE_TAGS = frozenset("nav aside footer header form menu dialog".split())
TEXT_TAGS = frozenset("article main".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
PRIOR, STAY, TURN = 40.0, 60.0, 3.0
# How much one feature can say: names of parts a lot, the look of a block little, so
# that prose in a comment or a heading in a page header goes with what holds it.
MUCH, LITTLE = 4.0, 0.4
# No state is rarer than this below the other: a page may be mostly menus.
RAREST = 0.05


class Node:
    __slots__ = ("tag", "words", "parent", "children", "text", "linked", "label", "silent")

    def __init__(self, tag, parent, words=(), silent=False):
        self.tag, self.parent, self.words, self.silent = tag, parent, words, silent
        self.children, self.text, self.linked, self.label = [], None, 0, None


def parse(page: str) -> list[Node]:
    """Nodes of a page, parents first: elements that aren't inline, and text blocks.

    A block is a run of text and inline tags between other tags, its white space
    turned into single blanks and its character references decoded.
    """
    root = Node("#page", None)
    nodes, here = [root], root
    inline: Counter[str] = Counter()
    inside: Counter[str] = Counter()  # names of the open elements
    parts: list[str] = []
    linked = at = 0

    def close_block():
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            parts.clear()
            if text and not here.silent:
                block = Node("#text", here)
                block.text, block.linked = text, min(1.0, linked / max(1, len(raw)))
                here.children.append(block)
                nodes.append(block)
        linked = 0

    def pop_to(names, fences=()):
        """Close the innermost open element of ``names`` unless a fence lies before it."""
        nonlocal here
        if not any(inside[name] for name in names):
            return
        node = here
        while node.parent is not None and node.tag not in names:
            if node.tag in fences:
                return
            node = node.parent
        if node.parent is not None:
            while here is not node.parent:
                inside[here.tag] -= 1
                here = here.parent

    end, last = len(page), page.rfind(">")
    while at < end:
        # Behind the last ">" no tag ends: only a comment may still begin.
        found = _TAG.search(page, at) if at <= last else None
        stop = found.start() if found else end
        if not found and (comment := page.find("<!--", at)) >= 0:
            stop = comment
        if stop > at:
            parts.append(page[at:stop])
            if inline["a"]:
                linked += stop - at
        if not found:
            break
        at = found.end()
        name = found.group(2) or found.group(5)
        if not name:
            continue
        name = name.lower()
        closing, attributes = found.group(1) or found.group(4), found.group(3) or found.group(6) or ""
        if name in INLINE:
            if not closing and not attributes.endswith("/"):
                inline[name] += 1
            elif closing and inline[name]:
                inline[name] -= 1
            continue
        close_block()
        if closing:
            inline.clear()
            if name not in VOID:
                pop_to((name,))
            continue
        if name in ENDS_P:
            pop_to(("p",), ("table", "td", "th", "div", "article", "section", "body"))
            inline.clear()
        if name in SIBLINGS:
            pop_to(SIBLINGS[name], FENCES[name])
        if name in VOID:
            continue
        words = tuple(sorted({w for m in _NAMES.findall(attributes) for w in _WORD.findall(m.lower())})) \
            if "=" in attributes else ()
        silent = here.silent or name in SILENT or bool(attributes and _HIDDEN.search(" " + attributes))
        node = Node(name, here, words, silent)
        here.children.append(node)
        nodes.append(node)
        if name in RAW:  # up to its end tag, whatever stands inside
            closed = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = closed.end() if closed else end
        elif not attributes.endswith("/"):
            here = node
            inside[name] += 1
    close_block()
    return nodes


def features(node: Node) -> list[str]:
    if node.text is None:
        known = [f"word:{w}" for w in node.words if w in ASIDE_WORDS or w in TEXT_WORDS]
        other = [f"class:{sum(map(ord, w)) * 31 % 509}" for w in node.words
                 if w not in ASIDE_WORDS and w not in TEXT_WORDS]
        return [f"tag:{node.tag}"[:40], *known, *other]
    text = node.text
    words = text.count(" ") + 1
    return [f"in:{node.parent.tag}"[:40], f"words:{min(6, words.bit_length())}", f"links:{round(3 * node.linked)}",
            f"stop:{text[-1] in '.!?:'}", f"mark:{'©' in text or '|' in text}"]


def label(nodes: list[Node], known: str) -> None:
    """Mark blocks by the known text, and elements by what most of the text inside them is.

    Blocks of four or more words are content if the known text holds them. Shorter ones
    may occur in it by chance: between content they count if it holds them, outside
    they are none; short headings and paragraphs there stay unmarked.
    """
    known = " ".join(known.split())
    blocks = [n for n in nodes if n.text is not None]
    for node in blocks:
        if node.text.count(" ") >= 3:
            node.label = int(node.text in known)
    sure = [i for i, n in enumerate(blocks) if n.label == 1]
    if sure:
        for i, node in enumerate(blocks):
            if node.label is None:
                if sure[0] < i < sure[-1]:
                    node.label = int(node.text in known)
                elif node.parent.tag not in PROSE_TAGS:
                    node.label = 0
    sums: dict[int, list[int]] = {}
    for node in reversed(nodes):
        got = sums.get(id(node), [0, 0])
        if node.text is None:
            if got[0] or got[1]:
                node.label = int(got[1] > got[0])
        elif node.label is not None:
            got = [0, 0]
            got[node.label] = len(node.text)
        if node.parent is not None:
            above = sums.setdefault(id(node.parent), [0, 0])
            above[0] += got[0]
            above[1] += got[1]


class TreeModel:
    """Binary states on a DOM tree: log-odds of features, parent-child potentials."""

    def __init__(self, counts: dict[str, list[float]]):
        def of(name):
            return counts.get(name, (0.0, 0.0))

        self.total = [sum(v[s] for k, v in counts.items() if k == "state") + 2.0 for s in (0, 1)]
        kinds = Counter(k.partition(":")[0] for k in counts)
        self.odds = {}
        for name in {*counts, *(f"tag:{t}" for t in ASIDE_TAGS | TEXT_TAGS),
                     *(f"word:{w}" for w in ASIDE_WORDS | TEXT_WORDS)}:
            kind, _, value = name.partition(":")
            if kind in ("state", "pair"):
                continue
            aside = value in (ASIDE_TAGS if kind == "tag" else ASIDE_WORDS if kind == "word" else ())
            text = value in (TEXT_TAGS if kind == "tag" else TEXT_WORDS if kind == "word" else ())
            prior = [PRIOR if aside else 1.0, PRIOR if text else 1.0]
            seen = of(name)
            spread = kinds[kind] + 2.0
            # Prior counts stand for themselves: they don't depend on how much was seen.
            p = [(seen[s] + 0.5) / (self.total[s] + 0.5 * spread) for s in (0, 1)]
            learned = math.log(p[1] / p[0]) if seen[0] + seen[1] else 0.0
            most = MUCH if aside or text or kind == "class" else LITTLE
            weight = (seen[0] + seen[1]) / (seen[0] + seen[1] + PRIOR / 4)
            self.odds[name] = weight * max(-most, min(most, learned)) \
                + (1 - weight) * math.log(prior[1] / prior[0])
        turn = {}
        for a in (0, 1):
            n = [of(f"pair:{a}{b}")[1] + (STAY if a == b else TURN) for b in (0, 1)]
            chance = min(1 - RAREST, max(RAREST, n[1] / sum(n)))
            turn[a] = [math.log(1 - chance), math.log(chance)]
        self.turn = turn

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance that each node is content: messages up to the root, then down again."""
        place = {id(n): i for i, n in enumerate(nodes)}
        own = [sum(self.odds.get(f, 0.0) for f in features(n)) for n in nodes]
        up0, up1 = [0.0] * len(nodes), own[:]
        sent = [(0.0, 0.0)] * len(nodes)
        t = self.turn

        def plus(a, b):
            return max(a, b) + math.log1p(math.exp(-abs(a - b)))

        for i in range(len(nodes) - 1, 0, -1):
            m0 = plus(t[0][0] + up0[i], t[0][1] + up1[i])
            m1 = plus(t[1][0] + up0[i], t[1][1] + up1[i])
            sent[i] = (m0, m1)
            p = place[id(nodes[i].parent)]
            up0[p] += m0
            up1[p] += m1
        down = [(0.0, 0.0)] * len(nodes)
        out = [0.5] * len(nodes)
        for i, node in enumerate(nodes):
            if i:
                p = place[id(node.parent)]
                above0 = down[p][0] + up0[p] - sent[i][0]
                above1 = down[p][1] + up1[p] - sent[i][1]
                down[i] = (plus(t[0][0] + above0, t[1][0] + above1), plus(t[0][1] + above0, t[1][1] + above1))
            gap = down[i][0] + up0[i] - down[i][1] - up1[i]
            out[i] = 1 / (1 + math.exp(max(-700.0, min(700.0, gap))))
        return out

    def text(self, page: str) -> str:
        nodes = parse(page)
        chance = self.marginals(nodes)
        return " ".join(n.text for n, c in zip(nodes, chance) if n.text is not None and c > 0.5)


def counted(page: str, known: str, counts: dict[str, list[float]]) -> None:
    """Add one labelled page's features and parent-child pairs."""
    nodes = parse(page)
    label(nodes, known)
    for node in nodes[1:]:
        if node.label is None or node.silent:
            continue
        for name in ["state", *features(node)]:
            counts.setdefault(name, [0.0, 0.0])[node.label] += 1
        if node.parent.label is not None:
            counts.setdefault(f"pair:{node.parent.label}{node.label}", [0.0, 0.0])[1] += 1


def train(labelled: DataFrame) -> TreeModel:
    """Fit on pages (html) whose main text (text) is known; counts are summed by Spark.

    Only sums per feature reach the driver: tags, listed words, 509 classes of other names.
    Without labelled pages the model is what names of tags and classes say.
    """
    rows = labelled.where("html is not null and text is not null").select("html", "text")

    def run(batches):
        for batch in pieces(batches, "html"):
            counts: dict[str, list[float]] = {}
            for page, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counted(page, known, counts)
            names = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([counts[n][0] for n in names], pa.float64()),
                 pa.array([counts[n][1] for n in names], pa.float64())], names=["f", "a", "b"])

    found = (rows.mapInArrow(run, "f string, a double, b double").groupBy("f")
             .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect())
    return TreeModel({r["f"]: [r["a"], r["b"]] for r in found})


def training_pages(pages: DataFrame, docs: DataFrame, document_id, most: int = TRAIN_PAGES) -> DataFrame:
    """At most ``most`` pages (by hash of the id) with the text of the document they show."""
    shown = pages.select("page_id", document_id.alias("_doc"), "html").where("_doc is not null")
    # The ids are chosen first: whole pages and texts move only for the chosen.
    chosen = shown.select("page_id", "_doc").orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    known = docs.select(F.col("doc_id").alias("_doc"), "text")
    texts = known.join(F.broadcast(chosen.select("_doc").distinct()), "_doc")  # most rows at most
    return (shown.join(F.broadcast(chosen.select("page_id").distinct()), "page_id")
            .join(texts, "_doc").select("html", "text"))


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """``page_id, url, text, n_chars``: the blocks likelier content than not, in page order.

    Whole pages are read; null html counts as empty and gives an empty text. Ids and
    urls pass through as they are; repeated rows stay; no rows, no rows.
    """
    def run(batches):
        for batch in pieces(batches, "html", 1 << 21):
            texts = [model.text(p or "") for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("bigint")}).schema
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
