"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: a node per path of block elements (tag
and class), with how often each child sequence (presentation) and each block text (content)
occurs on how many pages. A node whose pages differ is important, one that looks and reads
alike everywhere is not (entropies, to the base of the number of pages). Each page then
loses the branches of low importance, and those whose element says what it is: menus, forms,
scripts, adverts and the like. Paragraphs and headings inside an article are never taken for
a low branch, so an article that several pages carry stays.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usetrail.llm.common import named, table_written
from usetrail.session import scratch_dir

#: Branches below this composite importance are removed.
LOW = 0.4
#: Weight of the children against the node's own presentation.
INHERIT = 0.9
#: Low branches of all hosts are sent to every task up to this number, else joined by host.
SENT = 200_000

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr br".split()
)
NOISE_TAGS = frozenset(
    "head script style noscript template iframe nav footer aside form button select option input textarea svg canvas"
    " object embed applet menu dialog audio video map".split()
)
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation"
    " menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice popup modal newsletter subscribe"
    " share sharing social related comment comments disqus respond login signup search widget toolbar pagination pager"
    " masthead contentinfo complementary".split()
)
#: Words that only say where or in what shape something stands; beside them a noise word still decides.
LAYOUT_WORDS = frozenset(
    "area bar bottom box block btn button buttons col column container global group holder inner item items left links list"
    " main outer page panel post posts primary right row secondary section side site top wrap wrapper zone".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main"
    " menu nav ol p pre section table ul".split()
)
SAME_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
}
SCOPES = frozenset("html body table ul ol dl article section main aside nav div td th".split())

_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I | re.S)
_LETTERS = re.compile(r"[a-z]+")


def says_noise(name: str) -> bool:
    """Whether a class, id or role names noise: a noise word, and beside it layout words at most."""
    words = set(_LETTERS.findall(name))
    return bool(words & NOISE_WORDS) and words <= NOISE_WORDS | LAYOUT_WORDS


class _Node:
    """An element; block elements have a number that stands for their path of tags and classes."""

    __slots__ = ("tag", "number", "above", "block", "sure", "called", "noise", "article", "children", "held", "gone")

    def __init__(self, tag: str, above: _Node | None, block: _Node | None, sure: bool, called: bool) -> None:
        self.tag = tag
        self.number = 0  # of the root; set for other block elements
        self.above = above  # the element around this one
        self.block = block  # the block element around this one
        self.sure = sure or (above is not None and above.sure)
        self.called = called
        self.noise = False
        self.article = tag in ("article", "main") or (above is not None and above.article)
        self.children: list[str] = []
        self.held, self.gone = 0, False


def _number(above: int, label: str) -> int:
    """The number of a path: a hash of the number of the path above it and the last step."""
    return int.from_bytes(hashlib.blake2b(b"%d>%s" % (above, label.encode("utf-8", "replace")), digest_size=7).digest()) or 1


def parse(page: str) -> tuple[list[tuple[_Node, str]], list[_Node]]:
    """Blocks (element, text) in page order, and all elements, outer ones first.

    `noise` elements hold no article text by tag, class, id or role; a name counts only
    if its words are noise words, with layout words beside them at most, and not on what holds
    an article or main. The time and the memory are linear in the page, however deep it is.
    """
    root = _Node("", None, None, False, False)
    stack, blocks, nodes, held = [root], [], [root], []
    opened: dict[str, int] = {}
    numbers: dict[tuple[int, str], int] = {}
    clear = {root}  # holders of an article or main

    def owner() -> _Node:
        last = stack[-1]
        return last.block if last.tag in INLINE else last

    def hidden() -> bool:
        """Text of an inline element that is noise inside a block that is not."""
        named = False
        for node in reversed(stack):
            if node.tag not in INLINE:
                return named and not node.sure
            named = named or node.sure or node.called
        return False

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((owner(), text))

    def close(depth: int) -> None:
        if any(n.tag not in INLINE for n in stack[depth:]):
            flush()
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    def close_implied(tags: tuple[str, ...] | frozenset, stop: frozenset) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                close(depth)
                return
            if stack[depth].tag in stop:
                return

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            if not hidden():
                held.append(page[at:])
            break
        if found.start() > at and not hidden():
            held.append(page[at : found.start()])
        at = found.end()
        slash, name, rest = found.groups()
        if name is None:
            continue
        tag = name.lower()
        if slash:
            if not opened.get(tag):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if stack[depth].tag in ("table", "article", "main") and tag in INLINE:
                    break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in CLOSES_P and opened.get("p"):
            close_implied(("p",), SCOPES)
        if tag in SAME_CLOSES:
            close_implied(SAME_CLOSES[tag], frozenset(("table", "ul", "ol", "dl", "select")))
        words = []
        if "=" in rest:
            for key, value in _ATTRIBUTE.findall(rest):
                value = value.strip("\"'").lower()
                words.append((key.lower(), value))
        sure = tag in NOISE_TAGS or (tag == "header" and not stack[-1].article)
        called = tag not in ("html", "body", "article", "main") and any(
            says_noise(name) for _, v in words for name in v.split()
        )
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = size if end is None else end.start()
            if end is not None:
                at = page.find(">", at) + 1 or size
            continue
        if tag not in INLINE:
            flush()
        label = tag + "".join(f".{w}" for k, v in words if k == "class" for w in sorted(set(_LETTERS.findall(v))))
        around = owner()
        node = _Node(tag, stack[-1], around, sure, called)
        if tag not in INLINE:
            around.children.append(label)
            step = (around.number, label)
            if step not in numbers:
                numbers[step] = _number(*step)
            node.number = numbers[step]
        if tag in ("article", "main"):  # what holds one is no noise, whatever it is called
            holder = node.above
            while holder not in clear:
                clear.add(holder)
                holder.called = False
                holder = holder.above
        nodes.append(node)
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    for node in nodes:  # names are settled once the page is read
        node.noise = node.sure or node.called or (node.above is not None and node.above.noise)
    return blocks, nodes


def host_of(url: str | None) -> str:
    """Host in lower case without port; empty if there is none."""
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def _feature(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=7).digest())


def style_trees(pages: DataFrame) -> DataFrame:
    """host, node, importance: every node of every host's style tree, named by its path's number.

    Leaves get the content importance 1 - mean(H), where a text on n of the host's m pages
    that have the node has H = log n / log m; inner nodes mix the entropy of their child
    sequences with the importance of the content below. A node on one page only has importance
    1. Counts combine before the shuffle, so a host with very many pages is no hot group. What
    lies below a node is summed by doubling the steps to the root, so a tree of depth d
    takes log2(d) rounds of one row per node.
    """
    source = pages.select(named(pages, "url").alias("url"), named(pages, "html").alias("html"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        for batch in batches:
            out: dict[tuple, int] = {}
            for url, page in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
                host = host_of(url)
                blocks, nodes = parse(page or "")
                seen = {(host, *_place(n), True, _feature(t)) for n, t in blocks}
                seen |= {(host, *_place(n), False, _feature(",".join(n.children))) for n in nodes if n.children}
                seen |= {(*key[:4], None) for key in seen}
                for key in seen:
                    out[key] = out.get(key, 0) + 1
            if out:
                columns = [*zip(*out, strict=True), list(out.values())]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "node", "up", "content", "feature", "n"]
                )

    folder = scratch_dir(pages.sparkSession, "trees")
    own = (
        source.mapInArrow(listed, "host string, node long, up long, content boolean, feature long, n long")
        .groupBy("host", "node", "up", "content", "feature").agg(F.sum("n").alias("n"))
        .groupBy("host", "node", "up", "content")
        .agg(
            F.max(F.when(F.col("feature").isNull(), F.col("n"))).alias("m"),
            F.avg(F.when(F.col("feature").isNotNull(), F.log("n"))).alias("mean_log"),
            F.sum(F.when(F.col("feature").isNotNull(), F.col("n"))).alias("total"),
            F.sum(F.when(F.col("feature").isNotNull(), F.col("n") * F.log("n"))).alias("n_log"),
        )
        .withColumn(
            "importance",
            F.when(F.col("m") <= 1, 1.0)
            .when(F.col("content"), 1 - F.col("mean_log") / F.log("m"))
            .otherwise((F.log("total") - F.col("n_log") / F.col("total")) / F.log("m")),
        )
    )
    texts = F.when(F.col("content"), F.col("total"))
    tree = own.groupBy("host", "node", "up").agg(
        F.max(F.when(~F.col("content"), F.col("importance"))).alias("shown"),
        F.coalesce(F.sum(texts * F.col("importance")), F.lit(0.0)).alias("weight"),
        F.coalesce(F.sum(texts), F.lit(0)).alias("texts"),
    )
    tree = table_written(tree, f"{folder}/0")
    rounds = 0
    while not tree.where("up IS NOT NULL").isEmpty():
        rounds += 1
        # sums reach as far down as `up` reaches up; those one such step below add theirs
        below = tree.where("up IS NOT NULL").groupBy("host", F.col("up").alias("node")).agg(
            F.sum("weight").alias("_weight"), F.sum("texts").alias("_texts")
        )
        above = tree.select("host", F.col("node").alias("up"), F.col("up").alias("_up"))
        tree = tree.join(below, ["host", "node"], "left").join(above, ["host", "up"], "left").select(
            "host", "node", F.col("_up").alias("up"), "shown",
            (F.col("weight") + F.coalesce("_weight", F.lit(0.0))).alias("weight"),
            (F.col("texts") + F.coalesce("_texts", F.lit(0))).alias("texts"),
        )
        tree = table_written(tree, f"{folder}/{rounds}")
    mean = F.col("weight") / F.col("texts")
    return tree.where("texts > 0").select(
        "host", "node",
        F.when(F.col("shown").isNull(), mean).otherwise((1 - INHERIT) * F.col("shown") + INHERIT * mean).alias("importance"),
    )


def _place(node: _Node) -> tuple[int, int | None]:
    """The number of a block element and that of the one around it."""
    return node.number, None if node.block is None else node.block.number


def main_text(page: str | None, low: frozenset | set) -> str:
    """Blocks that are neither noise nor in a low branch, joined by empty lines.

    A branch with half of the page's text or more is never low: a page that its host shows
    under several addresses repeats its article as it repeats its menu. Blocks inside an
    article stay.
    """
    blocks, nodes = parse(page or "")
    blocks = [(node, text) for node, text in blocks if not node.noise]
    if low:
        under: dict[int, int] = {}
        for node, text in blocks:
            node.held += len(text)
        for node in reversed(nodes):
            if node.block is not None and node.held:
                node.block.held += node.held
                under[node.number] = under.get(node.number, 0) + node.held
        total = nodes[0].held
        for node in nodes[1:]:
            node.gone = node.block.gone or (node.number in low and 2 * under.get(node.number, 0) < total)
    return "\n\n".join(text for node, text in blocks if node.article or not node.gone)


def extracted(pages: DataFrame, low: float = LOW, sent: int = SENT) -> DataFrame:
    """page_id, url, text: the main text of every page, one row per input row.

    Null and empty pages have the empty text; null urls make a host of their own; repeated
    pages count as pages of their host. White space (as Unicode has it) inside a block is
    one space, also where a line break element stands.
    """
    spark = pages.sparkSession
    poor = style_trees(pages).where((F.col("importance") < low) & (F.col("node") != 0)).select("host", "node")
    head = poor.limit(sent + 1).collect()
    source = pages.select(
        named(pages, "page_id").alias("page_id"), named(pages, "url").alias("url"), named(pages, "html").alias("html")
    )
    if len(head) <= sent:
        by_host: dict[str, set] = {}
        for row in head:
            by_host.setdefault(row.host, set()).add(row.node)
        table = spark.sparkContext.broadcast(by_host)

        @F.arrow_udf("string")
        def text_here(urls: pa.Array, bodies: pa.Array) -> pa.Array:
            hosts = table.value
            return pa.array(
                [main_text(b, hosts.get(host_of(u), frozenset())) for u, b in zip(urls.to_pylist(), bodies.to_pylist(), strict=True)],
                pa.string(),
            )

        return source.select("page_id", "url", text_here("url", "html").alias("text"))

    host = F.udf(lambda url: host_of(url), "string")
    lists = poor.groupBy("host").agg(F.collect_set("node").alias("low"))

    @F.arrow_udf("string")
    def text_joined(bodies: pa.Array, lows: pa.Array) -> pa.Array:
        return pa.array(
            [main_text(b, set(x or ())) for b, x in zip(bodies.to_pylist(), lows.to_pylist(), strict=True)], pa.string()
        )

    return source.withColumn("host", host("url")).join(lists, "host", "left").select(
        "page_id", "url", text_joined("html", "low").alias("text")
    )
