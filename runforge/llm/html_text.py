r"""HTML extraction: the main text of each page, by deducing the template that pages of a host share.

A page is read into a tree, with the end tags that HTML implies, and so into a sequence of
tokens: its elements, told apart by their path of tags, classes and ids (and containers such
as ``div`` by their number among like siblings), and its text blocks, told apart by path and text. Tokens of a host that occur equally often in each of
its pages share an occurrence vector.

1. :func:`tokenised` stores each page's tokens as 64-bit hashes, with the text under its elements
   weighed. :func:`token_vectors` sums, for each host and token, a 128-bit digest of (page,
   number of occurrences) over pages: equal sums are equal vectors, and sums meet from any
   number of tasks, so a host with a third of all pages is spread over all of them.
2. :func:`classes`: the tokens of a host with one vector, in at least half of its pages, are
   an equivalence class; a host of fewer than ``MIN_PAGES`` pages has none.
3. :func:`evidence` follows each page's tokens with its host's classes. A class is valid if its
   tokens come in one order, in every page and every repetition, and nested: no instance
   straddles one of another class. The same pass sums the weights of the elements that
   a template has once.
4. :func:`templates` nests the valid classes and keeps a row a host: which text blocks belong to the
   template (those in a valid class that holds markup too), and the main element, the
   deepest that holds half of the host's text, of its headings and more than half of its
   blocks, or the article around it.
5. :func:`extract` reads the pages a second time. What remains in the main element, the
   slots of the template, is the page's text, less what marks itself as no article: tags such
   as ``nav``, ``aside`` or ``form``, roles, and class or id words such as ``ad`` or ``comments``.

A host's template has at most twice the tokens of its average page; its table meets the
pages in a join that Spark broadcasts when it measures it under its limit, and otherwise
shuffles, where adaptive execution splits a hot host.

Cases: a null page, or one without text, has the empty text; pages without a host in their
url are one host; on a host without template, and in a page that lacks the main element, a page's own elements are
weighed. If nothing would remain, first template blocks stay, then blocks under a
class or id word. Repeated pages and equal ids are separate rows. An empty table gives an
empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.llm.common import prepare, whole_text
from runforge.session import materialize

#: Pages a host needs for a template: fewer may share a text by chance.
MIN_PAGES = 10
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?|["'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# fixed values: elements by their role in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img".split())
#: What an opening tag closes, up to which elements it looks.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
          "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
          "tbody": ("thead tbody tr td th", "table"), "thead": ("tbody tr td th", "table"), "tfoot": ("tbody thead tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

# fixed values: what is no article
NO_TEXT = frozenset("head nav aside footer form script style title noscript template iframe svg math object embed canvas audio video "
                    "map select button textarea input fieldset dialog menu noembed noframes xmp".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar status".split())
NO_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense alert banner breadcrumb breadcrumbs comment "
                     "comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu menus modal nav navbar "
                     "navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related "
                     "replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription teaser teasers toolbar "
                     "topbar widget widgets".split())
KEPT_TAGS = frozenset("html body article main".split())
#: Elements that can be a page's main element.
CONTAINERS = frozenset("html body main article section div center".split())
NONE: dict[str, str] = {}


class Element:
    __slots__ = ("tag", "token", "depth", "off", "marked", "article", "link", "item", "heading", "number")

    def __init__(self, tag: str, token: int, above: Element | None, attributes: dict[str, str]) -> None:
        self.tag, self.token = tag, token
        self.number: dict[str, int] = {}
        self.depth = above.depth + 1 if above else 1
        self.article = tag == "article" or bool(above and above.article)
        self.link = tag == "a" or bool(above and above.link)
        self.item = tag == "li" or bool(above and above.item)
        self.heading = tag == "h1" or bool(above and above.heading)
        off = tag in NO_TEXT or (tag == "header" and not (above and (above.article or above.tag == "main")))
        marked = False
        if attributes and tag not in KEPT_TAGS:
            off = off or attributes.get("role", "").lower() in NO_ROLE or "hidden" in attributes \
                or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
            if named != " ":
                words = {w.lower() for w in WORD.findall(named)}
                marked = not words.isdisjoint(NO_WORDS) or ("header" in words and not self.article)
        self.off = off or bool(above and above.off)
        self.marked = marked or bool(above and above.marked)


class Block:
    """A text block: its text, its token, the open elements around it, and how much of it is links."""
    __slots__ = ("text", "token", "around", "linked")

    def __init__(self, text: str, token: int, around: tuple[Element, ...], linked: bool) -> None:
        self.text, self.token, self.around, self.linked = text, token, around, linked


class Reader:
    """Pages to tokens; hashes of paths are remembered."""

    def __init__(self) -> None:
        from xxhash import xxh3_64_intdigest
        self.hash = xxh3_64_intdigest
        self.paths: dict[tuple[int, str], int] = {}

    def token(self, above: int, key: str) -> int:
        if (above, key) not in self.paths:
            if len(self.paths) > 100_000:
                self.paths.clear()
            self.paths[above, key] = self.hash(f"{above}>{key}") - (1 << 63)
        return self.paths[above, key]

    def read(self, page: str) -> list[Element | Block]:
        """Elements and blocks in page order."""
        out: list[Element | Block] = []
        stack: list[Element] = []
        text: list[str] = []
        numbers: dict[str, int] = {}
        linked = True  # so far all of the block's text is in links

        def close_block() -> None:
            nonlocal linked
            joined = "".join(text)
            text.clear()
            whole = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
            if whole:
                above = stack[-1].token if stack else 0
                out.append(Block(whole, self.hash(f"{above}:{whole}") - (1 << 63), tuple(stack), linked))
            linked = True

        def add(piece: str) -> None:
            nonlocal linked
            text.append(piece)
            if linked and not (stack and stack[-1].link) and not piece.isspace():
                linked = False

        find, at, n = TAG.search, 0, len(page)
        while at < n:
            match = find(page, at)
            if match is None:
                add(page[at:])
                break
            start = match.start()
            if start > at:
                add(page[at:start])
            at = match.end()
            closing, name, rest = match.groups()
            if name is None:
                continue
            name = name.lower()
            inline = name in INLINE
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == name:
                        if text and not inline:
                            close_block()
                        del stack[k:]
                        break
                    if inline and stack[k].tag not in INLINE:
                        break  # its element ends with the block it began in
                continue
            if name == "br":
                add(" ")
                continue
            if not inline:
                if text:
                    close_block()
                if name not in VOID:
                    for k in range(len(stack) - 1, -1, -1):
                        tag = stack[k].tag
                        if tag == "p":
                            del stack[k:]
                            break
                        if tag not in INLINE:
                            break
                if name in CLOSES:
                    own, end = CLOSES[name]
                    first = None
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k].tag in own:
                            first = k
                        elif stack[k].tag in end:
                            break
                    if first is not None:
                        del stack[first:]
            above = stack[-1] if stack else None
            if not rest or rest.isspace():
                attributes, key = NONE, name
            else:
                attributes = {k.lower(): (v[1:-1] if v[:1] in ("'", '"') else v) for k, v in ATTRIBUTE.findall(rest)}
                key = f"{name}.{attributes.get('class', '')}#{attributes.get('id', '')}@{attributes.get('role', '')}"
            if name in CONTAINERS:
                number = above.number if above else numbers
                number[key] = number.get(key, 0) + 1
                key = f"{key}[{number[key]}]"
            element = Element(name, self.token(above.token if above else 0, key), above, attributes)
            if not inline:
                out.append(element)
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = n if end is None else end.end()
            elif name not in VOID:  # a slash ends no HTML element
                stack.append(element)
        if text:
            close_block()
        return out


def own_text(block: Block, marked: bool = False) -> bool:
    """Whether a block may be article text; ``marked``: also under a class or id word."""
    e = block.around[-1] if block.around else None
    return e is None or not (e.off or (e.marked and not marked) or (e.item and block.linked))


def weigh(parts: list[Element | Block], marked: bool = False) -> dict[int, list]:
    """{token: [depth, is an article, code points, code points of headings, blocks]} of the page (token 0) and its containers that occur once."""
    times = Counter(p.token for p in parts if isinstance(p, Element) and p.tag in CONTAINERS)
    out = {p.token: [p.depth, p.tag == "article", 0, 0, 0] for p in parts if isinstance(p, Element) and times[p.token] == 1}
    page = out[0] = [0, False, 0, 0, 0]
    for b in parts:
        if isinstance(b, Block) and own_text(b, marked):
            n = len(b.text)
            head = n if b.around and b.around[-1].heading else 0
            for had in (page, *(out[e.token] for e in b.around if e.token in out)):
                had[2] += n
                had[3] += head
                had[4] += 1
    return out


def main_element(weights: dict[int, list]) -> int | None:
    """The outermost article with half of the text and headings, else the deepest element that also has more than half of
    the blocks; none if only the whole page has."""
    _, _, most, heads, blocks = weights.get(0, [0] * 5)
    fit = sorted((w[0], t) for t, w in weights.items() if w[2] and 2 * w[2] >= most and 2 * w[3] >= heads and (w[1] or 2 * w[4] > blocks))
    articles = [t for _, t in fit if weights[t][1]]
    return (articles[0] if articles else fit[-1][1] if fit else 0) or None


def host_of(url: Column) -> Column:
    """Lower-case host of a url, empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(host_of(F.col(url_col))).alias("host"),
                     whole_text(html_col).alias("html"))


def tokenised(pages: DataFrame) -> DataFrame:
    """(host, page, tokens, markup, weighed): a stored row a page: its hash, its tokens, which of them are elements, and
    five numbers for each container (token, depth, negative for an article, code points, those of headings, blocks)."""
    names = ["host", "page", "tokens", "markup", "weighed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        reader = Reader()
        for batch in batches:
            page, tokens, markup, weighed = [], [], [], []
            for html in batch.column(1).to_pylist():
                parts = reader.read(html)
                page.append(xxh3_128_digest(html))
                tokens.append([p.token for p in parts])
                markup.append([isinstance(p, Element) for p in parts])
                weighed.append([x for t, (d, article, n, head, k) in weigh(parts).items() for x in (t, -1 - d if article else d, n, head, k)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(page, pa.binary()), pa.array(tokens, pa.list_(pa.int64())),
                                              pa.array(markup, pa.list_(pa.bool_())), pa.array(weighed, pa.list_(pa.int64()))], names=names)

    rows = pages.select("host", "html").mapInArrow(run, "host long, page binary, tokens array<long>, markup array<boolean>, weighed array<long>")
    return materialize(rows, "tokens")


def token_vectors(tokens: DataFrame) -> DataFrame:
    """(host, token, markup, pages, total, f0..f3): sums over pages."""
    names = ["host", "token", "markup", "pages", "total", "f0", "f1", "f2", "f3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest
        sums: dict[tuple, list[int]] = {}

        def made() -> pa.RecordBatch:
            columns = list(zip(*[(*k, *v) for k, v in sums.items()]))
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for host, page, own, markup in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                counts, seen = Counter(zip(own, map(int, markup))), {}
                for (token, element), n in counts.items():
                    if n not in seen:
                        h = xxh3_128_intdigest(page + str(n).encode())
                        seen[n] = [1, n, h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF, h >> 64 & 0xFFFFFFFF, h >> 96]
                    had = sums.get((host, token, element))
                    if had is None:
                        sums[host, token, element] = seen[n].copy()
                    else:
                        for k, x in enumerate(seen[n]):
                            had[k] += x
                if len(sums) > 200_000:
                    yield made()
        if sums:
            yield made()

    rows = tokens.select("host", "page", "tokens", "markup").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return rows.groupBy("host", "token", "markup").agg(*[F.sum(c).alias(c) for c in names[3:]])


def classes(tokens: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, tokens): a row a host of :func:`tokenised` pages with its frequent tokens as (token, class, size, markup, once)."""
    vector = ["pages", "total", "f0", "f1", "f2", "f3"]
    # a stored table: its size is known before the join is planned, so vectors are not dealt by host where it is small
    sizes = materialize(tokens.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages), "hosts")
    often = token_vectors(tokens).join(sizes, "host").where("2 * pages >= n")
    grouped = (often.groupBy("host", "n", *vector).agg(F.collect_list(F.struct("token", "markup")).alias("own"))
               .withColumn("class", F.xxhash64(*vector)))
    each = grouped.select("host", "class", F.size("own").alias("size"), ((F.col("pages") == F.col("n")) & (F.col("total") == F.col("n"))).alias("once"),
                          F.explode("own").alias("t"))
    return each.groupBy("host").agg(F.collect_list(F.struct(F.col("t.token").alias("token"), "class", "size", (F.col("t.markup") > 0).alias("markup"),
                                                            "once")).alias("tokens"))


def instances(tokens: list[int], class_of: dict[int, tuple[int, int]]) -> tuple[dict[int, tuple], dict[int, int | None], set[int]]:
    """Order and parent of each class in one page, and the classes that break order or nesting there."""
    order: dict[int, tuple] = {}
    parent: dict[int, int | None] = {}
    bad: set[int] = set()
    stack: list[tuple[int, list[int]]] = []
    for token in tokens:
        if token not in class_of:
            continue
        own, size = class_of[token]
        while stack and stack[-1][0] != own and any(c == own for c, _ in stack):
            bad.add(stack.pop()[0])  # it straddles a token of the instance around it
        if not stack or stack[-1][0] != own:
            parent.setdefault(own, stack[-1][0] if stack else None)
            stack.append((own, []))
        held = stack[-1][1]
        if token in held:
            bad.add(own)
            held.clear()
        held.append(token)
        if len(held) == size:
            done = tuple(held)
            if order.setdefault(own, done) != done:
                bad.add(own)
            stack.pop()
    bad.update(c for c, _ in stack)
    return order, parent, bad


def evidence(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(host, kind, a, b, n, m, k): sums over pages. Kinds: 0 a class and its order, 1 a class that is broken, 2 a class and its
    parent (0: none), 3 an element and its depth (negative: an article), with its code points, those of headings, and blocks."""
    names = ["host", "kind", "a", "b", "n", "m", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest
        sums, of_host = defaultdict(lambda: [0, 0, 0]), {}

        def made() -> pa.RecordBatch:
            columns = list(zip(*[(*k, *v) for k, v in sums.items()]))
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for host, own, weighed, frequent in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3)):
                if host not in of_host:
                    if len(of_host) > 500:
                        of_host.clear()
                    rows = frequent.as_py()
                    of_host[host] = ({t["token"]: (t["class"], t["size"]) for t in rows}, {0, *(t["token"] for t in rows if t["once"] and t["markup"])})
                class_of, single = of_host[host]
                order, parent, bad = instances(own, class_of)
                for c, o in order.items():
                    sums[host, 0, c, xxh3_64_intdigest(repr(o)) - (1 << 63)][0] += 1
                for c in bad:
                    sums[host, 1, c, 0][0] += 1
                for c, p in parent.items():
                    sums[host, 2, c, p or 0][0] += 1
                for k in range(0, len(weighed), 5):
                    if weighed[k] in single:
                        had = sums[host, 3, weighed[k], weighed[k + 1]]
                        for j in range(3):
                            had[j] += weighed[k + 2 + j]
                if len(sums) > 200_000:
                    yield made()
        if sums:
            yield made()

    met = tokens.join(known.withColumnRenamed("tokens", "frequent"), "host").select("host", "tokens", "weighed", "frequent")
    return (met.mapInArrow(run, ", ".join(f"{c} long" for c in names))
            .groupBy("host", "kind", "a", "b").agg(*[F.sum(c).alias(c) for c in "nmk"]))


TEMPLATE = T.StructType([T.StructField("host", T.LongType()), T.StructField("main", T.LongType()),
                         T.StructField("texts", T.ArrayType(T.LongType())),
                         T.StructField("classes", T.ArrayType(T.StructType([
                             T.StructField("class", T.LongType()), T.StructField("parent", T.LongType()),
                             T.StructField("tokens", T.ArrayType(T.LongType()))])))])


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, main, texts, classes): a stored row for each host with a template; ``host`` is a hash."""
    tokens = tokenised(pages)
    known = materialize(classes(tokens, min_pages), "classes")

    def run(key: tuple, told: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=TEMPLATE.names)
        of = defaultdict(list)
        for t in own["tokens"].iloc[0]:
            of[t["class"]].append((t["token"], t["markup"]))
        orders = Counter(told.loc[told["kind"] == 0, "a"].tolist())
        bad = set(told.loc[told["kind"] == 1, "a"].tolist())
        above: dict[int, tuple] = {}
        for c, p, n in told.loc[told["kind"] == 2, ["a", "b", "n"]].itertuples(index=False):
            above[c] = max(above.get(c, (0, 0)), (n, p))
        valid = [c for c in of if orders[c] == 1 and c not in bad]
        anchored = [c for c in valid if any(m for _, m in of[c])]
        weights = {t: [d if d >= 0 else -1 - d, d < 0, n, m, k]
                   for t, d, n, m, k in told.loc[told["kind"] == 3, ["a", "b", "n", "m", "k"]].itertuples(index=False)}
        return pd.DataFrame([{"host": key[0], "main": main_element(weights),
                              "texts": sorted(t for c in anchored for t, m in of[c] if not m),
                              "classes": [{"class": c, "parent": above.get(c, (0, 0))[1], "tokens": [t for t, _ in of[c]]} for c in valid]}])

    told = evidence(tokens, known)
    return materialize(told.groupBy("host").cogroup(known.groupBy("host")).applyInPandas(run, TEMPLATE), "templates")


def main_text(parts: list[Element | Block], main: int | None, texts: frozenset[int]) -> str:
    """A page's text: the blocks in its main element that are neither template nor marked as something else."""
    blocks = [p for p in parts if isinstance(p, Block)]
    for marked in (False, True):
        if main is None or not any(e.token == main for b in blocks if own_text(b, marked) for e in b.around):
            main = main_element(weigh(parts, marked))
        inside = [b for b in blocks if own_text(b, marked) and (main is None or any(e.token == main for e in b.around))]
        if inside:
            return "\n\n".join(b.text for b in inside if b.token not in texts) or "\n\n".join(b.text for b in inside)
    return ""


def extract(df: DataFrame, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    spark = df.sparkSession
    prepare(spark)
    pages = _pages(df, id_col, url_col, html_col)
    found = templates(pages, min_pages).select("host", "main", "texts")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(url_col, df.schema[url_col].dataType),
                           T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, of_host = Reader(), {}
        for batch in batches:
            out = []
            for host, page, main, texts in zip(*[batch.column(k) for k in (2, 3, 4, 5)]):
                host = host.as_py()
                if host not in of_host:
                    if len(of_host) > 500:
                        of_host.clear()
                    of_host[host] = main.as_py(), frozenset(texts.as_py() or ())
                out.append(main_text(reader.read(page.as_py()), *of_host[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=schema.names)

    return pages.join(found, "host", "left").select("id", "url", "host", "html", "main", "texts").mapInArrow(run, schema)
