"""Main text of web pages by equivalence classes of template tokens.

Tokens are tags and text segments, told apart by their path of open tags. Over the pages of a host every token has an
occurrence vector (its count on each page, kept as a hash sum, so no page list is gathered); tokens with the same vector
on enough pages are an equivalence class, and classes of two or more tokens, or of tokens that stand on every page, make
the host's template. Classes nest by their paths: what stays between template tags are slots, known by the chain of
template containers that is open there. A page's text is what its slots hold, whatever tag they are in: all of the slot
with the most running text and of those below it, and every other slot that is not links alone, without template text,
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*>|[^<]+|<", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr section article main aside nav header footer blockquote pre "
    "figure figcaption address form fieldset hr body details summary".split()
)
#: Blocks that can hold a slot; paragraphs, titles, lists, quotations and tables are blocks of the slot around them.
CONTAINERS = frozenset("div section article main details".split())
DROPPED = frozenset(
    "head script style noscript template iframe svg canvas object nav header footer aside form button select textarea menu dialog title audio video map".split()
)
NEVER_BY_NAME = frozenset("html body article main h1 h2 h3 h4 h5 h6 p b i em strong a span".split())
#: Words in a tag's class, id or role that tell it apart from the main text.
ROLES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar side menu "
    "nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies respond disqus related recommended share sharing social "
    "newsletter subscribe signup login search searchbox pagination pager popup modal overlay toolbar widget skip".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Segment:
    token: int  # of the text under its path
    chain: tuple[int, ...]  # tokens of the open containers
    block: int
    text: str
    dropped: bool
    article: int  # 2 inside article, 1 inside main, 0 outside
    link: bool


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def parse(page: str) -> tuple[list[int], list[Segment]]:
    """Tokens of the tags in page order, and the text segments; unclosed and crossed tags are put right."""
    tags: list[int] = []
    out: list[Segment] = []
    stack: list[tuple[str, str, int, bool, int, bool]] = []  # name, path, token, dropped, article, link
    block, skip_to = 0, ""
    tokens = _TOKEN.finditer(page)
    pos = 0
    for m in tokens:
        if m.start() < pos:
            continue
        piece = m.group()
        if piece[0] != "<" or piece == "<":
            name, path, token, dropped, article, link = stack[-1] if stack else ("", "", 0, False, 0, False)
            text = entities.unescape(piece)
            if text and not text.isspace():
                out.append(Segment(_hash(path + "\0" + " ".join(text.split())), tuple(x[2] for x in stack if x[0] in CONTAINERS), block, text, dropped, article, link))
            elif out and text:
                out.append(Segment(0, tuple(x[2] for x in stack if x[0] in CONTAINERS), block, " ", dropped, article, link))
            continue
        if piece[1] in "!?":
            continue
        name = _NAME.match(piece).group(1).lower()
        if piece[1] == "/":
            if name in BLOCK or name in DROPPED:
                block += 1
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in BLOCK:
            block += 1
        elif name == "br":
            if out:
                out.append(Segment(0, tuple(x[2] for x in stack if x[0] in CONTAINERS), block, " ", *((stack[-1][3], stack[-1][4], stack[-1][5]) if stack else (False, 0, False))))
        if name in BLOCK and any(x[0] == "p" for x in stack):
            keep = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"))
            if not any(x[0] in ("td", "th", "button", "object") for x in stack[keep:]):
                del stack[keep:]
        for other in CLOSES.get(name, ()):
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in (other, "ul", "ol", "table", "dl", "select")), None)
            if at is not None and stack[at][0] == other:
                del stack[at:]
        attrs = {a.lower(): (x or y or z).lower() for a, x, y, z in _ATTR.findall(piece)}
        words = frozenset(w for k in ("class", "id", "role") for w in _SPLIT.split(attrs.get(k, "")) if w)
        _, path, _, dropped, article, link = stack[-1] if stack else ("", "", 0, False, 0, False)
        path = f"{path}/{name}" + (f".{attrs['class']}" if attrs.get("class") else "")
        token = _hash(path)
        tags.append(token)
        if name in VOID or piece.endswith("/>"):
            continue
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true"
        inside_head = name == "header" and article and not dropped
        bad = (name in DROPPED and not inside_head) or hidden or (name not in NEVER_BY_NAME and not inside_head and bool(words & ROLES))
        level = 2 if name == "article" and not dropped else 1 if name == "main" and not dropped else 0
        stack.append((name, path, token, dropped or bad, max(article, level), link or name == "a"))
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, m.end())
            pos = end.end() if end else len(page)
            stack.pop()
    return tags, out


def page_tokens(page: str) -> dict[int, int]:
    """How often each tag and each text segment occurs on a page."""
    tags, segments = parse(page)
    count: dict[int, int] = {}
    for t in [*tags, *(s.token for s in segments if s.token)]:
        count[t] = count.get(t, 0) + 1
    return count


def main_text(page: str, template: frozenset[int]) -> str:
    """The blocks of the page's slots, in page order.

    A page whose text is for the most part in the template is one of many copies; its text is not taken for template.
    """
    tags, segments = parse(page)
    good = [s for s in segments if not s.dropped]
    own = [s for s in good if s.token not in template]
    if 2 * sum(len(s.text) for s in own if s.token) >= sum(len(s.text) for s in good if s.token):
        good = own
    # A container that the page repeats is a block of the slot around it.
    seen = Counter(tags)
    slot = lambda s: tuple(t for t in s.chain if seen[t] == 1 and (t in template or not template))
    mass: dict[tuple, int] = {}
    level: dict[tuple, int] = {}
    for s in good:
        if s.token:
            mass[slot(s)] = mass.get(slot(s), 0) + (0 if s.link else len(s.text))
            level[slot(s)] = max(level.get(slot(s), 0), s.article)
    main = max(mass, key=lambda c: (mass[c], level[c]), default=())
    if mass.get(main):
        good = [s for s in good if mass.get(slot(s)) or main and slot(s)[: len(main)] == main]
    blocks: dict[int, list[str]] = {}
    for s in good:
        blocks.setdefault(s.block, []).append(s.text)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def templates(pages: DataFrame, least_pages: int = 3, least_share: float = 0.5) -> DataFrame:
    """(host, template): the tokens of each host's valid equivalence classes.

    A token's vector is the sum over pages of a hash of the page times its count. Every token of a template stands on
    half of the host's pages, so a template is no larger than two pages' tokens.
    """

    def count(batches):
        for batch in batches:
            host, token, vector, n = [], [], [], []
            for i, (h, p, page) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                salt = xxhash.xxh64_intdigest(f"{p}\0{page or ''}") >> 24
                for t, c in page_tokens(page or "").items():
                    host.append(h)
                    token.append(t)
                    vector.append(salt * c)
                    n.append(c)
                if i % 64 == 63:
                    yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(token, pa.int64()), pa.array(vector, pa.int64())], names=["host", "token", "vector"])
                    host, token, vector, n = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(token, pa.int64()), pa.array(vector, pa.int64())], names=["host", "token", "vector"])

    found = pages.select("host", "page_id", "html").mapInArrow(count, "host string, token long, vector long")
    tokens = found.groupBy("host", "token").agg(F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.count("*").alias("support")).filter(F.col("support") >= least_pages)
    classes = tokens.groupBy("host", "vector", "support").agg(F.count("*").alias("size"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    enough = (F.col("support") >= least_pages) & (F.col("support") >= F.col("n_pages") * least_share)
    valid = classes.join(sizes, "host").filter(enough & ((F.col("size") >= 2) | (F.col("support") == F.col("n_pages"))))
    return tokens.join(valid.select("host", "vector", "support"), ["host", "vector", "support"]).groupBy("host").agg(F.collect_list("token").alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salts: int = 32) -> DataFrame:
    """One row per input row: page_id, url, text and n_chars (code points); an empty or null page has an empty text.

    Pages without an address or a host share one host of their own. A host of any share of the pages is dealt over
    `salts` tasks when its template comes back to its pages. Null ids and repeated rows stay; only the three columns
    are read, so others can't clash.
    """
    url = F.col(f"`{url_col}`").cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]+)", 1), F.lit("")))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"), host.alias("host"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def press(batches):
        """Pages travel to their host's template compressed."""
        for batch in batches:
            small = [None if x is None else zlib.compress(x.encode("utf-8", "surrogatepass")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary()), batch.column(3)], names=["page_id", "url", "html", "host"])

    found = templates(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    packed = rows.mapInArrow(press, f"page_id {kind}, url string, html binary, host string")
    dealt = packed.withColumn("salt", F.pmod(F.xxhash64("html", "page_id"), F.lit(salts)).cast("int"))
    joined = dealt.join(found, ["host", "salt"], "left").select("page_id", "url", "html", "template")

    def run(batches):
        for batch in batches:
            out = [
                main_text(zlib.decompress(page).decode("utf-8", "surrogatepass"), frozenset(t or ())) if page else ""
                for page, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
