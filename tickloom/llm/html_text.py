"""Main text of web pages: templates by equivalence classes of tokens over each host's pages."""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, quoted, read_table
from .word_hashes import turns

# Names of HTML elements, and words that name parts of a page.
_INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
                    "math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mtable mtr mtd mspace mpadded mphantom mfenced menclose semantics").split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Of the elements whose content isn't text: those that a slash closes or that end with what they stand in, if nothing else ends them.
_EMBEDDED = frozenset("svg select object canvas iframe template annotation annotation-xml".split())
_RAW = frozenset("script style textarea title noscript template iframe svg select object canvas annotation annotation-xml".split())
_CONTAINER = frozenset("article aside body center details dialog div fieldset footer form header html main menu nav section table tbody td tr ul ol dl figure blockquote".split())
_LEFT_OUT = frozenset("aside button dialog footer form head menu nav".split())
_PARTS_LEFT_OUT = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer login menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
_PAGE_HEADS = frozenset("header masthead topbar".split())
_MAIN_PARTS = frozenset("article content entry main post story".split())
_READERS_PARTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words that say where a part is or what it is made of, not what it is about; and words that turn a name round.
_PLACE_WORDS = frozenset("# area bar block bottom box button buttons center col column container content fixed footer group head header holder inner item items left links list main outer overlay page panel "
                         "post posts right row section side site sticky title top widget wrap wrapper".split())
_TURNED = frozenset("has hide is no not show with without".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+|))*+)(?:>|\Z)""", re.S)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Bytes of templates that are sent to every task.
BROADCAST_BYTES = 8 << 20
_DIGITS = re.compile(r"\d+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


class Box:
    """A container element: what names it, and where it stands. reason: why it might be left out: 2 for what it is, 1 for what
    it is called, or as a form; 0 for none."""

    __slots__ = ("tag", "path", "reason", "head", "readers", "out", "rank", "chars", "up")

    def __init__(self, tag: str, path: str, reason: int, head: bool, readers: bool, rank: int, up: Box | None):
        self.tag, self.path, self.reason, self.head, self.readers, self.rank, self.up, self.out, self.chars = tag, path, reason, head, readers, rank, up, False, 0


def called(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id calls its element one of the words: by its last part, or by its first with nothing but
    places after it. "no-sidebar" and "social-history" don't."""
    parts = [w for w in re.split(r"[-_]+", name) if w]
    if not parts or parts[0] in _TURNED:
        return False
    if len(parts) > 1 and not _TURNED.isdisjoint(parts):
        return False
    return parts[-1] in words or (parts[0] in words and all(w in _PLACE_WORDS or w in words for w in parts[1:]))


def _box(tag: str, attrs: str, up: Box | None) -> Box:
    named = {}
    for k, a, b, c in _ATTR.findall(attrs) if attrs else ():
        named.setdefault(k.lower(), a or b or c)
    label = _DIGITS.sub("#", f"{named.get('class', '')} {named.get('id', '')}".lower()).split()
    parts = {w for x in label for w in re.split(r"[-_]", x)}
    role = named.get("role", "").lower()
    rank = 4 if tag == "article" or named.get("itemprop", "").lower() == "articlebody" else 3 if tag == "main" or role == "main" else 2 if parts & _MAIN_PARTS else 1
    readers = any(called(x, _READERS_PARTS) for x in label)
    reason = 0
    if (tag in _LEFT_OUT and tag != "form") or "hidden" in named or ("style" in named and _HIDES.search(named["style"])) or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog"):
        reason = 2
    elif tag not in ("html", "body", "main") and (readers or tag == "form" or role == "form" or (not (tag == "article" and parts & _MAIN_PARTS) and any(called(x, _PARTS_LEFT_OUT) for x in label))):
        reason = 1
    head = tag == "header" or any(called(x, _PAGE_HEADS) for x in label)
    return Box(tag, (up.path if up else "") + "/" + ".".join([tag, *label]), reason, head, readers, rank, up)


def _judge(boxes: list[Box]) -> None:
    """Say which boxes are left out: what is, or is called, another part of the page, and what stands in it. Around the page's main
    elements (or its largest article that no readers wrote) names and forms don't count, nor do they where a form holds
    most of the page; page headers count outside articles only."""
    mains = [b for b in boxes if b.rank == 3]
    articles = [b for b in boxes if b.rank == 4 and not b.readers]
    mains += [max(articles, key=lambda b: (not b.reason, b.chars))] if articles else []
    whole = max((b.chars for b in boxes), default=0)
    held = set()
    for b in mains:
        up = b.up
        while up is not None and id(up) not in held:
            held.add(id(up))
            up = up.up
    inside: dict[int, bool] = {}
    for b in boxes:  # a box comes after the one that it stands in
        inside[id(b)] = b.rank >= 3 or (b.up is not None and inside[id(b.up)])
        weak = id(b) in held or (b.tag == "form" and 2 * b.chars > whole)
        b.out = (b.up is not None and b.up.out) or b.reason == 2 or (b.reason == 1 and not weak) or (b.head and not weak and not inside[id(b)])
    for b in boxes:
        if b.out:
            b.rank = 0


def parse(source: str) -> tuple[list[tuple[str, Box | None]], list[tuple[str, Box | None, int]]]:
    """A page's blocks of text, each with the container it stands in, in order; and its tokens: tags of containers
    (path with "<" or ">") and blocks (None and the text), each with its container and place.

    Scripts, styles, markup and comments go; character references are decoded; white space becomes one space. Blocks that
    aren't containers, such as paragraphs, go if they are hidden or called a part that is left out. An
    element that is never closed ends where its parent does, which makes its end a token too; an end tag without a
    start is ignored.
    """
    blocks: list[tuple[str, Box | None]] = []
    tokens: list[tuple[str, Box | None, int]] = []
    stack: list[Box] = []
    boxes: list[Box] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text and not muted:
                box = stack[-1] if stack else None
                blocks.append((text, box))
                tokens.append(("=" + text, box, len(tokens)))
                for b in stack:
                    b.chars += len(text)

    at, size, muted = 0, len(source), False
    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            held.append(source[at:])
            break
        held.append(source[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            held.append(html.escape(m["cdata"], quote=False))
        if not m["name"]:
            continue
        tag, ends = m["name"].lower(), bool(m["end"])
        if tag in _INLINE:
            if tag == "br":
                held.append(" ")
            continue
        if tag == "title" or tag not in _RAW:
            flush()
            muted = False
        if tag in _RAW and not ends:
            if tag in _EMBEDDED and m["attrs"].rstrip().endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if close is None and tag in _EMBEDDED:
                close = re.compile(rf"(?=</{re.escape(stack[-1].tag)}\s*>)", re.I).search(source, at) if stack else None
                at = close.end() if close else at
            else:
                at = close.end() if close else size
        elif tag in _CONTAINER or tag in _LEFT_OUT:
            if not ends:
                if tag not in _VOID and not m["attrs"].rstrip().endswith("/"):
                    box = _box(tag, m["attrs"], stack[-1] if stack else None)
                    stack.append(box)
                    boxes.append(box)
                    tokens.append(("<", box, len(tokens)))
            elif any(b.tag == tag for b in stack):
                while stack:
                    box = stack.pop()
                    tokens.append((">", box, len(tokens)))
                    if box.tag == tag:
                        break
        elif not ends and m["attrs"]:
            muted = _box(tag, m["attrs"], None).reason > 0
    flush()
    while stack:
        tokens.append((">", stack.pop(), len(tokens)))
    _judge(boxes)
    return blocks, tokens


def _name(token: str, box: Box | None) -> int:
    raw = f"{box.path if box else ''}\x00{token}".encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True)


def root_of(boxes: list[tuple[str, int, float]]) -> str | None:
    """The path of the container that holds the main text, of (path, rank, characters): the best named (article
    element, main element, a name such as "content"); else the deepest with three fifths of the text."""
    named = [b for b in boxes if b[1] >= 2 and b[2]]
    if named:
        best = max(b[1] for b in named)
        return max((b for b in named if b[1] == best), key=lambda b: (b[2], -len(b[0])))[0]
    plain = [b for b in boxes if b[1] == 1]
    most = max((b[2] for b in plain), default=0)
    deep = [b for b in plain if b[2] >= 0.6 * most and b[2]]
    return max(deep, key=lambda b: b[0].count("/"))[0] if deep else None


def _boxes(tokens: list[tuple[str, Box | None, int]]) -> list[tuple[str, int, int]]:
    total: dict[str, list[int]] = {}
    for token, box, _ in tokens:
        if token == "<":
            total.setdefault(box.path, [box.rank, 0])[1] += box.chars
    return [(p, r, c) for p, (r, c) in total.items()]


def main_text(source: str | None, roots: Sequence[str] = (), fixed: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given its template: the main containers' paths, one for each layout, and fixed blocks.

    What is left in the first of the main containers that the page has once its fixed blocks and the parts left out
    (menus, page headers, footers, ...) are gone. A page without any of them is judged alone.
    """
    if not source:
        return ""
    blocks, tokens = parse(source)
    kept = [(t, b) for t, b in blocks if not (b and b.out)]
    for path in (*roots, root_of(_boxes(tokens))):
        if path:
            inside = [(t, b) for t, b in kept if b and (b.path == path or b.path.startswith(path + "/"))]
            if inside:
                kept = inside
                break
    return "\n".join(t for t, b in kept if not fixed or _name("=" + t, b) not in fixed)


def token_counts(pages: DataFrame) -> DataFrame:
    """(host, token, kind, path, rank, inside, n_pages, vector, place, chars) of packed pages(host, html).

    vector stands for the token's occurrence vector over the host's pages: the exclusive or of a hash of (page,
    occurrences) of each. It combines in any order, so the counts are made in each task first. inside is the start tag
    of the container that a block or an end tag belongs to, and of the container around a start tag.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 1):
                found: dict[tuple[str, int], list] = {}
                for host, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    _, tokens = parse(zlib.decompress(packed).decode("utf-8", "surrogatepass"))
                    page = blake2b(packed, digest_size=16).digest()
                    here: dict[int, list] = {}
                    for token, box, place in tokens:
                        own = here.setdefault(_name(token, box), [token[0], box, 0, place, 0])
                        own[2] += 1
                        own[4] += box.chars if token == "<" else len(token) - 1
                    for name, (kind, box, n, place, chars) in here.items():
                        mark = int.from_bytes(blake2b(page + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
                        up = box.up if box and kind == "<" else box
                        row = found.setdefault((host, name), [kind, box.path if box and kind == "<" else "", box.rank if box else 0, _name("<", up) if up else 0, 0, 0, 0.0, 0])
                        row[4] += 1
                        row[5] ^= mark
                        row[6] += place
                        row[7] += chars
                    found.setdefault((host, 0), ["*", "", 0, 0, 0, 0, 0.0, 0])[4] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*((h, n, *r) for (h, n), r in found.items()), strict=True), _KINDS, strict=True)], names=_NAMES
                )

    made = pages.select("host", "html").mapInArrow(run, "host string, token long, kind string, path string, rank int, inside long, n_pages long, vector long, place double, chars long")
    return made.groupBy("host", "token").agg(
        F.min("kind").alias("kind"), F.max("path").alias("path"), F.max("rank").alias("rank"), F.max("inside").alias("inside"), F.sum("n_pages").alias("n_pages"), F.bit_xor("vector").alias("vector"),
        F.sum("place").alias("place"), F.sum("chars").alias("chars"),
    )


def packed(pages: DataFrame) -> DataFrame:
    """pages(host, html) that have html, compressed: equal ones stay equal, and shuffling them takes less disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 1):
                made = [zlib.compress(x.encode("utf-8", "surrogatepass"), 3) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["host", "html"])

    return pages.select("host", "html").where("html <> ''").mapInArrow(run, "host string, html binary")


_NAMES = ["host", "token", "kind", "path", "rank", "inside", "n_pages", "vector", "place", "chars"]
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]


def nested(tokens: list[dict]) -> list[dict]:
    """What nests of an equivalence class, in the order of mean places: an end tag closes its start tag, and takes those
    opened since and not closed with it; tags without their other half go, and so do blocks outside their container."""
    own = sorted(tokens, key=lambda t: (t["place"] / t["n_pages"], t["kind"] != "<"))
    starts = {t["token"] for t in own if t["kind"] == "<"}
    opened: list[int] = []
    paired, blocks = set(), []
    for t in own:
        if t["kind"] == "<":
            opened.append(t["token"])
        elif t["kind"] == ">":
            if t["inside"] in opened:
                while opened.pop() != t["inside"]:
                    pass
                paired.add(t["inside"])
        elif t["inside"] not in starts or t["inside"] in opened:
            blocks.append(t)
    return [t for t in own if t["kind"] == "<" and t["token"] in paired] + [t for t in blocks if t["inside"] not in starts or t["inside"] in paired]


def deduce(n_pages: int, tokens: list[dict], *, share: float, layout_share: float, fixed_share: float, fixed_pages: int, slot_share: float) -> tuple[list[str], list[int]]:
    """(main containers' paths, fixed blocks) of a host's template.

    Tokens with one occurrence vector are an equivalence class; what doesn't nest in it is dropped (nested()). Classes
    nest by their containers: one whose container around it was dropped, or is of fewer pages, is dropped too. The rest is
    the template. Each layout has its main container in it, chosen by mean characters a page; one that most pages have and
    that is named comes first, then those of layouts. In a main container, blocks that nearly all of many of its own pages
    have are fixed, if its slots, which is what isn't fixed, hold at least slot_share of its text; else what
    repeats is the main text.
    """
    classes = defaultdict(list)
    for t in tokens:
        classes[t["vector"], t["n_pages"]].append(t)
    kept = [t for own in classes.values() for t in nested(own)]
    every = {t["token"]: t for t in kept if t["kind"] == "<"}
    starts: dict[int, dict] = {}
    for t in sorted(every.values(), key=lambda t: t["path"].count("/")):
        if not t["inside"] or (t["inside"] in starts and starts[t["inside"]]["n_pages"] >= t["n_pages"]):
            starts[t["token"]] = t

    def best(of: list[dict]) -> str | None:
        return root_of([(t["path"], t["rank"], t["chars"] / t["n_pages"]) for t in of])

    left = list(starts.values())
    roots: list[str] = []
    path = best([t for t in left if t["n_pages"] >= share * n_pages])
    if not path or max(t["rank"] for t in left if t["path"] == path) < 2:
        path = best(left)
    while path:
        roots.append(path)
        left = [t for t in left if not (path + "/").startswith(t["path"] + "/") and not t["path"].startswith(path + "/")]
        path = best(left)
    found: dict[int, list[dict]] = defaultdict(list)
    main = {t["token"]: t for t in starts.values() if t["path"] in set(roots)}
    for t in kept:
        at = t["inside"] if t["kind"] == "=" else 0
        while at in starts and at not in main:
            at = starts[at]["inside"]
        if at in main and t["n_pages"] >= fixed_pages and t["n_pages"] >= fixed_share * main[at]["n_pages"]:
            found[at].append(t)
    fixed = [t["token"] for at, own in found.items() if sum(t["chars"] for t in own) <= (1 - slot_share) * main[at]["chars"] for t in own]
    return roots, fixed


def templates(pages: DataFrame, *, share: float = 0.5, layout_share: float = 0.1, fixed_share: float = 0.9, fixed_pages: int = 3, slot_share: float = 0.2) -> DataFrame:
    """(host, roots, fixed) for each host of pages(host, html); fixed is int64 bytes.

    Equal pages of a host count once. A host's tokens that at least `layout_share` of its pages have go to one row: no
    more than the mean number of tokens of a page divided by it, however many pages there are.
    """
    counts = cut(token_counts(packed(pages).dropDuplicates()))
    hosts = counts.where(F.col("token") == 0).select("host", F.col("n_pages").alias("pages"))
    # joined by a hash, so that the join's partitioning doesn't serve the grouping: a large host's tokens can be split, and
    # only its frequent ones are dealt out by host
    known = hosts.select(F.xxhash64("host").alias("key"), F.col("host").alias("same"), "pages")
    often = counts.where(F.col("token") != 0).withColumn("key", F.xxhash64("host")).join(known, "key").where((F.col("host") == F.col("same")) & (F.col("n_pages") >= layout_share * F.col("pages")))
    listed = often.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list(F.struct("token", "kind", "path", "rank", "inside", "n_pages", "vector", "place", "chars")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, made = batch.column(0).to_pylist(), []
            for n, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                made.append(deduce(n, tokens, share=share, layout_share=layout_share, fixed_share=fixed_share, fixed_pages=fixed_pages, slot_share=slot_share))
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "roots": pa.array([r for r, _ in made], pa.list_(pa.string())), "fixed": pa.array([np.array(f, "<i8").tobytes() for _, f in made], pa.binary())})

    return listed.mapInArrow(run, "host string, roots array<string>, fixed binary")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars): the main text of every page, blocks joined by line feeds.

    Each host's template is deduced over all its pages, then its slots are read page by page. Null or empty
    html gives "". A null url, or one without a host, is of the host "". A host's equal pages count once in its template
    (one shuffle of pages, after each task's own copies went). Under three different pages, none of a host's blocks are fixed.
    A host may hold most pages: its counts combine before the shuffle. Templates of up to BROADCAST_BYTES in all,
    which is looked at first, go to the pages, and these aren't shuffled again; else pages and templates are
    joined by a shuffle, in which a host's pages can be split. Other columns don't matter.
    """
    url = quoted(url_col)
    host = F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))
    base = pages.select(quoted(id_col).alias("page"), url.alias("url"), host.alias("host"), quoted(html_col).alias("html"))
    made = cut(templates(base))
    size = made.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("roots", " ")) + F.octet_length("fixed"))).first()[0] or 0
    both = base.join(F.broadcast(made) if size <= BROADCAST_BYTES else made, "host", "left").select("page", "url", "html", "roots", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 2):
                roots, packed = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                known = {raw: frozenset(np.frombuffer(raw or b"", "<i8").tolist()) for raw in set(packed)}
                texts = [main_text(h, r or (), known[f]) for h, r, f in zip(batch.column(2).to_pylist(), roots, packed, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    return both.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
