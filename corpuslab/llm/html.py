"""Main text of web pages by template deduction: tokens that occur alike on the pages of a host make its template."""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .urls import host_of

#: Pages of a host that are looked at together; a host with more pages has several blocks of about this size.
BLOCK = 64
#: A token belongs to the template's frame if it occurs exactly once on so large a share of a block's pages.
SUPPORT = 0.6
#: A text that so large a share of a block's pages (of three at least) have in the same place is the template's.
CONSTANT = 0.6
#: Share of a slot's characters in links from which it is a menu.
LINKED = 0.5

PIECE = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(script|style|noscript|textarea|template|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|$)|</?[a-zA-Z][^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>|</?[a-zA-Z][^>]*>|<[^<]*|[^<]+", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"\shidden(?=[\s>=/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
# Elements that hold others and give a token its path, elements that end a line of text, elements whose
# content is never text of the page, those whose content is never the article's, those without an end, and words in
# class, id or role names that tell the same.
CONTAINERS = frozenset("html head body div section article main aside nav header footer form ul ol dl table blockquote figure fieldset dialog menu".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre address figcaption hr br legend option select label summary details".split())
DROPPED = frozenset("script style noscript textarea template svg iframe title head select button object canvas".split())
ASIDE = frozenset("nav header footer aside form dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contact cookie
cookies copyright disqus footer header login masthead menu menubar nav navbar navigation newsletter notice notices notification
pagination pager popup promo promoted promotion related recommended replies reply respond responses share sharing sidebar signup skip
social sponsor sponsored subscribe subscription toolbar topbar widget alert search discussion complementary contentinfo""".split())
SPACE = re.compile(r"[\s\x1c-\x1f]+")


@dataclass
class Token:
    """A tag with its path, or a run of text; ``path`` holds the open containers and ``chain`` their numbers on the page,
    ``aside`` tells whether one is not the article's."""

    key: str
    text: str = ""
    path: tuple[str, ...] = ()
    chain: tuple[int, ...] = ()
    aside: bool = False
    linked: bool = False
    breaks: bool = False


@dataclass
class Page:
    tokens: list[Token] = field(default_factory=list)
    place: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))


def _side(tag: str, raw: str) -> bool:
    if tag in ASIDE or HIDDEN.search(raw):
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    return any(w in ASIDE_NAMES for m in NAMED.finditer(raw) for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", m[1]).lower()))


def tokenise(source: str) -> Page:
    """Tags and runs of text in page order. Markup may be cut off, unclosed or wrongly nested."""
    page = Page()
    open_: list[tuple[str, str, bool, int]] = []  # containers: tag, name in paths, whether it or one around is aside, number
    links = 0

    def add(token: Token) -> None:
        page.place[token.key].append(len(page.tokens))
        page.tokens.append(token)

    for m in PIECE.finditer(source):
        raw = m[0]
        path, aside, chain = tuple(x[1] for x in open_), bool(open_) and open_[-1][2], tuple(x[3] for x in open_)
        tag = TAG.match(raw) if raw[0] == "<" else None
        if raw[0] != "<" or (not tag and not raw.startswith(("<!", "<?"))):
            add(Token("text", raw, path, chain, aside, links > 0))
            continue
        if not tag:
            continue
        closing, name = tag[1], tag[2].lower()
        if not raw.endswith(">"):  # cut off within a tag, or a sign that opens none
            continue
        if m[1]:
            add(Token(f"{'/'.join(path)}<{name}>", "", path, chain, aside))
            continue
        if name == "a":
            links = 0 if closing else 1
        if name not in CONTAINERS and name not in DROPPED:
            add(Token(f"{'/'.join(path)}<{closing}{name}>", "", path, chain, aside, breaks=name in BLOCKS))
            continue
        if closing:
            if any(x[0] == name for x in open_):
                while open_.pop()[0] != name:
                    pass
            add(Token(f"{'/'.join(x[1] for x in open_)}</{name}>", "", path, chain, aside, breaks=True))
            continue
        names = " ".join(sorted(x[1].strip("\"' ") for x in NAMED.finditer(raw)))
        add(Token(f"{'/'.join(path)}<{name} {names}>", "", path, chain, aside, breaks=True))
        if not raw.endswith("/>") and name not in VOID:
            inside = aside or _side(name, raw) or name in DROPPED
            if name in ("article", "main") and not any(x[0] in ("aside", "form", "dialog") or x[2] and x[0] == "div" for x in open_):
                inside = False  # a page's own part, whatever is around it
            open_.append((name, name + (f".{names}" if names else ""), inside, len(page.tokens)))
    return page


def frame(pages: list[Page]) -> list[str]:
    """The template's outermost class: keys whose occurrence vector is 1 on enough pages, in the one order they all keep.

    Equivalence classes are groups of keys with one occurrence vector over the block's pages. Those whose vectors hold
    only 0 and 1 and are 1 on enough pages are merged into the frame as far as they are ordered: a key that comes before
    another on one page and behind it on another makes the class invalid, and the key with less support is left out.
    """
    vectors: dict[tuple[int, ...], list[str]] = defaultdict(list)
    for key in {k for p in pages for k in p.place if k != "text"}:
        vectors[tuple(len(p.place.get(key, ())) for p in pages)].append(key)
    least = max(1, SUPPORT * len(pages))
    classes = sorted(((sum(v), ks) for v, ks in vectors.items() if max(v) == 1 and sum(v) >= least), key=lambda x: (-x[0], min(x[1])))
    out: list[str] = []
    for _, keys in classes:
        for key in sorted(keys, key=lambda k: (next(p.place[k][0] for p in pages if k in p.place), k)):
            at = _slot(out, key, pages)
            if at >= 0:
                out.insert(at, key)
    return out


def _slot(out: list[str], key: str, pages: list[Page]) -> int:
    """Where ``key`` nests among the frame's keys on every page alike; -1 if pages disagree."""
    low, high = 0, len(out)
    for p in pages:
        if key not in p.place:
            continue
        at = p.place[key][0]
        for k, other in enumerate(out):
            if other in p.place:
                if p.place[other][0] < at:
                    low = max(low, k + 1)
                else:
                    high = min(high, k)
    return low if low <= high else -1


def slots(page: Page, keys: list[str]) -> list[int]:
    """For each token, the frame key (by number, from 1) that it follows; 0 before the first."""
    number = {k: i for i, k in enumerate(keys, 1)}
    out, now = [], 0
    for t in page.tokens:
        now = max(now, number.get(t.key, 0))
        out.append(now)
    return out


def nested(pages: list[Page], keys: list[str]) -> list[list[int]]:
    """For each token of each page the number of its innermost slot.

    What lies in one slot of the frame is looked at anew: keys that end lines and occur once there on enough pages cut it
    into the slots of an inner class; if there are none, one that comes again and again cuts it into records, which then
    count as pages of their own. So it goes on while at least three stretches are alike.
    """
    out = [slots(p, keys) for p in pages]
    todo: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for i, of in enumerate(out):
        at = 0
        for k in range(1, len(of) + 1):
            if k == len(of) or of[k] != of[at]:
                todo[of[at]].append((i, at, k))
                at = k
    groups, last = list(todo.values()), len(keys)
    while groups:
        spans = groups.pop()
        if len(spans) < 3:
            continue
        parts = []
        for i, low, high in spans:
            part = Page()
            for k in range(low, high):
                t = pages[i].tokens[k]
                if t.breaks and not t.aside:
                    part.place[t.key].append(k)
            parts.append(part)
        inner = frame(parts)
        number = {k: n for n, k in enumerate(inner, 1)}
        if not inner:
            support = Counter(k for p in parts for k in p.place)
            again = [k for k, n in support.items() if n >= SUPPORT * len(parts) and sum(len(p.place[k]) for p in parts if k in p.place) > n]
            if not again:
                continue
            number = {min(again, key=lambda k: (-support[k], min(p.place[k][0] for p in parts if k in p.place), k)): 1}
        cut: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, low, high in spans:
            at, now = low, 0
            for k in range(low, high):
                n = number.get(pages[i].tokens[k].key, 0)
                if n and (n > now or not inner):
                    cut[now].append((i, at, k))
                    at, now = k + 1, n
            cut[now].append((i, at, high))
        for group in cut.values():
            last += 1
            for i, low, high in group:
                out[i][low:high] = [last] * (high - low)
            groups.append([x for x in group if x[2] > x[1]])
    return out


def clean(raw: str) -> str:
    return SPACE.sub(" ", references.unescape(raw.replace("\0", " "))).strip()


@dataclass
class Block:
    """A line of text: the innermost and the outermost slot and the containers that it is in, and how much of it is in links."""

    slot: int
    outer: int
    text: str
    path: tuple[str, ...]
    chain: tuple[int, ...]
    linked: float


def blocks(page: Page, within: list[int], outer: list[int]) -> list[Block]:
    """The lines outside containers that are not the article's. Containers end a line, so that a line is in one slot."""
    out: list[Block] = []
    run: list[tuple[Token, int, int]] = []
    for t, s, o in [*zip(page.tokens, within, outer, strict=True), (Token("", breaks=True), 0, 0)]:
        if t.key == "text":
            if not t.aside:
                run.append((t, s, o))
        elif t.breaks:
            if text := clean("".join(x.text for x, _, _ in run)):
                first = run[0]
                out.append(Block(first[1], first[2], text, first[0].path, first[0].chain, sum(len(x.text) for x, _, _ in run if x.linked) / sum(len(x.text) for x, _, _ in run)))
            run = []
    return out


def extract(sources: list[str]) -> list[str]:
    """The main text of each page of a block.

    Tags and names are hints: they leave asides out beforehand, and where article or main parts hold most of the text
    that pages of the same layout have left, all lines in them are the page's text, however many pages its host has.
    Elsewhere, where the outermost containers of all pages are equal in number, they are the layout's columns. The
    frame's slot with the most text, over all pages of the block, is the article's, and the column that holds most of a
    page's text there is taken whole. Without columns or a frame (a block of two pages, pages without anything in
    common) all lines left are taken.

    What the template shows to be its own goes: lines that most pages (inside an article or main part: all, of three at
    least) have in the same slot, and slots that are mostly links. Pages that would lose most of an article's text so are
    near copies of each other and keep it.

    Copies, which say nothing of what is a host's, count as one page: pages with the same tags and the same text outside
    containers that are not the article's, whatever their links and asides.
    """
    read = [tokenise(s) for s in sources]
    alike = [signature(p) for p in read]
    distinct = dict(zip(reversed(alike), reversed(read), strict=True))
    texts = dict(zip(distinct, _extract(list(distinct.values())), strict=True))
    return [texts[x] for x in alike]


def signature(page: Page) -> bytes:
    """The same for copies of a page."""
    found = hashlib.md5(usedforsecurity=False)
    for t in page.tokens:
        found.update(f"{t.key}\0{'' if t.aside else t.text}\0{t.linked:d}\0".encode("utf-8", "surrogatepass"))
    return found.digest()


def _extract(pages: list[Page]) -> list[str]:
    keys = frame(pages)
    lines = [blocks(p, within, slots(p, keys)) for p, within in zip(pages, nested(pages, keys), strict=True)]
    seen = Counter(x for ls in lines for x in {(b.slot, b.text, bool(_tagged(b))) for b in ls})
    # Inside a tagged part a line that not all pages share is still text.
    constant = {x for x, n in seen.items() if len(pages) >= 3 and n >= (1 if x[2] else CONSTANT) * len(pages)}
    chars: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    rows: Counter[int] = Counter()
    for b in (b for ls in lines for b in ls):
        chars[b.slot] += len(b.text)
        linked[b.slot] += len(b.text) * b.linked
        rows[b.slot] += 1
    menus = {s for s, n in chars.items() if linked[s] > LINKED * n}
    held = Counter(s for ls in lines for s in {b.slot for b in ls})
    # Inside a tagged part one linked line is a headline; a menu has several, on pages enough to tell.
    lists = {s for s in menus if len(pages) >= 3 and rows[s] >= 2 * held[s]}
    left = []
    for ls in lines:
        tagged = [b for b in ls if _tagged(b)]
        own = {id(b) for b in tagged if (b.slot, b.text, True) in constant}
        copied = 2 * sum(len(b.text) for b in tagged if id(b) in own) > sum(len(b.text) for b in tagged)
        foreign = lambda b, own=own, copied=copied: (id(b) in own and not copied) or b.slot in lists if _tagged(b) else (b.slot, b.text, False) in constant or b.slot in menus
        left.append([b for b in ls if not foreign(b)])
    inside: Counter[tuple] = Counter()
    whole: Counter[tuple] = Counter()
    layouts = [tuple(sorted({x for b in ls if (x := _tagged(b))})) for ls in lines]
    for layout, ls in zip(layouts, left, strict=True):
        inside[layout] += sum(len(b.text) for b in ls if _tagged(b))
        whole[layout] += sum(len(b.text) for b in ls)
    by_tags = [bool(x) and 2 * inside[x] >= whole[x] for x in layouts]
    main = _main_slot(left) if len(pages) >= 3 and keys else None
    columns = [_columns(p) for p in pages]
    fixed = len({len(c) for c in columns}) == 1
    out = []
    for tags, ls, column in zip(by_tags, left, columns, strict=True):
        there = [b for b in ls if b.outer == main]
        if tags or not there or not fixed:
            out.append(_main(ls, tags))
            continue
        chars = Counter()
        for b in there:
            chars[next((b.chain[:n] for n in range(len(b.chain) + 1) if b.chain[:n] in column), ())] += len(b.text)
        best = max(chars, key=lambda c: (chars[c], [-x for x in c]))
        out.append("\n".join(b.text for b in ls if b.chain[: len(best)] == best))
    return out


def _main_slot(left: list[list[Block]]) -> int | None:
    """The frame's slot that holds the most text which is neither the template's nor a menu's, over all pages of the block."""
    chars: Counter[int] = Counter()
    for b in (b for ls in left for b in ls):
        chars[b.outer] += len(b.text)
    return max(chars, key=lambda s: (chars[s], -s), default=None)


def _columns(page: Page) -> set[tuple[int, ...]]:
    """The outermost containers of a page that stand side by side."""
    chains = {t.chain for t in page.tokens if t.key == "text" and t.text.strip() and not any(x.split(".")[0] == "head" for x in t.path)}
    size = 0
    while True:
        found = {c[: size + 1] for c in chains}
        if len(found) > 1 or not found or any(len(c) <= size for c in chains):
            return {c for c in found if len(c) == size + 1}
        size += 1


def _tagged(line: Block) -> tuple[str, ...]:
    """The containers down to the outermost article or main part around a line; none if there is none."""
    return next((line.path[: k + 1] for k, x in enumerate(line.path) if x.split(".")[0] in ("article", "main")), ())


def _main(left: list[Block], by_tags: bool) -> str:
    for wanted in ("article", "main") if by_tags else ():
        found = [b.text for b in left if any(x.split(".")[0] == wanted for x in b.path)]
        if found and 2 * sum(map(len, found)) >= sum(len(b.text) for b in left if _tagged(b)):
            return "\n".join(found)
    return "\n".join(b.text for b in left if not by_tags or _tagged(b) or not any(map(_tagged, left)))


def extract_main_text(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", block: int = BLOCK) -> DataFrame:
    """``df`` with ``text`` and ``n_chars`` (code points) in the place of ``html``.

    Pages are dealt into blocks of one host by a hash of the page, so that a host with a third of all pages has many
    blocks; hosts with fewer than three pages share blocks. A block's template is deduced from its own pages, so no
    task holds more than some blocks, and the html is shuffled once. Null or empty html gives an empty text, as do
    pages without an article's text. Repeated rows and null ids or urls are pages like others. No rows give no rows.
    Input columns named text or n_chars are replaced.

    The pages of each host are counted first; counts are broadcast while hosts are at most 100,000, else joined.
    """
    own = [c for c in df.columns if c not in ("text", "n_chars", html)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{html}`").alias("html"), host_of(F.col(f"`{url}`")).alias("host"), F.xxhash64(F.col(f"`{page_id}`"), F.col(f"`{url}`")).alias("dealt"))
    hosts = df.select(host_of(F.col(f"`{url}`")).alias("host")).groupBy("host").agg(F.count("*").alias("n"))
    few = hosts.count() <= 100_000
    alone = F.col("n") < 3
    total = max(1, hosts.where(alone).count() // block)
    hosts = hosts.select("host", F.when(alone, "").otherwise(F.col("host")).alias("name"), F.when(alone, F.lit(total)).otherwise(F.ceil(F.col("n") / block)).alias("parts"))
    joined = rows.join(F.broadcast(hosts) if few else hosts, "host")
    keyed = joined.select("row", "html", "name", F.pmod("dealt", "parts").alias("part"))
    schema = df.select(*[f"`{c}`" for c in own]).schema
    names = [f.name for f in schema]
    result = "row " + schema.simpleString() + ", text string, n_chars long"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        sources = pdf["html"].fillna("").tolist()
        # By their content, so that the result does not hang on how the rows came; repeated rows share a hash and so a
        # part, where copies are left out before it is cut.
        found = dict.fromkeys(sorted(set(sources)))
        groups: dict[bytes | str, list[str]] = defaultdict(list)
        for source in found:
            groups[signature(tokenise(source)) if len(found) > 2 * block else source].append(source)
        first = [g[0] for g in groups.values()]
        for at in range(0, len(first), 2 * block):
            part = first[at : at + 2 * block]
            for source, t in zip(part, extract(part), strict=True):
                found[source] = t
        for g in groups.values():
            found |= dict.fromkeys(g, found[g[0]])
        texts = [found[source] for source in sources]
        return pd.DataFrame({"row": pdf["row"], "text": texts, "n_chars": [len(t) for t in texts]})

    found = keyed.groupBy("name", "part").applyInPandas(work, result)
    return found.select(*[F.col("row").getField(n).alias(n) for n in names], "text", "n_chars")


def op2_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
