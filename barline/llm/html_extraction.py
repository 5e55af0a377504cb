"""Main text of web pages by wrappers induced from pages of one host.

1. The page of the least hash of a host gives its wrapper: the tree of its block elements, neighbours of
   one label merged into one repeated slot.
2. Every page of the host is aligned with it by simple tree matching. A slot that shows the different pages it
   meets few different texts (at most CONSTANT of the pages) is template: menus, notices, adverts that rotate.
   Copies of a page count as one page. Inside article or main elements only a text that a slot shows on nearly
   all pages is template (the pages besides the one that is read are SAME of them), and only where it stands.
   Both are shares of a host's pages, the same for hosts of any size.
3. A page's text is what lies in its article or main elements (in its body, if it has none), without the
   template slots and without what tag, role, class or id mark as menu, header, footer, sidebar, notice,
   advert, form or reader comments.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import kept

CONSTANT, SAME = 0.3, 0.9
ASIDE_TAGS = frozenset("head nav header footer aside form button select menu dialog datalist object applet".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted banner nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice notification alert comment comments commentlist disqus respond reply replies share sharing "
    "social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager toolbar".split()
)
MAIN_TAGS = frozenset(("article", "main"))


def host(url: Column) -> Column:
    """Host of a URL in lower case; empty for null and where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def aside(n: dom.Node, inside: bool) -> bool:
    """Whether a block is marked as something beside the article; inside one, a header belongs to it."""
    if n.tag in ASIDE_TAGS:
        return not (inside and n.tag == "header")
    if n.tag in ("html", "body", "#root"):
        return False
    if n.attrs:
        return bool(ASIDE_WORDS.intersection(n.words("class", "id")) or ASIDE_ROLES.intersection(n.words("role")) or n.has("hidden"))
    return False


def _main(n: dom.Node) -> list[dom.Node]:
    """Outermost article or main elements that aren't aside themselves."""
    found: list[dom.Node] = []
    left = n.blocks[::-1]
    while left:
        b = left.pop()
        if aside(b, False):
            continue
        if b.tag in MAIN_TAGS:
            found.append(b)
        else:
            left += b.blocks[::-1]
    return found


def blocks(page: dom.Node, template: set[int]) -> list[str]:
    """Text blocks in page order; ``template``: identities of nodes to leave out."""
    out: list[str] = []

    def walk(n: dom.Node, inside: bool) -> None:
        open_: list[tuple] = [(iter(n.parts), [])]
        while open_:
            parts, run = open_[-1]
            for p in parts:
                if isinstance(p, str):
                    run.append(p)
                    continue
                dropped = id(p) in template or aside(p, inside)
                if p.tag in ("td", "th") and not dropped and not p.blocks:
                    run += [" ", *(x for x in p.parts if isinstance(x, str)), " "]
                    continue
                out.append("".join(run))
                run.clear()
                if not dropped:
                    open_.append((iter(p.parts), []))
                    break
            else:
                out.append("".join(run))
                open_.pop()

    mains = _main(page)
    for n in mains or [page]:
        if id(n) not in template:
            walk(n, bool(mains))
    return [t for t in (" ".join(b.split()) for b in out) if t]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _skeletons(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([dom.skeleton(dom.parse(h)) for h in b.column("html").to_pylist()], pa.string())], names=["host", "skeleton"])


def _wrappers():
    known: dict[str, dom.Slot] = {}

    def of(text: str) -> dom.Slot:
        if text not in known:
            if len(known) > 1000:
                known.clear()
            known[text] = dom.wrapper(text)
        return known[text]

    return of


def _inside(page: dom.Node) -> set[int]:
    """Identities of the nodes in article or main elements."""
    found, left = set(), _main(page)
    while left:
        n = left.pop()
        found.add(id(n))
        left += n.blocks
    return found


def _text(slot) -> str:
    return " ".join(n.own_text() for n in slot.nodes).strip()


def _observe(batches):
    """(host, slot, hash of the slot's own text in a page, hash of the page's text, whether the slot lies inside)."""
    wrapper = _wrappers()
    for b in batches:
        rows = []
        for name, page, shape in zip(*(b.column(c).to_pylist() for c in ("host", "html", "skeleton"))):
            tree = dom.parse(page)
            whole, inside = _hash("\n".join(blocks(tree, set()))), _inside(tree)
            for number, slot in dom.align(tree, wrapper(shape)).items():
                text = _text(slot)
                if text:
                    rows.append((name, number, _hash(text), whole, any(id(n) in inside for n in slot.nodes)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()))], names=["host", "slot", "text_hash", "page_hash", "inside"])


def _extract(fields: list[str]):
    def run(batches):
        wrapper = _wrappers()
        for b in batches:
            texts = []
            for page, shape, constant, same in zip(*(b.column(c).to_pylist() for c in ("html", "skeleton", "template", "same"))):
                tree, gone = dom.parse(page), set()
                if constant or same:
                    fixed = {(s["slot"], s["text_hash"]) for s in same or ()}
                    for number, slot in dom.align(tree, wrapper(shape)).items():
                        if number in (constant or ()) or fixed and (number, _hash(_text(slot))) in fixed:
                            gone |= {id(n) for n in slot.nodes}
                texts.append("\n\n".join(blocks(tree, gone)))
            yield pa.RecordBatch.from_arrays([*(b.column(f) for f in fields), pa.array(texts, pa.string())], names=[*fields, "text"])

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """host, skeleton, template (numbers of its constant slots), same (slots inside with a text to drop), one row per host. pages: host, html and a column ``h`` to order by."""
    first = pages.groupBy("host").agg(F.min("h").alias("h"))
    reference = pages.join(first, ["host", "h"]).groupBy("host").agg(F.min("html").alias("html"))
    shapes = kept(reference.mapInArrow(_skeletons, "host string, skeleton string"), "skeletons")
    seen = pages.select("host", "html").join(shapes, "host").mapInArrow(_observe, "host string, slot int, text_hash long, page_hash long, inside boolean")
    # exact counts of different pages, of a slot and of each text in it
    shown = kept(seen.groupBy("host", "slot", "page_hash", "text_hash").agg(F.max("inside").alias("inside")), "shown")
    many = shown.groupBy("host", "slot").agg(F.count_distinct("page_hash").alias("pages"), F.max("inside").alias("within"))
    each = shown.groupBy("host", "slot", "text_hash").agg(F.count("*").alias("n")).join(many, ["host", "slot"])
    slots = each.where("NOT within").groupBy("host", "slot", "pages").agg(F.count("*").alias("texts")).where(F.col("texts") <= CONSTANT * F.col("pages"))
    constant = slots.groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("template"))
    same = each.where("within").where(F.col("n") - 1 >= SAME * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "text_hash"))).alias("same"))
    return kept(shapes.join(constant, "host", "left").join(same, "host", "left"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Character references are decoded, white space inside a block is one space, blocks are joined by an
    empty line. Null and empty html give an empty text; a null url is the host of the empty name. Very long and very
    deep pages are read whole, in time that grows with their length. Repeated rows are extracted alike. Other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    induced = wrappers(rows.select("host", "html", F.struct(F.xxhash64("page_id"), F.col("page_id"), F.xxhash64("html")).alias("h")))
    joined = rows.join(induced, "host", "left")
    key = pages.schema["page_id"].dataType.simpleString()
    text = joined.mapInArrow(_extract(["page_id", "url"]), f"page_id {key}, url string, text string")
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
