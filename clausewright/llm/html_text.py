"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags.  Blocks in menus, footers, forms, reader
comments ... are marked by their place.  The first pass decides the others by link
density, length and density of stop words; short or undecided blocks stay ambiguous.
The second pass gives each ambiguous block the label of its nearest decided neighbours;
inside a page's main element that element is one more vote.  Outside of it, where there
is one, all is out.  A class marks by its words, but not one that only tells of a page's
layout (``LAYOUT``), nor on an element around the main one.  The good blocks' texts, white space made single spaces and references decoded, are
joined in page order by one line feed.

Defined results
* null or empty html, and a page without a good block, give an empty text;
* markup that is not closed runs to the end of the page, a cut tag is markup, and a
  cut or unknown character reference stays as written;
* every row comes back once, rows that repeat an id too; nulls in the id or other
  columns are carried; an empty table gives no rows; other columns are ignored;
* a page of any length is parsed whole, in one pass over its tags.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.quality_rules import STOP_WORDS
from clausewright.llm.scratch import pick

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Tags whose content is never parsed, and tags whose content is never main text.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
OUT = {"nav", "footer", "aside", "form", "head", "button", "select", "svg", "canvas", "object", "dialog", "menu", "audio", "video", "math", "datalist"}
MAIN = {"article", "main"}
BLOCK = set("html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main blockquote pre figure figcaption hr address header footer nav aside form fieldset legend details summary center option head".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Tags an open one of which ends where the next such begins.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"html", "body", "head", "td", "th", "tr"}
#: Words in class, id or role that mark what surrounds an article.
AROUND = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead ad ads adv advert adverts advertisement "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal newsletter subscribe "
    "subscription signup login search form share sharing social pagination pager skip complementary contentinfo dialog".split()
)
#: Those that do so outside the main element only, and those that do so even around one.
LOOSE = set("side header banner overlay widget".split())
READERS = set("related recommended recommendations comment comments commentlist respond replies disqus discussion".split())
#: What a class begins with that tells what is elsewhere on the page.
LAYOUT = ("has-", "has_", "with-", "with_", "no-", "no_", "is-", "is_")
#: Code points from which a block's own figures decide it; link densities above which it is out; stop word densities.
LONG, VERY_LONG, LINKED, LINKED_SHORT, STOPPED, LITTLE_STOPPED = 70, 200, 0.5, 0.2, 0.12, 0.06
_STOP = frozenset(STOP_WORDS)


def _around(name: str, attributes: str, in_main: bool) -> int:
    """Whether an element's content is no main text: 2 for certain, 1 unless the main element is in it, 0 not."""
    if name in OUT or name == "header" and not in_main:
        return 2
    if not attributes or name in ("html", "body", *MAIN) and "comment" not in attributes:
        return 0
    found = 0
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return 2
        if key in ("class", "id", "role") and name not in ("html", "body"):
            words = {x for t in value.split() if not t.startswith(LAYOUT) for x in re.split(r"[^a-z0-9]+", t)}
            if not READERS.isdisjoint(words):
                return 2
            found = max(found, name not in MAIN and not (AROUND.isdisjoint(words) and (in_main or LOOSE.isdisjoint(words))))
    return found


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, code points inside links, stands in the main element, is out by its place), in page order."""
    found: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # name, is out, is main element
    parts: list[str] = []
    linked = links = 0
    out = main = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((text, linked, main > 0, out > 0))
            parts, linked = [], 0

    def pop_to(k: int) -> None:
        nonlocal out, main, links
        while len(stack) > k:
            name, was_out, was_main = stack.pop()
            out, main, links = out - (was_out > 0), main - was_main, links - (name == "a")

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text = page[at:stop]
            if "&" in text:
                text = entities.unescape(text)
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            n = NAME.match(m[0])
            if not n or m[0][-1] != ">":
                continue
            closing, name, attributes = m[0][1] == "/", n[1].lower(), m[0][n.end() : -1]
        else:
            closing, name, attributes = bool(m[1]), m[2].lower(), m[3]
        if name == "br":
            parts.append(" ")
            continue
        if closing:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(x[1] or x[2] for x in stack[k:]):
                        flush()
                    pop_to(k)
                    break
            continue
        if name in RAW and not attributes.rstrip().endswith("/"):
            shut = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            at = shut.start() if shut else end
            parts.append(" " if name not in ("script", "style") else "")
            continue
        if name in BLOCK:
            flush()
            ends = IMPLIED.get(name, set()) | ({"p"} if name in ENDS_P else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        is_out, is_main = _around(name, attributes, main > 0), name in MAIN
        if is_out or is_main:
            flush()
        if is_main and not is_out:  # what is around it was marked for something else
            for k, (n, o, m) in enumerate(stack):
                if o == 1:
                    stack[k], out = (n, 0, m), out - 1
        if name == "a" and links:
            continue
        is_main = is_main and not out + is_out
        stack.append((name, is_out, is_main))
        out, main, links = out + (is_out > 0), main + is_main, links + (name == "a")
    flush()
    return found


def first_pass(text: str, linked: int, in_main: bool, out: bool, has_main: bool) -> int:
    """1 main text, -1 not, 0 ambiguous."""
    density = linked / max(1, len(text))
    if out or has_main and not in_main or density > LINKED:
        return -1
    if len(text) < LONG:
        return -1 if density > LINKED_SHORT else 0
    words = text.lower().split()
    stopped = sum(w.strip(".,;:!?\"'()") in _STOP for w in words) / len(words)
    if stopped >= STOPPED:
        return 1
    return 0 if in_main or stopped >= LITTLE_STOPPED or len(text) >= VERY_LONG else -1 if density > 0 else 0


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    has_main = any(m and not o for _, _, m, o in found)
    label = [first_pass(*b, has_main) for b in found]
    own = [not o and (m or not has_main) for _, _, m, o in found]  # their figures count, not their place
    final = list(label)
    before, last = [(0, 0)] * len(label), (0, 0)
    for i, x in enumerate(label):  # nearest block on either side that its own figures decide, as (label, place)
        last = (x, i) if x and own[i] else last
        before[i] = last
    after, last = [(0, 0)] * len(label), (0, 0)
    for i in range(len(label) - 1, -1, -1):
        last = (label[i], i) if label[i] and own[i] else last
        after[i] = last
    for i, x in enumerate(label):
        if not x:
            (a, j), (b, k) = before[i], after[i]
            if found[i][2]:  # the main element votes too
                final[i] = 1 if a + b + 1 > 0 else -1
            elif a and b and a != b:
                final[i] = a if i - j < k - i else b if k - i < i - j else -1
            else:
                final[i] = a or b or (1 if len(found[i][0]) >= LONG else -1)
    return "\n".join(t for (t, *_), x in zip(found, final, strict=True) if x > 0)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id, url, text, n_chars``."""
    base = pick(pages, id=id_col, url=url_col, html=html_col).withColumn("html", F.col("html").cast("string"))
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return base.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every whole page of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
