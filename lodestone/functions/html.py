"""HTML as expressions and, where the tree matters, a parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import repaired_text, text_of

# What is walked, what is dropped, and where the content begins.
BLOCKS = ("h1", "h2", "h3", "p", "blockquote", "ul", "ol", "figure")
DROPPED = frozenset(("script", "style", "noscript", "iframe", "footer", "header", "nav", "aside"))
SKIPPED_PATHS = r"(?i)/(feed|wp-admin|wp-includes|wp-content)/"
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
MIN_SIDE, MIN_AREA = 48, 3000
HEADINGS, LISTS = ("h1", "h2", "h3"), ("ul", "ol")
ROOTS, ROOT_TAGS = ("entry-content", "article", "main", "content"), {"article": "article", "main": "main"}

IMAGE_FIELDS = ("src", "caption", "alt", "title", "width", "height")


def sniffed(html: Column) -> Column:
    head = F.lower(F.substring(text_of(html), 1, 1024))
    return F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype html"))


def page_title(html: Column) -> Column:
    """Text of the first h1, else of the title."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    h1, title = (plain(F.regexp_extract(text_of(html), rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)) for t in ("h1", "title"))
    return F.when(h1 != "", h1).otherwise(title)


def meta_property(html: Column, name: str) -> Column:
    """The content of the first meta element with that property, attributes in either order; null where there is none."""
    p = rf"(?is)<meta\b(?=[^>]*\bproperty\s*=\s*[\"']{name}[\"'])[^>]*\bcontent\s*=\s*(?:\"([^\">]*)\"|'([^'>]*)')"
    part = lambda i: F.nullif(F.regexp_extract(text_of(html), p, i), F.lit(""))
    return F.trim(F.coalesce(part(1), part(2)))


def image_dims(src: Column) -> Column:
    p = r"(?i)-([1-9]\d*)x([1-9]\d*)\.(?:jpg|jpeg|png|gif|webp)"
    part = lambda i: F.nullif(F.regexp_extract(text_of(src), p, i), F.lit("")).try_cast("int")
    return F.struct(part(1).alias("width"), part(2).alias("height"))


def is_tiny(width: Column, height: Column) -> Column:
    known = width.isNotNull() & height.isNotNull()
    return F.coalesce(known & ((F.least(width, height) < MIN_SIDE) | (width.cast("bigint") * height < MIN_AREA)), F.lit(False))


def clean_caption(c: Column) -> Column:
    t = F.regexp_replace(F.trim(text_of(c)), r"(?i)^\s*(?:source|credit)\s*:\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"https?://\S+", ""), r"\s*[-–—:;]*\s*$", ""))


def image_records(images: Column) -> Column:
    """Raw images as (src, caption, alt, title, image_text); tiny ones go, by attributes or else by the size in the address."""

    def side(i: Column, name: str) -> Column:
        own = i[name].try_cast("int")
        return F.coalesce(F.when(own != 0, own), image_dims(i["src"])[name])

    def record(i: Column) -> Column:
        cap, alt, title = clean_caption(i["caption"]), F.trim(text_of(i["alt"])), F.trim(text_of(i["title"]))
        merged = F.array_join(F.array_distinct(F.filter(F.array(cap, alt, title), lambda x: x != "")), " ")
        return F.struct(i["src"].alias("src"), cap.alias("caption"), alt.alias("alt"), title.alias("title"), merged.alias("image_text"))

    return F.transform(F.filter(images, lambda i: ~is_tiny(side(i, "width"), side(i, "height"))), record)


def _source(a: dict[str, str]) -> str:
    """The first address that isn't a drawn placeholder."""
    named = [a.get(k, "") for k in ("src", "data-src", "data-lazy-src", "data-original")]
    sets = [(a.get(k, "").split(",")[0].split() or [""])[0] for k in ("srcset", "data-srcset")]
    return next((x for x in named + sets if x and not x.startswith("data:image/svg")), "")


class _Block:
    def __init__(self, tag: str, pos: int, roots: frozenset[str], quoted: bool):
        self.tag, self.pos, self.roots, self.quoted = tag, pos, roots, quoted
        self.items: list[list[str]] = [] if tag in LISTS else [[]]
        self.images: list[dict] = []


class _Walk(HTMLParser):
    """Blocks in document order. A block's text holds that of blocks inside it; a list's items are its own li; a block closes an open paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[_Block] = []
        self.open: list[_Block] = []
        self.path: list[tuple[str, str]] = []  # open elements, with the kind of content root that each is
        self.seen: set[str] = set()
        self.caption: list[str] | None = None
        self.dropped = self.count = 0

    def _close(self, tag: str) -> None:
        while any(b.tag == tag for b in self.open):
            b = self.open.pop()
            self.done.append(b)
            if b.tag == tag:
                break

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        self.dropped += tag in DROPPED
        if tag == "img" and not self.dropped and (src := _source(a)):
            direct = bool(self.path) and self.path[-1][0] == "figure"
            image = {"src": src, "caption": "", "alt": a.get("alt", ""), "title": a.get("title", ""), "width": a.get("width"), "height": a.get("height"), "direct": direct}
            for b in self.open:
                b.images.append(image)
        if tag in VOID:
            return
        root = ROOT_TAGS.get(tag, "") or ("entry-content" if tag == "div" and "entry-content" in a.get("class", "").split() else "content" if tag == "div" and a.get("id") == "content" else "")
        root = "" if root in self.seen else root  # the first of each kind
        self.seen |= {root} - {""}
        self.path.append((tag, root))
        if self.dropped:
            return
        if tag in BLOCKS:
            if self.open and self.open[-1].tag == "p":
                self._close("p")
            roots = frozenset(r for _, r in self.path if r)
            self.open.append(_Block(tag, self.count, roots, any(b.tag == "blockquote" for b in self.open)))
            self.count += 1
        elif tag == "li":
            if self.open and self.open[-1].tag == "p":
                self._close("p")
            if self.open and self.open[-1].tag in LISTS:
                self.open[-1].items.append([])
        elif tag == "figcaption":
            self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if not self.dropped and tag == "figcaption" and self.caption is not None:
            text = _joined(self.caption)
            for b in [b for b in self.open if b.tag == "figure"][-1:]:
                for i in b.images:
                    i["caption"] = i["caption"] or (text if i["direct"] else "")
            self.caption = None
        for at in range(len(self.path) - 1, -1, -1):
            if self.path[at][0] == tag:
                self.dropped -= sum(t in DROPPED for t, _ in self.path[at:])
                del self.path[at:]
                break
        if not self.dropped and tag in BLOCKS:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if self.caption is not None:
            self.caption.append(data)
        for b in self.open:
            if b.items:
                b.items[-1].append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._close(self.open[-1].tag)


def _joined(parts: list[str]) -> str:
    return repaired_text(re.sub(r"\s+", " ", " ".join(parts)))


def walk(html: str) -> list[tuple]:
    """(tag, text, items, quoted, images) of the blocks in the first content root, else of all; headings even without a text."""
    w = _Walk()
    w.feed(html)
    w.close()
    root = next((r for r in ROOTS if r in w.seen), None)
    out = []
    for b in sorted(w.done, key=lambda b: b.pos):
        if root and root not in b.roots:
            continue
        items = [t for t in map(_joined, b.items) if t]
        images = [{k: i[k] for k in IMAGE_FIELDS} for i in b.images]
        if items or images or b.tag in HEADINGS:
            out.append((b.tag, " ".join(items), items, b.quoted, images))
    return out


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, pos, tag, text, items, quoted, images) of every block; text in dropped elements is left out.

    Pages and the texts in them are put right where they are mis-decoded (text.repaired_text).
    A page that can't be parsed gives one row with tag "error" and the reason; a null or empty one gives none.
    """
    image = pa.struct([(k, pa.string()) for k in IMAGE_FIELDS])
    types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.list_(image))
    names = ["page_id", "pos", "tag", "text", "items", "quoted", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h in zip(batch.column("id").to_pylist(), batch.column("html")):
                try:
                    found = walk(repaired_text(h.as_py() or ""))
                except Exception as e:  # one bad page is a row, not a failed job
                    found = [("error", str(e), [], False, [])]
                rows += [(i, n, *b) for n, b in enumerate(found)]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    base = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).cast("string").alias("html"))
    raw = ", ".join(f"{k}: string" for k in IMAGE_FIELDS)
    out = base.mapInArrow(run, f"page_id bigint, pos int, tag string, text string, items array<string>, quoted boolean, raw array<struct<{raw}>>")
    return out.withColumn("images", image_records(F.col("raw"))).drop("raw")


def image_flags(images: Column) -> Column:
    """(has_image, caption_len) of a JSON list of image records: whether it has one, and the length of the first one's text; false and 0 for what is no such list."""
    rows = F.from_json(images, "array<struct<image_text: string>>")
    first = F.get(rows, F.lit(0))["image_text"]
    return F.struct((F.coalesce(F.size(rows), F.lit(0)) > 0).alias("has_image"), F.coalesce(F.length(first), F.lit(0)).alias("caption_len"))
