"""Pages to text, sentences, chunks and degraded extractions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from hopweave import dictionaries as D
from hopweave.functions import names as N
from hopweave.functions import text as T

_BOUNDARY = re.compile(r"([.!?]['\"’”)\]]*)([ \t]+)|(\n+)")
_RAW, _FURNITURE = {"script", "style", "noscript", "template"}, {"nav", "header", "footer", "aside", "form"}
_BREAKS = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table", "blockquote"}
#: A page with less text than this outside its furniture is read with the furniture (fixed value).
LEAST_TEXT = 250


class _Text(HTMLParser):
    """Furniture goes where it is closed: an element that is never closed takes nothing with it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.raw, self.in_title = [], [], None, False
        self.open, self.gone = [], []  # furniture that is open: (tag, its first part); closed: (first part, end)

    def handle_starttag(self, tag, attrs):
        if self.raw is None and tag in _RAW:
            self.raw = tag
        self.in_title = tag == "title"
        if tag in _FURNITURE and not self.raw:
            self.open.append((tag, len(self.parts)))
        if tag in _BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = None
        self.in_title = False
        at = next((i for i in reversed(range(len(self.open))) if self.open[i][0] == tag), None)
        if at is not None and not self.raw:
            self.gone.append((self.open[at][1], len(self.parts)))
            del self.open[at:]
        if tag in _BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.raw:
            self.parts.append(data)

    def text(self) -> str:
        """The text outside furniture; all of it if that is too little and there is more."""
        kept, at = [], 0
        for a, b in sorted(self.gone):
            kept += self.parts[at:a]
            at = max(at, b)
        main, whole = "".join(kept + self.parts[at:]), "".join(self.parts)
        return whole if len(main.strip()) < LEAST_TEXT and len(whole.strip()) > len(main.strip()) else main


#: Characters of output that a worker holds before it passes them on.
HELD = 4 << 20


def _passed_on(rows: Iterator[tuple[int, tuple]], batch: pa.RecordBatch, kept: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about HELD characters of rows (place in batch, values), each with the columns kept of its place."""
    at, out, size = [], [], 0

    def made() -> pa.RecordBatch:
        own = [batch.column(c).take(pa.array(at, pa.int32())) for c in kept]
        return pa.RecordBatch.from_arrays(own + [pa.array(vs, f.type) for vs, f in zip(zip(*out), schema)], names=kept + schema.names)

    for i, values in rows:
        at.append(i)
        out.append(values)
        size += 64 + len(values[-1])
        if size > HELD:
            yield made()
            at, out, size = [], [], 0
    if out:
        yield made()


def _page(h: str | None) -> tuple[str | None, str]:
    p = _Text()
    p.feed(h or "")
    p.close()
    return " ".join("".join(p.title).split()) or None, p.text()


@F.pandas_udf(T_.StructType([T_.StructField("title", T_.StringType()), T_.StructField("text", T_.StringType())]))
def html_to_text(html: pd.Series) -> pd.DataFrame:
    """Main text (script, style and page furniture left out, furniture only where enough text is left) and title; text is not normalized yet."""
    return pd.DataFrame([_page(h) for h in html], columns=["title", "text"])


def read_html(pages: DataFrame) -> DataFrame:
    """pages with title and text in the place of html, as ``html_to_text`` gives them, for whole tables: a worker holds few texts at a time."""
    kept = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _passed_on(((i, _page(h.as_py())) for i, h in enumerate(b.column("html"))), b, kept, pa.schema([("title", pa.string()), ("text", pa.string())]))

    return pages.mapInArrow(run, T_.StructType([*(pages.schema[c] for c in kept), T_.StructField("title", T_.StringType()), T_.StructField("text", T_.StringType())]))


def _sentences(text: str, most: int | None = None) -> Iterator[tuple[int, int, int, str]]:
    def cuts() -> Iterator[tuple[int, int]]:
        at = 0
        for m in _BOUNDARY.finditer(text):
            if m[3] is None:
                word = re.search(r"([A-Za-z][A-Za-z.]*)$", text[max(0, m.start() - 64) : m.start()])
                short = word and (word[1].lower().strip(".") in D.ABBREVIATIONS or len(word[1].replace(".", "")) == 1)
                after = text[m.end() : m.end() + 1]
                if short or not (after.isupper() or after.isdigit() or after in "\"'“‘([" and after):
                    continue
            yield at, m.end() if m[3] is None else m.start()
            at = m.end()
        yield at, len(text)

    n = 0
    for a, b in cuts():
        piece = text[a:b]
        core = piece.strip()
        if core and (most is None or n < most):
            s = a + len(piece) - len(piece.lstrip())
            yield n, s, s + len(core), core
            n += 1


def split_sentences(text: str, most: int | None = None) -> list[tuple[int, int, int, str]]:
    """(index, start, end, text) with code-point offsets."""
    return list(_sentences(text, most))


#: The reference's max_sentences_per_page; pages are read whole here, and only a caller that asks for it gets so few.
PAGE_SENTENCES = 400


def sentences(pages: DataFrame, text: str = "text", key: str = "page_id", most: int | None = None) -> DataFrame:
    """(key, idx, start, end, text) of each page's sentences, or of the first ``most``."""
    own = pages.select(key, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _passed_on(((i, s) for i, t in enumerate(b.column("_text")) for s in _sentences(t.as_py() or "", most)), b, [key], pa.schema([*((c, pa.int32()) for c in ("idx", "start", "end")), ("text", pa.string())]))

    return own.mapInArrow(run, T_.StructType([own.schema[key], *(T_.StructField(c, T_.IntegerType()) for c in ("idx", "start", "end")), T_.StructField("text", T_.StringType())]))


def context_windows(rows: DataFrame, key: str, order: str, text: str, size: int = 3) -> DataFrame:
    """rows with context: the previous ``size`` texts of the key, joined by blanks."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-size, -1)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(w), " "))


def chunks(rows: DataFrame, key: str, index: str, width: int = 80, lead: int = 3) -> DataFrame:
    """Each row under every chunk start that shows it: windows of ``width`` with ``lead`` rows before. Each row meets at most two chunks."""
    own = F.floor(F.col(index) / width) * width
    nxt = own + width
    rows = rows.withColumn("_last", F.max(index).over(W.partitionBy(key)))
    starts = F.array_compact(F.array(own, F.when((F.col(index) >= nxt - lead) & (nxt <= F.col("_last")), nxt)))
    return rows.withColumn("chunk", F.explode(starts)).drop("_last")


def documents(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, title, text, text_sha256, skip_reason. The cheap gates run before the HTML is parsed."""
    gate = F.when(T.is_binary_url(F.col("url")), "binary").when(T.is_blocked_url(F.col("url")), "blocked_domain")
    gated = pages.select("page_id", "url", "html", F.coalesce(gate, F.lit("")).alias("gate"))
    parsed = read_html(gated.where("gate = ''").select("page_id", "url", "html")).withColumn("text", T.normalize_text(F.col("text")))
    good = parsed.withColumn("text_sha256", T.content_hash(F.col("text"))).withColumn("skip_reason", T.page_problem(F.col("text")))
    none = F.lit(None).cast("string")
    return good.unionByName(gated.where("gate <> ''").select("page_id", "url", none.alias("title"), none.alias("text"), none.alias("text_sha256"), F.col("gate").alias("skip_reason")))


def degraded_extractions(sents: DataFrame, key: str = "page_id") -> DataFrame:
    """Without a model: of each sentence that names two people and reads like no instruction, the first two when their surnames differ."""
    found = sents.where(~T.looks_like_instruction(F.col("text"))).withColumn("names", N.find_person_names(F.col("text"))).where(F.size("names") >= 2)
    two = found.select(key, "idx", F.col("names")[0].alias("subject_name"), F.col("names")[1].alias("object_name"), F.col("text").alias("span_text"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.lit("direct").alias("resolution_basis"))
    s = lambda c: N.surname(N.tokens(F.col(c)))
    return two.where(s("subject_name") != s("object_name"))
