"""Files as documents: text and Markdown, DOCX, crawled pages; and sinks of reports and event streams."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_docx, text_to_markdown
from ..shipping import ship


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))


def _docx(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def of(data: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                xml = z.read("word/document.xml").decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError):
            return None
        return "\n".join("".join(re.findall(r"<w:t[^>]*>([^<]*)</w:t>", p)) for p in re.split(r"</w:p>", xml))

    for f in frames:
        yield pd.DataFrame({"path": f["path"], "text": f["content"].map(of)})


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the paragraphs of DOCX files; a damaged file has a null text."""
    ship(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_docx, "path string, text string")
    return raw.withColumn("text", clean_docx(F.col("text")))


#: What holds a page's list of links and its body (the first that is found), and what is noise in it.
SIDE = (".design", ".left-column", ".sidebar", "#leftcolumn")
BODY = (".article-body", ".content", "article", ".article", "main")
NOISE = ("script", "style", ".ads", ".advertisement", "nav", ".nav", ".prevnext", ".pagination", ".page-nav", ".next-link", ".prev-link", ".footer", ".header", ".reply", "#respond", ".comment", ".sidebar")
#: Left out too: what browsers don't show as text.
HIDDEN = ("head", "footer", "aside", "noscript", ".ad")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Article(HTMLParser):
    """Markdown of the first element that one of the selectors names (else of the body), without noise; title and listed links."""

    def __init__(self, side: tuple[str, ...], body: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.kinds = (set(side), set(body), {*NOISE, *HIDDEN})
        self.whole: list[str] = []
        self.main: list[str] | None = None
        self.links: dict[str, str] = {}
        self.open: list[tuple[str, tuple[bool, bool, bool]]] = []
        self.depth = [0, 0, 0]  # open elements of each kind
        self.title, self.in_title, self.link, self.closed = "", False, None, False

    def tell(self, text: str) -> None:
        if self.depth[2]:
            return
        self.whole.append(text)
        if self.main is not None and self.depth[1] and not self.closed:
            self.main.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        names = {tag, *(f".{c}" for c in (a.get("class") or "").split()), f"#{a.get('id')}"}
        if tag not in _VOID:
            kind = tuple(bool(names & k) for k in self.kinds)
            self.open.append((tag, kind))
            self.depth = [n + k for n, k in zip(self.depth, kind, strict=True)]
            if kind[1] and self.main is None:
                self.main = []
        if tag == "a" and a.get("href") is not None and self.depth[0]:
            self.link = (a["href"], [])
        if tag == "title":
            self.in_title = True
        if re.fullmatch("h[1-6]", tag):
            self.tell("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "ul", "ol", "table"):
            self.tell("\n\n")
        elif tag == "li":
            self.tell("\n- ")
        elif tag in ("br", "tr"):
            self.tell("\n")
        elif tag in ("b", "strong"):
            self.tell("**")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in ("b", "strong"):
            self.tell("**")
        if tag == "a" and self.link is not None:
            href, text = self.link[0], "".join(self.link[1]).strip()
            self.link = None
            if text:
                self.links.setdefault(href, text)  # the first one of an address stays
        if any(t == tag for t, _ in self.open):
            while True:
                t, kind = self.open.pop()
                self.depth = [n - k for n, k in zip(self.depth, kind, strict=True)]
                self.closed |= kind[1] and not self.depth[1]
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        if self.link is not None:
            self.link[1].append(data)
        self.tell(data)


def page_articles(pages: DataFrame, side: tuple[str, ...] = SIDE, body: tuple[str, ...] = BODY) -> DataFrame:
    """(page_id, title, markdown, links of href and text) of crawled pages (page_id, html); parsing is per page, in Arrow batches.

    Links are those inside an element that side names, with text, each address once, in order; the body is the first element
    that body names, or the whole page. Selectors are tags, .classes and #ids.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page_id, html in zip(f["page_id"], f["html"], strict=True):
                p = _Article(side, body)
                p.feed(html or "")
                p.close()
                text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(p.whole if p.main is None else p.main))).strip()
                rows.append((page_id, p.title.strip(), text, [{"href": h, "text": x} for h, x in p.links.items()]))
            yield pd.DataFrame(rows, columns=["page_id", "title", "markdown", "links"])

    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, markdown string, links array<struct<href:string,text:string>>")


def paragraphs(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, text_to_markdown(F.col(text)))


def server_events(df: DataFrame, event: str, data: str, keep: list[str] | None = None) -> DataFrame:
    """Rows as server-sent events, with the columns of keep before them."""
    return df.select(*(keep or []), F.concat(F.lit("event: "), F.col(event), F.lit("\ndata: "), F.col(data), F.lit("\n\n")).alias("value"))


def write_report(summary: DataFrame, path: str, title: str) -> None:
    """A Markdown table of a summary, a row a configuration or category, as one text file."""
    head = "| " + " | ".join(summary.columns) + " |\n|" + "---|" * len(summary.columns)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in summary.columns]), F.lit(" |"))
    body = summary.select(line.alias("l")).agg(F.array_join(F.array_sort(F.collect_list("l")), "\n").alias("b"))
    body.select(F.concat(F.lit(f"# {title}\n\n{head}\n"), "b").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_sheet(records: DataFrame, path: str, order: list[str]) -> None:
    """Questions and answers as CSV sheets of three columns (no, question, answer), numbered through in order: one file a range."""
    from ..operators.generation import numbered

    sheet = numbered(records.select(*{*order, "question", "answer"}), order).select("no", "question", "answer")
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sheet.repartitionByRange(parts, "no").sortWithinPartitions("no").write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_by_task(traces: DataFrame, path: str, task: str = "task_id") -> None:
    """Traces as JSON, a folder a task; a task that is written again replaces its own folder alone."""
    traces.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(task).json(path)


def log_expired(name: Column, today: Column, days: int = 7) -> Column:
    """Whether a log file's date, as its name has it, is more than so many days back; names without a date stay."""
    date = F.to_date(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})\.log\z", 1).try_cast("date"))
    return F.coalesce(date < F.date_sub(today, days), F.lit(False))
