"""Which files are taken, how they are routed by format, and pluggable extractors with a quality gate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_pdf, readable, trimmed
from ..shipping import ship
from ..storage import stored

#: Formats that can be read, folders that are left out.
FORMATS = ["md", "txt", "docx", "pdf"]
LEFT_OUT = ["vendor/", "node_modules/", "testdata/"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]*)\z", 1))


def routed(files: DataFrame, path: str = "path", text: str | None = None) -> DataFrame:
    """Adds format and error: a format outside the list, or an empty text, is an error."""
    ext = extension(F.col(path))
    error = F.when(~ext.isin(FORMATS), "unsupported")
    if text:
        error = error.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "empty")
    return files.withColumn("format", ext).withColumn("error", error)


def wanted_path(path: Column, kind: Column) -> Column:
    """Markdown blobs at the top or under docs/, outside folders of other people's code."""
    out = F.lit(False)
    for x in LEFT_OUT:
        out = out | path.contains(x)
    return (kind == "blob") & path.endswith(".md") & ~out & (path.startswith("docs/") | ~path.contains("/"))


#: Fixed value: the most bytes of a file that is taken.
MOST_BYTES = 512 * 1024


def wanted_files(listing: DataFrame, path: str = "path", kind: str = "type", content: str = "content") -> DataFrame:
    """Files of a fetched tree that wanted_path takes, without those that are too large."""
    return listing.where(wanted_path(F.col(path), F.col(kind)) & (F.octet_length(content) <= MOST_BYTES))


def extracted(files: DataFrame, extract: Callable[[bytes], str | None], fallback: Callable[[bytes], str | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) as clean texts, and those that neither extractor made readable.

    extract and fallback are given by the caller (a PDF reader, a recogniser); they run in Arrow batches.
    """

    def run(frames: Iterator[pd.DataFrame], f: Callable) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"path": x["path"], "raw": x["content"].map(f)})

    def texts(d: DataFrame, f: Callable) -> DataFrame:
        return d.select("path", "content").mapInPandas(lambda x: run(x, f), "path string, raw string").withColumn("text", clean_pdf(F.coalesce("raw", F.lit("")))).drop("raw")

    ship(files.sparkSession)
    first = texts(files, extract)
    good = first.where(readable(F.col("text")))
    bad = first.where(~readable(F.col("text")) | F.col("text").isNull())
    if fallback is None:
        return good, bad
    second = texts(files.join(bad.select("path"), "path", "left_semi"), fallback)
    return good.unionByName(second.where(readable(F.col("text")))), second.where(~readable(F.col("text")))


def recognised(files: DataFrame, pages: Callable[[bytes], list[bytes]], recognise: Callable[[bytes], str]) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) by way of their pages: (path, text) of the pages that were read, in order, and the quarantine
    (path, page, error) of those that weren't.

    pages cuts a file into page images, recognise reads one; both are given by the caller. A page that fails is left out, the
    others count; a file that can't be cut is in quarantine without a page, and has no text. Pages move as rows, so a long
    file is read by as many tasks as it has pages.
    """
    ship(files.sparkSession)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    found, error = list(pages(bytes(content))), None
                except Exception as x:
                    found, error = [], f"{type(x).__name__}: {x}"[:500]
                yield pd.DataFrame([(path, i, p, None) for i, p in enumerate(found)] or [(path, None, None, error or "no pages")], columns=["path", "page", "image", "error"]).astype({"page": "Int64"})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, page, image, error in zip(f["path"], f["page"], f["image"], f["error"], strict=True):
                text = None
                if error is None:
                    try:
                        text = recognise(bytes(image))
                    except Exception as x:
                        error = f"{type(x).__name__}: {x}"[:500]
                out.append((path, page, text, error))
            yield pd.DataFrame(out, columns=["path", "page", "text", "error"]).astype({"page": "Int64"})

    cut_pages = files.select("path", "content").mapInPandas(cut, "path string, page long, image binary, error string")
    told = stored(cut_pages.repartition("path", "page").mapInPandas(read, "path string, page long, text string, error string"), "pages")
    listed = F.array_sort(F.collect_list(F.struct("page", "text")))  # the text of one file
    texts = told.where("error is null").groupBy("path").agg(F.array_join(F.transform(listed, lambda p: p["text"]), "\n").alias("text"))
    return texts, told.where("error is not null").select("path", "page", "error")


#: Marks of questions, follow-ups and answers.
MAIN, EXTRA, FOLLOW, ANSWERS = "## Q", "**Q:", "**追问：", ("**参考回答：**", "**参考答案：**")


def questions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, question, answer) of each text, by a fold over its lines.

    `## Q...:` starts a main question, whose answer begins after an answer mark and ends at a rule; `**Q:` starts an extra one,
    whose answer begins at once. A follow-up inside a main answer is part of it, elsewhere a question of its own.
    Other headings and rules are passed over. The fold's state is that of one text.
    """
    state = "struct<mode:string,open:boolean,q:string,a:string,found:array<struct<q:string,a:string>>>"

    def step(s: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"\r\z", "")
        bare = lambda mark: trimmed(F.regexp_replace(F.substring(line, len(mark) + 1, 1 << 30), r"\*\*\z", ""))
        saved = F.when(s["q"] != "", F.concat(s["found"], F.array(F.struct(s["q"].alias("q"), trimmed(s["a"]).alias("a"))))).otherwise(s["found"])
        make = lambda mode, opened, q, a, found: F.struct(mode.alias("mode"), opened.alias("open"), q.alias("q"), a.alias("a"), found.alias("found")).cast(state)
        no, yes, none = F.lit(False), F.lit(True), F.lit("")
        main = (s["mode"] == "main") & s["open"]
        return (
            F.when(line.startswith(MAIN) & line.contains(":"), make(F.lit("main"), no, F.substring(line, 4, 1 << 30), none, saved))
            .when(line.startswith(EXTRA), make(F.lit("extra"), yes, bare(EXTRA), none, saved))
            .when(line.startswith(FOLLOW) & main, make(s["mode"], s["open"], s["q"], F.concat(s["a"], F.lit("\n\n"), F.regexp_replace(F.substring(line, 3, 1 << 30), r"\*\*\z", "")), s["found"]))
            .when(line.startswith(FOLLOW), make(F.lit("extra"), yes, bare(FOLLOW), none, saved))
            .when(line.startswith("### ") | line.startswith("# ") | (line.startswith("## ") & ~line.contains("Q")), s)
            .when(line.startswith(ANSWERS[0]) | line.startswith(ANSWERS[1]), make(s["mode"], yes, s["q"], s["a"], s["found"]))
            .when(line.startswith("---") & main, make(none, no, none, none, F.concat(s["found"], F.array(F.struct(s["q"].alias("q"), trimmed(s["a"]).alias("a"))))))
            .when(line.startswith("---") & (s["mode"] == "extra"), s)
            .when(s["open"] & (line != ""), make(s["mode"], s["open"], s["q"], F.concat(s["a"], line, F.lit("\n")), s["found"]))
            .otherwise(s)
        )

    start = F.struct(F.lit("").alias("mode"), F.lit(False).alias("open"), F.lit("").alias("q"), F.lit("").alias("a"), F.array().cast("array<struct<q:string,a:string>>").alias("found")).cast(state)
    last = lambda s: F.when(s["q"] != "", F.concat(s["found"], F.array(F.struct(s["q"].alias("q"), trimmed(s["a"]).alias("a"))))).otherwise(s["found"])
    found = F.aggregate(F.split(F.coalesce(text_col, F.lit("")), "\n"), start, step, last)
    return docs.select(id_col, F.posexplode(found).alias("n", "x")).select(id_col, (F.col("n") + 1).alias("n"), F.col("x.q").alias("question"), F.col("x.a").alias("answer"))
