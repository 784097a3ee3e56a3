"""From page text to citable sections.

Cleaning is relational: lines are counted per document and furniture is removed
by a join.  The section machine needs a document's lines in order, so it runs
once per document, documents in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import headings as h

CHUNKS = (
    "chunk_id string, doc_id string, text string, heading_trail array<string>, section_no string, "
    "page_start int, page_end int, token_count int"
)


def page_lines(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_num", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def boilerplate(pages: DataFrame) -> DataFrame:
    """``doc_id, furniture, n``: lines that occur max(2, pages // 2) times or more in a document."""
    counts = page_lines(pages).select("doc_id", h.furniture_key(F.col("line")).alias("furniture")).where("furniture <> ''").groupBy(
        "doc_id", "furniture").agg(F.count(F.lit(1)).alias("n"))
    needed = pages.groupBy("doc_id").agg(F.greatest(F.lit(2), F.expr("count(*) div 2")).alias("needed"))
    return counts.join(needed, "doc_id").where("n >= needed").select("doc_id", "furniture", "n")


def strip_boilerplate(pages: DataFrame) -> DataFrame:
    """Pages without boilerplate, page numbers and url footers; line order and blank lines stay."""
    lines = page_lines(pages).withColumn("furniture", h.furniture_key(F.col("line")))
    bad = boilerplate(pages).select("doc_id", "furniture", F.lit(True).alias("__bad"))
    blank = h.uline(F.col("line")) == ""
    kept = lines.join(bad, ["doc_id", "furniture"], "left").where(blank | (F.col("__bad").isNull() & ~h.is_page_furniture(F.col("line"))))
    texts = kept.groupBy("doc_id", "page_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select("doc_id", "page_num").join(texts, ["doc_id", "page_num"], "left").select(
        "doc_id", "page_num", F.coalesce("text", F.lit("")).alias("text"))


def dotted_numbering(pages: DataFrame) -> DataFrame:
    """``doc_id, dotted``: does any numbered line of the document have a dotted number?"""
    number = F.regexp_extract(h.uline(F.col("line")), r"(?U)" + h.NUMBERED, 1)
    return page_lines(pages).groupBy("doc_id").agg(F.bool_or(F.contains(number, F.lit("."))).alias("dotted"))


class Outline:
    """Open sections of one document, outermost first, and the sections closed so far.

    * A numbered heading closes everything at its level or deeper and opens a section.
    * An unnumbered one opens a section one level below the nearest numbered ancestor;
      right after a heading of a higher level without body it is joined to that instead.
    * Every line inside a section, headings and blanks too, first extends the page range
      of the innermost open section.  Lines before the first heading are dropped.
    * Sections are numbered in order of their first page, then of closing, so a child
      comes before its parent's own text on the same page.  Empty sections vanish.
    """

    def __init__(self) -> None:
        self.open: list[dict] = []
        self.closed: list[dict] = []

    def line(self, line: dict, page: int) -> None:
        """``line`` as ``headings.classified`` gives it."""
        text, top = line["text"], self.open[-1] if self.open else None
        if top is not None:
            top["to"] = page
        if not text:
            return
        if line["no"] is not None:
            self._begin(line["level"], line["heading"], line["no"], page)
        elif top is None:
            return
        elif line["title"]:
            base = next((s["level"] for s in reversed(self.open) if s["no"] is not None), 0)
            if not top["lines"] and top["level"] < base + 1:
                *above, last = top["trail"]
                top["trail"] = [*above, f"{last}: {text}"]
            else:
                self._begin(base + 1, text, None, page)
        else:
            top["lines"].append(text)

    def _begin(self, level: int, heading: str, number: str | None, page: int) -> None:
        self._close(level)
        above = self.open[-1]["trail"] if self.open else []
        self.open.append({"level": level, "no": number, "trail": [*above, heading], "from": page, "to": page, "lines": []})

    def _close(self, level: int) -> None:
        while self.open and self.open[-1]["level"] >= level:
            done = self.open.pop()
            done["text"] = "\n".join(done["lines"]).strip()
            if done["text"]:
                self.closed.append(done)

    def sections(self) -> list[dict]:
        self._close(0)
        return sorted(self.closed, key=lambda s: s["from"])


def merge_short(sections: list[dict], min_tokens: int) -> list[dict]:
    """Join sections under ``min_tokens`` to the next one, a short last one to the one before."""
    def join(a: dict, b: dict) -> dict:
        return a | {"text": a["text"] + "\n" + b["text"], "to": b["to"], "tokens": a["tokens"] + b["tokens"]}

    out: list[dict] = []
    for s in sections:
        out.append(join(out.pop(), s) if out and out[-1]["tokens"] < min_tokens else s)
    if len(out) > 1 and out[-1]["tokens"] < min_tokens:
        last = out.pop()
        out.append(join(out.pop(), last))
    return out


def _chunker(min_tokens: int):
    def chunk(key: tuple, pages: pd.DataFrame) -> pd.DataFrame:
        outline = Outline()
        for page, lines in pages.sort_values("page_num")[["page_num", "lines"]].itertuples(index=False):
            for line in lines:
                outline.line(line, int(page))
        found = [s | {"tokens": len(s["text"].split())} for s in outline.sections()]
        if min_tokens > 0:
            found = merge_short(found, min_tokens)
        return pd.DataFrame(
            [(f"{key[0]}-{i:04d}", key[0], s["text"], s["trail"], s["no"], s["from"], s["to"], s["tokens"]) for i, s in enumerate(found, 1)],
            columns=["chunk_id", "doc_id", "text", "heading_trail", "section_no", "page_start", "page_end", "token_count"])

    return chunk


def chunk_documents(pages: DataFrame, min_tokens: int = 0) -> DataFrame:
    """Chunks of all documents of ``pages`` (doc_id, page_num, text)."""
    clean = strip_boilerplate(pages)
    body = clean.where(~h.is_contents_page(F.col("text"))).join(dotted_numbering(clean), "doc_id")
    lines = F.transform(F.split("text", "\n"), lambda x: h.classified(h.uline(x), ~F.col("dotted")))
    return body.select("doc_id", "page_num", lines.alias("lines")).groupBy("doc_id").applyInPandas(_chunker(min_tokens), CHUNKS)


def with_labels(chunks: DataFrame) -> DataFrame:
    from quillmark.functions.text import cite_label

    return chunks.withColumn("cite_label", cite_label(F.col("doc_id"), F.col("section_no"), F.col("page_start"), F.col("page_end")))
