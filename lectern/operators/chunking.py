"""Semantic chunking: a fold over paragraphs, run as a table function on whole documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that are chunked at a time.
ROWS_A_STEP = 64
# Where an overlap may begin, and where long text may be cut, best first.
OVERLAP_CUTS = ["\n\n", "。", "！", "？", "；", "，", ". ", "! ", "? ", "; ", ", "]
LONG_CUTS = [["。", "！", "？", ". ", "! ", "? "], ["，", ", ", "；", "; "], [" "]]


@dataclass(frozen=True)
class Chunker:
    """size: most characters of a chunk; overlap: of the text before that opens a chunk; least: a chunk is filled up to it.

    parity repeats three losses of the first design: a short first chunk vanishes, an oversize clause is cut to size (or
    dropped), an overlap without room is kept whole. Otherwise no character of a paragraph is lost.
    longest: a packed chunk of more sizes than this is split (one can be that long where a short paragraph precedes a huge one);
    None leaves it whole.
    """

    size: int = 512
    overlap: int = 0
    least: int = 100
    parity: bool = False
    longest: int | None = 10

    def sentences(self, p: str) -> list[str]:
        return [s for x in re.split(r"(?<=[。！？.!?])\s*", p) if (s := x.strip())]

    def clauses(self, s: str) -> list[str]:
        return [c for x in re.split(r"(?<=[，,；;])\s*", s) if (c := x.strip())] or [s]

    def large(self, p: str) -> list[str]:
        """Pieces of a paragraph over the size: packed sentences; of a sentence over it, its clauses."""
        out: list[str] = []
        now = ""
        for s in self.sentences(p):
            if len(s) > self.size:
                if now:
                    out.append(now)
                now = ""
                for c in self.clauses(s):
                    if len(c) <= self.size:
                        out.append(c)
                    elif not self.parity:
                        out += self.long(c)
                    elif out:
                        out[-1] += c[: self.size]
            elif now and len(now) + len(s) > self.size:
                out.append(now)
                now = s
            else:
                now = f"{now} {s}" if now else s
        return out + [now] if now else out

    def long(self, text: str) -> list[str]:
        """Windows of the size, cut after a sentence end, a comma or a space that lies past their first quarter."""
        out = []
        while len(text) > self.size:
            cut = self.size
            for group in LONG_CUTS:
                at = max((k + len(d) for d in group if (k := text.rfind(d, 0, self.size)) > self.size // 4), default=0)
                if at:
                    cut = at
                    break
            if piece := text[:cut].strip():
                out.append(piece)
            text = text[cut:]
        return out + [text.strip()] if text.strip() else out

    def tail(self, before: str) -> str:
        """The end of the text before, from a delimiter on."""
        t = before[-self.overlap :]
        for d in OVERLAP_CUTS:
            if (k := t.rfind(d)) > 0:
                return t[k + len(d) :].strip()
        k = t.rfind(" ")
        return t[k + 1 :] if k > len(t) // 2 else ""

    def split(self, text: str | None) -> list[str]:
        paragraphs = [p for x in (text or "").split("\n\n") if (p := x.strip())]
        out: list[str] = []
        i = 0
        while i < len(paragraphs):
            if len(paragraphs[i]) > self.size:
                out += self.large(paragraphs[i])
                i += 1
                continue
            now, n = [paragraphs[i]], len(paragraphs[i])
            i += 1
            while i < len(paragraphs) and (n + 2 + len(paragraphs[i]) <= self.size or n < self.least):
                n += 2 + len(paragraphs[i])
                now.append(paragraphs[i])
                i += 1
            chunk = "\n\n".join(now)
            if out and self.overlap > 0:
                room = self.size - len(chunk) - (0 if self.parity else 2)
                lead = self.tail(out[-1])
                if room >= 0 and lead:
                    lead = lead[-room:] if room or self.parity else ""
                    chunk = f"{lead}\n\n{chunk}" if lead else chunk
            out.append(chunk)
        return self.tidy(out)

    def tidy(self, chunks: list[str]) -> list[str]:
        """Short chunks join the one before (the first one, the one after); very long ones are split."""
        short = max(self.least // 2, 50)
        out: list[str] = []
        lead = ""
        for k, c in enumerate(chunks):
            if lead:
                if self.parity:
                    lead = ""
                    continue
                c, lead = f"{lead}\n\n{c}", ""
            if len(c) < short and out:
                out[-1] += "\n\n" + c
            elif len(c) < short and k + 1 < len(chunks) or len(c) < short and self.parity:
                lead = c
            elif self.longest is not None and len(c) > self.longest * self.size:
                out += self.long(c)
            else:
                out.append(c)
        return out + [lead] if lead and not self.parity else out


def simple_split(text: str | None, size: int = 512) -> list[str]:
    """Packs paragraphs while the sum of their lengths stays under the size."""
    out, now, n = [], [], 0
    for p in (x.strip() for x in (text or "").split("\n\n")):
        if not p:
            continue
        if now and n + len(p) >= size:
            out.append("\n\n".join(now))
            now, n = [], 0
        now.append(p)
        n += len(p)
    return out + ["\n\n".join(now)] if now else out


def chunk_documents(docs: DataFrame, chunker: Chunker | None = None, ident: str = "doc_id", text: str = "text", split=None) -> DataFrame:
    """(id, chunk_index from 0, text) of every document; null and blank texts have no chunks. No shuffle."""
    split = split or (chunker or Chunker()).split
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_A_STEP):  # texts and chunks of these rows are held, beside the batch itself
                part = batch.slice(lo, ROWS_A_STEP)
                rows = [(n, i, c) for n, t in enumerate(part.column(1).to_pylist()) for i, c in enumerate(split(t))]
                n, i, c = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(n, pa.int64())), pa.array(i, pa.int32()), pa.array(c, pa.string())], names=["key", "chunk_index", "text"])

    return docs.select(F.col(ident).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, chunk_index int, text string").withColumnRenamed("key", ident)


def light_metadata(df: DataFrame, keep: tuple[str, ...] = ("chunk_index", "file_name", "file_path", "parser", "total_pages", "images_count", "tables_count", "formulas_count", "added_time")) -> DataFrame:
    """Only the columns worth storing with each chunk."""
    return df.select(*[c for c in df.columns if c in keep or c in ("chunk_id", "text")])
