"""Sections, chunk packing, overlap and footnotes over ordered items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .items import level, render_item


@dataclass(frozen=True)
class ChunkConfig:
    max_chunk_size: int = 1500
    size_unit: str = "chars"
    overlap: int = 200
    keep_tables_whole: bool = True
    split_on_heading_level: int = 2

    def __post_init__(self) -> None:
        if self.max_chunk_size <= 0 or self.overlap < 0 or self.size_unit not in ("chars", "tokens"):
            raise ValueError(f"invalid chunking settings: {self}")


def number_sections(items: DataFrame, split_level: int = 2) -> DataFrame:
    """Add ``section_id`` (0 for what comes before the first heading) and ``section_title``."""
    lvl = level(F.col("type"))
    head = (lvl >= 1) & (lvl <= split_level)
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("section_id", F.sum(head.cast("int")).over(order).cast("long")).withColumn("section_title", F.last(F.when(head, F.col("content")), ignorenulls=True).over(order))


def section_bounds(items: DataFrame, split_level: int = 2) -> DataFrame:
    """A row a section: first and last page, items, distinct types in order."""
    return number_sections(items, split_level).groupBy("doc_id", "section_id").agg(
        F.max("section_title").alias("section_title"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("n_items"), F.array_sort(F.collect_set("type")).alias("content_types")
    )


def section_hierarchy(items: DataFrame, split_level: int = 2) -> DataFrame:
    """``doc_id, section_id, path``: a title starts a new path; a section keeps the path's first title.

    Folding over a document's headings only needs to know, for each section, the last path before it of
    which it keeps the first element: that of the last title, or of the first section where none came.
    """
    lvl = level(F.col("type"))
    heads = number_sections(items, split_level).filter((lvl >= 1) & (lvl <= split_level)).withColumn("lvl", level(F.col("type")))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.last(F.when(F.col("lvl") == 1, F.col("content")), ignorenulls=True).over(before), F.first("content").over(before))
    return heads.withColumn("base", base).select("doc_id", "section_id", F.when((F.col("lvl") == 1) | F.col("base").isNull(), F.array("content")).otherwise(F.array("base", "content")).alias("path"))


# Folds

CHUNKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("section_title", T.StringType()),
        T.StructField("section_hierarchy", T.ArrayType(T.StringType())), T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType()), T.StructField("content_types", T.ArrayType(T.StringType())),
    ]
)


def measure(config: ChunkConfig):
    """Length and tail functions in the wanted unit; tokens fall back to characters where no encoding can be loaded."""
    if config.size_unit != "chars":
        try:
            import tiktoken

            enc = tiktoken.get_encoding("cl100k_base")
            return (lambda s: len(enc.encode(s))), (lambda s, n: enc.decode(enc.encode(s)[-n:]))
        except Exception:  # noqa: BLE001 - missing package, file or network all mean the same here
            pass
    return len, (lambda s, n: s[-n:])


def pack(rendered: list[tuple[str, str]], config: ChunkConfig, size=len) -> list[list[int]]:
    """Greedy packing of one section's ``(type, markdown)``: the items of each chunk.

    Whole if it fits. Else an item that would overflow opens a new chunk, unless it is a table to be kept
    whole; an item is never split. The separator of an item that opened a chunk stays counted.
    """
    shown = [i for i, (_, md) in enumerate(rendered) if md]
    if not shown:
        return []
    if size("\n\n".join(rendered[i][1] for i in shown)) <= config.max_chunk_size:
        return [shown]
    out: list[list[int]] = []
    held: list[int] = []
    load = 0
    for i in shown:
        kind, md = rendered[i]
        cost = size(md) + (2 if held else 0)
        if held and load + cost > config.max_chunk_size and not (kind == "table" and config.keep_tables_whole):
            out.append(held)
            held, load = [], 0
        held.append(i)
        load += cost
    return [*out, held]


def overlap(contents: list[str], config: ChunkConfig) -> list[str]:
    """Each chunk begins with the tail of the one before, that one's own overlap included, cut at its first space."""
    if config.overlap <= 0 or len(contents) < 2:
        return contents
    size, tail_of = measure(config)
    out = contents[:1]
    for text in contents[1:]:
        tail = out[-1]
        if size(tail) > config.overlap:
            tail = tail_of(tail, config.overlap)
            at = tail.find(" ")
            tail = tail[at + 1 :]  # the whole tail where there is no space
        out.append(f"{tail}\n\n{text}")
    return out


REFERENCE = re.compile(r"\[\^(?P<ref>\w+)](?!:)")
DEFINITION = re.compile(r"\[\^(?P<ref>\w+)]:\s*.")


def attach_footnotes(contents: list[str], notes: dict[str, str]) -> list[str]:
    """Definitions follow the chunk that refers to them first; those without a reference end the last chunk."""
    left, out = dict(notes), []
    for text in contents:
        mine = []
        for ref in REFERENCE.findall(text):
            if ref in left:
                mine.append(left.pop(ref))
        out.append(text + ("\n\n" + "\n".join(mine) if mine else ""))
    if out and left:
        out[-1] += "\n\n" + "\n".join(left.values())
    return out


def chunk_items(items: list[dict], config: ChunkConfig) -> list[dict]:
    """The chunks of one document's ordered items (dicts of type, content, page and markdown)."""
    notes: dict[str, str] = {}
    sections: list[dict] = []
    path: list[str] = []
    for item in items:
        if item["type"] == "text:footnote":
            m = DEFINITION.match(item["content"])
            notes[m.group(1) if m else item["content"][:20]] = item["content"]
            continue
        lvl = {"text:title": 1, "text:section": 2}.get(item["type"], 0)
        if 1 <= lvl <= config.split_on_heading_level:
            path = [item["content"]] if lvl == 1 else [*path[:1], item["content"]]
            sections.append({"title": item["content"], "path": path, "items": []})
        elif not sections:
            sections.append({"title": None, "path": [], "items": []})
        sections[-1]["items"].append(item)
    size, _ = measure(config)
    chunks = []
    for s in sections:
        groups = pack([(i["type"], i["markdown"]) for i in s["items"]], config, size)
        for g in groups:
            of = s["items"] if len(groups) == 1 else [s["items"][i] for i in g]
            pages = [i["page"] for i in of if i["page"] is not None]
            chunks.append({"content": "\n\n".join(s["items"][i]["markdown"] for i in g), "section_title": s["title"], "section_hierarchy": s["path"], "page_start": min(pages, default=None), "page_end": max(pages, default=None), "content_types": sorted({i["type"] for i in of})})
    contents = overlap([c["content"] for c in chunks], config)
    if notes:
        contents = attach_footnotes(contents, notes)
    return [c | {"chunk_index": k, "content": text} for k, (c, text) in enumerate(zip(chunks, contents, strict=True))]


#: Bytes of text, about, in a batch of chunks.
OUT_BYTES = 1 << 20


def chunk_documents(items: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of all documents of ``items(doc_id, seq, type, content, page)``.

    Items come sorted by document (one shuffle) and are folded one document after
    another in Python: packing, overlap and footnotes each depend on what went before. A batch has items, not documents, so
    a worker holds one document and a batch of lines, however long the texts and however many they are.
    """
    md = render_item(F.col("type"), F.col("content"))
    rows = items.select("doc_id", "seq", "type", "content", F.col("page").cast("int").alias("page"), md.alias("markdown"))
    ordered = rows.repartition("doc_id").sortWithinPartitions(*rows.columns).drop("seq")
    names = ordered.columns[1:]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[dict]]]:
        now, held = None, []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for d, *item in zip(*columns, strict=True):
                if held and d != now:
                    yield now, held
                    held = []
                now = d
                held.append(dict(zip(names, item, strict=True)))
        if held:
            yield now, held

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, load = [], 0
        for d, its in documents(batches):
            for c in chunk_items(its, config):
                out.append(c | {"doc_id": d})
                load += len(c["content"])
                if load > OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
                    out, load = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return ordered.mapInArrow(fold, CHUNKS)


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("content", pa.string()), ("section_title", pa.string()), ("section_hierarchy", pa.list_(pa.string())), ("page_start", pa.int32()), ("page_end", pa.int32()), ("content_types", pa.list_(pa.string()))]
)
