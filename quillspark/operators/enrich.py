"""OCR results joined to images, caches of them, and checks on structured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import once, one_space

MISSING = "[image: OCR unavailable]"


def attach_ocr(images: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Images with their text; a missing result becomes a placeholder, an empty one drops the image."""
    joined = images.join(results, keys, "left").withColumn("text", F.when(F.col("found").isNull(), MISSING).otherwise(F.col("text")))
    return joined.filter(F.trim("text") != "").drop("found")


def first_of_each(images: DataFrame, group: list[str], content_col: str = "content", order_col: str = "seq") -> DataFrame:
    """The first image of each content (by sha256) in a group. A partial aggregate, so copies never travel."""
    keyed = images.withColumn("sha256", F.sha2(F.col(content_col), 256))
    rest = [c for c in keyed.columns if c not in (*group, "sha256", content_col)]
    return keyed.groupBy(*group, "sha256").agg(F.min(F.struct(order_col, *[c for c in rest if c != order_col])).alias("x")).select(*group, "sha256", "x.*")


def expiry(created: Column, accessed: Column, ttl: float, max_age: float) -> Column:
    """Seconds at which an entry created and last refreshed then expires."""
    return F.least(accessed + ttl, created + max_age)


def is_expired(now: Column, created: Column, expires: Column, max_age: float) -> Column:
    return (now >= expires) | (now >= created + max_age)


def cache_misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys asked for that the cache doesn't hold."""
    return requests.select(key).distinct().join(cache, key, "left_anti")


def fan_out(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return requests.join(results, key, "left")


def newest(entries: DataFrame, keep: int, by: str, tie: str) -> DataFrame:
    """The ``keep`` entries used last: a bounded top-k, no global sort."""
    return entries.orderBy(F.desc(by), tie).limit(keep)


#: What counts as a token of a page: a word or number with the marks inside it, or a run of Chinese or Kana.
PAGE_TOKEN = r"[0-9A-Za-z][-0-9A-Za-z.,%$/+]*|[\u3040-\u30ff\u4e00-\u9fff]{2,}"


#: Runs of what tokens are made of: a token stands in a text if it stands in one of the text's runs.
TOKEN_RUN = r"[-0-9A-Za-z.,%$/+]+|[\u3040-\u30ff\u4e00-\u9fff]+"


def coverage(source: Column, shown: Column) -> Column:
    """``share, missing``: how many of the source's tokens (repeats counted) what is shown has, 1 without any; and those it lacks, in order.

    Tokens that are runs of what is shown are found by hash; only the others are looked for, each once, in the distinct runs.
    """
    tokens = F.filter(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(f"({PAGE_TOKEN})"), 1), lambda t: F.length(t) > 1)
    runs = F.array_distinct(F.regexp_extract_all(F.coalesce(shown, F.lit("")), F.lit(f"({TOKEN_RUN})"), 1))

    def judged(both: Column) -> Column:
        sought = F.struct(F.array_except(both["tokens"], both["runs"]).alias("tokens"), F.array_join(both["runs"], " ").alias("text"))
        lost = once(sought, lambda s: F.array_sort(F.filter(s["tokens"], lambda t: ~F.contains(s["text"], t))))
        return once(lost, lambda l: scored(both["tokens"], l))

    def scored(all_of: Column, lost: Column) -> Column:
        gone = F.when(F.size(lost) == 0, 0).otherwise(F.size(F.filter(all_of, lambda t: F.array_contains(lost, t))))
        return F.struct(F.when(F.size(all_of) == 0, 1.0).otherwise(1 - gone / F.size(all_of)).alias("share"), lost.alias("missing"))

    return once(F.struct(tokens.alias("tokens"), runs.alias("runs")), judged)


def empty_structured(page: str = "page") -> Column:
    p = F.col(page)
    return (F.trim(F.coalesce(p["text"], F.lit(""))) == "") & (F.size(F.coalesce(p["fields"], F.array())) == 0) & (F.size(F.coalesce(p["tables"], F.array())) == 0)


def violations(page: str = "page") -> Column:
    """What a structured page says that doesn't hold together, as names of rules in order.

    The page: ``text, headings, dates, tables, fields`` as read; ``illustrative`` (whether any table, field, metric or figure is);
    and what was made of it: ``document_type, confidence, legibility, fidelity, summary, primary_date, sections, entities``, ``relations`` of
    subject and object, ``figures`` of ``strings`` (all that are printed, those of nodes and edges too), ``values`` of data points, ``nodes`` of label and
    kind, ``edges`` of from and to. White space is made single before texts are compared; nulls hold nothing.
    """
    p = F.col(page)
    some = lambda xs: F.coalesce(xs, F.array())
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    text, headings, dates = one_space(F.coalesce(p["text"], F.lit(""))), F.transform(some(p["headings"]), one_space), F.transform(some(p["dates"]), one_space)
    absent = lambda x: ~blank(x) & ~F.contains(text, one_space(x))
    held_back, screenshot = F.coalesce(p["illustrative"], F.lit(False)), F.coalesce(p["document_type"] == "screenshot", F.lit(False))

    def loose_edge(f: Column) -> Column:
        labels = F.transform(some(f["nodes"]), lambda n: one_space(F.coalesce(n["label"], F.lit(""))))
        return F.exists(some(f["edges"]), lambda e: (~blank(e["from"]) & ~F.array_contains(labels, one_space(e["from"]))) | (~blank(e["to"]) & ~F.array_contains(labels, one_space(e["to"]))))

    figures = some(p["figures"])
    rules = [
        ("illustrative_needs_screenshot", held_back & ~screenshot),
        ("screenshot_unsure", held_back & screenshot & ((p["confidence"] < 0.7) | (p["legibility"] != "high"))),
        ("described_needs_summary", p["fidelity"].isin("described", "caption") & blank(p["summary"])),
        ("skipped_not_empty", (p["fidelity"] == "skipped") & (~blank(p["text"]) | (F.size(some(p["tables"])) > 0) | (F.size(some(p["fields"])) > 0))),
        ("primary_date_unknown", ~blank(p["primary_date"]) & ~F.array_contains(dates, one_space(F.coalesce(p["primary_date"], F.lit(""))))),
        ("figure_not_in_text", F.exists(figures, lambda f: F.exists(some(f["strings"]), absent))),
        ("data_points_without_values", F.exists(figures, lambda f: (F.size(some(f["values"])) > 0) & F.forall(some(f["values"]), blank))),
        ("edge_without_node", F.exists(figures, loose_edge)),
        ("empty_node", F.exists(figures, lambda f: F.exists(some(f["nodes"]), lambda n: blank(n["label"]) & blank(n["kind"])))),
        ("section_not_a_heading", F.exists(some(p["sections"]), lambda s: ~blank(s) & ~F.array_contains(headings, one_space(s)))),
        ("sections_beyond_headings", F.size(some(p["sections"])) > F.size(some(p["headings"])) + 2),
        ("entity_not_in_text", F.exists(some(p["entities"]), absent)),
        ("relation_not_in_text", F.exists(some(p["relations"]), lambda r: absent(r["subject"]) | absent(r["object"]))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules]))


def neighbours(pages: DataFrame, reach: int = 1) -> DataFrame:
    """Each page with those around it, in order."""
    w = Window.partitionBy("doc_id").orderBy("page").rangeBetween(-reach, reach)
    return pages.withColumn("window", F.array_sort(F.collect_list("page").over(w)))
