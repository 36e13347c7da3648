"""Main text of web pages: what a page's structure says of its blocks, and the host's suffix array, which every page goes through.

The token streams of a host's pages make suffix arrays, truncated at ``RUN_TOKENS``: ranks come from prefix doubling, as hashes,
so that tasks agree on them and a host of any size is spread over tasks. Suffixes of one rank are one repeated substring. Where it
stands on enough distinct pages, each of its occurrences is covered, so a longer repetition is covered by the overlapping ones; a
block that is covered is boilerplate. What is enough depends on what the page says of the block: three pages where it says nothing,
half of the host's articles where it says that the block is text.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.shingles import mix
from logweave.llm.words import map_batches, slices
from logweave.plans.materialize import release, store

# Elements and words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg canvas object textarea select title xmp math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form button dialog menu head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav footer masthead cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations comment comments disqus respond replies reply widget widgets pagination pager toolbar skip".split()
)
PARAGRAPH_ENDERS = BLOCKS - {"body", "html", "head"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'=<>/]+)""")
_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"[^a-z0-9]+")
MAIN, NEUTRAL, DROP, TEMPLATE = "main", "neutral", "drop", "template"
#: Tokens of a repeated run, distinct pages of the host that must have it, and the share of a block's tokens that must be covered.
RUN_TOKENS, RUN_PAGES, COVERED = 8, 3, 0.8
#: Of the distinct articles of a host the share that must have a run (RUN_PAGES at least), and of an article's tokens the share that
#: its covered blocks stay under; an article with more is a copy of others, and all of it is text.
ARTICLE_SHARE, ARTICLE_LOSS = 0.5, 0.5
#: Pages of a host above which it is dealt over several tasks, and bytes of packed articles that are compared at a time; neither changes a result.
HOST_PAGES, GROUP_BYTES = 512, 2 << 20
_END = np.uint64(0x9E3779B97F4A7C15)


def _kind(tag: str, text: str, above: str) -> str:
    """Of an element, given what it stands in: dropped stays dropped, and main text stays main unless something in it is no text."""
    if above == DROP or tag in BOILERPLATE_TAGS or (tag == "header" and above != MAIN):
        return DROP
    if text and text.strip():
        attrs = {(m[1] or m[5]).lower(): entities.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(text)}
        role = attrs.get("role", "")
        if role in BOILERPLATE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
            return DROP
        if tag not in ("body", "html", "main") and BOILERPLATE_NAMES.intersection(_NAMES.split(f"{attrs.get('class', '')} {attrs.get('id', '')}")):
            return DROP
        if role == "main" or attrs.get("itemprop") == "articlebody":
            return MAIN
    return MAIN if tag in ("article", "main") else above


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of the non-empty blocks of a page in order; MAIN inside an article, NEUTRAL where the page does not say, DROP for what is no text."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = [("", NEUTRAL)]

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((stack[-1][1], text))

    def close(tag: str) -> None:
        k = len(stack) - 1
        while k and stack[k][0] != tag:
            k -= 1
        if k:
            if any(t in BLOCKS for t, _ in stack[k:]):
                flush()
            del stack[k:]

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        parts.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m["cdata"]:
                parts.append(entities.unescape(m["cdata"]).replace("&", "&amp;"))
            continue
        if m["end"] or m["end2"]:
            close(tag)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag in VOID:
            parts.append(" " if tag in ("br", "wbr", "img") and tag != "wbr" else "")
            if tag == "hr":
                flush()
        else:
            if tag in BLOCKS:
                flush()
                if tag in PARAGRAPH_ENDERS and any(t == "p" for t, _ in stack):
                    k = max(i for i, (t, _) in enumerate(stack) if t == "p")
                    if not any(t in BLOCKS for t, _ in stack[k + 1 :]):
                        del stack[k:]
                elif tag in ("li", "dt", "dd", "td", "th", "tr") and stack[-1][0] == tag:
                    stack.pop()
            attrs = m["attrs"] or m["attrs2"] or ""
            if not attrs.rstrip().endswith("/") or tag in BLOCKS:
                stack.append((tag, _kind(tag, attrs, stack[-1][1])))
    flush()
    return out


def main_text(page: str) -> str | None:
    """The text of the page's articles; None if it has none and the host must tell."""
    found = [t for kind, t in blocks(page) if kind == MAIN]
    return "\n\n".join(found) if found else None


def ranks(texts: list[str], tokens: int = RUN_TOKENS) -> np.ndarray:
    """For each token of a page's stream the rank of the suffix from there, told apart by its first ``tokens`` tokens.

    Prefix doubling: the rank over 2k tokens is made from those over k here and k further on. The last places of a stream,
    with fewer tokens behind them, have no rank and are left out.
    """
    rank = np.array([xxhash.xxh3_64_intdigest(w) for text in texts for w in text.split()], np.uint64)
    have = 1
    while have < tokens and len(rank):
        step = min(have, tokens - have)
        here, ahead = rank[: max(0, len(rank) - step)], rank[step:]
        rank = mix(here * _END + mix(ahead + np.uint64(have)))
        have += step
    return rank


def covered(texts: list[str], own: np.ndarray, repeated: np.ndarray, tokens: int = RUN_TOKENS) -> list[bool]:
    """For each block whether ``repeated`` ranks cover it; ``own`` are the ranks of the stream."""
    sizes = [len(text.split()) for text in texts]
    edges = np.zeros(sum(sizes) + 1, np.int64)
    at = np.flatnonzero(np.isin(own, repeated))
    np.add.at(edges, at, 1)
    np.add.at(edges, at + tokens, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edges)[:-1] > 0)))
    ends = np.cumsum(sizes, dtype=np.int64)
    return [bool(inside[b] - inside[b - n] >= COVERED * max(n, 1)) for b, n in zip(ends.tolist(), sizes, strict=True)]


_OUT = "page_id bigint, url string, text string, n_chars bigint"


def _result(ids: pa.Array, urls: pa.Array, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _packed(found: list[tuple[str, str]]) -> bytes:
    return json.dumps(found, ensure_ascii=False).encode()


def _unpacked(packed: bytes) -> list[tuple[str, str]]:
    return json.loads(packed)


def _article(found: list[tuple[str, str]]) -> list[str]:
    return [t for kind, t in found if kind in (MAIN, TEMPLATE)]


def parsed(pages: DataFrame, press: int = 0) -> DataFrame:
    """One row per page: row (a number of its own), page_id, url, host, stream (a hash of what it shows), article (whether it has
    main text) and packed (its blocks, for shuffles compressed at the level ``press``)."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("bigint"), "url", _host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=press).compress if press else bytes
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                found = [blocks(h) for h in part.column("html").to_pylist()]
                stream = [xxhash.xxh3_64_intdigest("\0".join(t for _, t in b)) for b in found]
                own = [pa.array(np.array(stream, np.uint64).view(np.int64)), pa.array([any(kind == MAIN for kind, _ in b) for b in found], pa.bool_()), pa.array([pack(_packed(b)) for b in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "page_id", "url", "host")), *own], ["row", "page_id", "url", "host", "stream", "article", "packed"])

    return map_batches(rows, run, _PARSED)


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_PARSED = "row bigint, page_id bigint, url string, host string, stream bigint, article boolean, packed binary"


def _runs(texts: list[str]) -> np.ndarray:
    return np.unique(ranks(texts))


def _least(pages: int) -> int:
    """Distinct articles that must have a run, of so many of a host."""
    return max(RUN_PAGES, math.ceil(ARTICLE_SHARE * pages))


def without_template(found: list[tuple[str, str]], runs: np.ndarray) -> list[tuple[str, str]]:
    """The blocks of a page, those of its article that the host's ``runs`` cover marked as TEMPLATE; all stay if the article would lose too much."""
    texts = [t for kind, t in found if kind == MAIN]
    drop = covered(texts, ranks(texts), runs)
    lost, every = (sum(len(t.split()) for t, d in zip(texts, which, strict=True) if d) for which in (drop, [True] * len(texts)))
    if not lost or lost >= ARTICLE_LOSS * every:
        return found
    at = iter(drop)
    return [(TEMPLATE if kind == MAIN and next(at) else kind, t) for kind, t in found]


def compared(pages: DataFrame) -> DataFrame:
    """The rows of ``parsed``, each article compared with those of its host, and two more columns: whole and runs.

    Pages are dealt by host, those of a large host by host and stream. Where a task meets all pages of a host (whole) their
    templates are marked here. Where it meets a group of them, the first row of the group has the runs that stand on the share of the
    group's articles: what stands on the share of all the host's articles does so in one group at least.
    """
    size = F.broadcast(pages.groupBy(_host().alias("host")).count().where(F.col("count") > HOST_PAGES))
    rows = parsed(pages, press=3).join(size, "host", "left").withColumn("whole", F.col("count").isNull())
    rows = rows.withColumn("part", F.when(F.col("whole"), 0).otherwise(F.pmod(F.xxhash64("stream"), F.ceil(F.col("count") / HOST_PAGES))))
    names = ["row", "page_id", "url", "host", "stream", "article", "packed", "whole"]
    rows = rows.repartition("host", "part").sortWithinPartitions("host", "part", "stream").select(*names, "part")

    def group(rows: list[dict], whole: bool) -> pa.RecordBatch:
        for r in rows:
            r["packed"] = zstandard.decompress(r["packed"])
        found = [_unpacked(r["packed"]) if r["article"] else None for r in rows]
        each, last = [], None
        if not whole or len({r["stream"] for r in rows if r["article"]}) >= RUN_PAGES:
            for r, b in zip(rows, found, strict=True):
                if b and r["stream"] != last:
                    each.append(_runs(_article(b)))
                    last = r["stream"]
        runs, n = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        runs = runs[n >= (_least(len(each)) if whole else math.ceil(ARTICLE_SHARE * len(each)))]
        if whole and len(runs):
            for r, b in zip(rows, found, strict=True):
                if b and (new := without_template(b, runs)) is not b:
                    r["packed"] = _packed(new)
        sent = [None] * len(rows)
        if not whole:
            sent[0] = runs.view(np.int64)
        out = [pa.array([r[c] for r in rows], t) for c, t in zip(names[:-1], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()], strict=True)]
        return pa.RecordBatch.from_arrays([*out, pa.array([whole] * len(rows)), pa.array(sent, pa.list_(pa.int64()))], [*names, "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, cut = [], 0, False  # cut: earlier pages of the same host and part went before
        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["host"], r["part"]) != (held[-1]["host"], held[-1]["part"]):
                    yield group(held, held[0]["whole"] and not cut)
                    held, size, cut = [], 0, False
                elif size >= GROUP_BYTES and r["stream"] != held[-1]["stream"]:
                    yield group(held, False)
                    held, size, cut = [], 0, True
                held.append(r)
                size += len(r["packed"])
        if held:
            yield group(held, held[0]["whole"] and not cut)

    return map_batches(rows, run, _PARSED + ", whole boolean, runs array<bigint>")


def templates(every: DataFrame) -> DataFrame:
    """``(host, met)``: of hosts that no task met as a whole the runs that stand in the share of its distinct articles, from ``compared`` rows."""
    near = by_host(every.where("runs is not null").select("host", F.explode("runs").alias("run")).distinct())
    rows = every.where("not whole and article")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [
                np.intersect1d(_runs(_article(_unpacked(p))), np.frombuffer(near, np.uint64)).view(np.int64)
                for p, near in zip(batch.column("packed").to_pylist(), batch.column("met").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("stream"), pa.array(runs, pa.list_(pa.int64()))], ["host", "stream", "runs"])

    met = map_batches(rows.join(near, "host").select("host", "stream", "packed", "met"), run, "host string, stream bigint, runs array<bigint>")
    n = rows.select("host", "stream").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    least = F.greatest(F.lit(RUN_PAGES), F.ceil(F.col("pages") * ARTICLE_SHARE))
    return by_host(counted(met).join(n, "host").where(F.col("n") >= least))


def by_host(runs: DataFrame) -> DataFrame:
    """``(host, met)``: all the runs of a host as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([np.array(r, np.int64).tobytes() for r in batch.column("runs").to_pylist()], pa.binary())], ["host", "met"])

    return map_batches(runs.groupBy("host").agg(F.collect_list("run").alias("runs")), run, "host string, met binary")


def counted(pages: DataFrame) -> DataFrame:
    """``(host, run, n)``: distinct pages of the host that have the run; pages that show the same count as one."""
    return pages.select("host", "stream", F.explode("runs").alias("run")).distinct().groupBy("host", "run").agg(F.count("*").alias("n"))


def repeated_runs(pages: DataFrame, least: int = RUN_PAGES) -> DataFrame:
    """``(host, run)``: the ranks outside main text that stand on ``least`` or more distinct pages of their host, from ``parsed`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [_runs([t for kind, t in _unpacked(p) if kind not in (MAIN, TEMPLATE)]).view(np.int64) for p in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("stream"), pa.array(runs, pa.list_(pa.int64()))], ["host", "stream", "runs"])

    each = map_batches(pages.select("host", "stream", "packed"), run, "host string, stream bigint, runs array<bigint>")
    return counted(each).where(F.col("n") >= least).select("host", "run")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages (page_id, url, html)``: page_id, url, text, n_chars.

    Text is the article's blocks joined by an empty line: character references decoded, white space inside a block one space.
    Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are dropped by element, role and
    class. A null or empty html, or one without text, gives ''. Repeated rows give repeated rows; other columns are ignored.

    Every page is parsed once, and the blocks of every page that may be text meet the suffix ranks of its host. Blocks in an
    article or main element are kept unless runs cover them that stand in at least half of the host's distinct articles, and in
    three (a notice inside every article, say); an article that would lose half of its words or more is a copy of others and keeps
    all. On pages without such an element the blocks of which the page says nothing are kept unless they are covered by runs that
    stand on three or more distinct pages of the host, in neutral blocks or in those marked as boilerplate. Runs are counted
    over the whole host; no task holds a large one.
    """
    every = store(compared(pages), "zstd")
    release(pages.sparkSession)
    done = every.where("article").select("page_id", "url", "host", "packed")
    if every.where("size(runs) > 0").limit(1).count():
        done = done.join(templates(every), "host", "left")
    else:
        done = done.withColumn("met", F.lit(None).cast("binary"))
    left = every.where("not article").select("row", "page_id", "url", "host", "stream", "packed")

    def articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for packed, met in zip(batch.column("packed").to_pylist(), batch.column("met").to_pylist(), strict=True):
                found = _unpacked(packed)
                if met:
                    found = without_template(found, np.frombuffer(met, np.uint64))
                texts.append("\n\n".join(t for kind, t in found if kind == MAIN))
            yield _result(batch.column("page_id"), batch.column("url"), texts)

    out = map_batches(done.select("page_id", "url", "packed", "met"), articles, _OUT)
    if not left.limit(1).count():
        return out
    known = repeated_runs(every.join(left.select("host").distinct(), "host", "left_semi"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_runs([t for kind, t in _unpacked(p) if kind == NEUTRAL]).view(np.int64) for p in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), pa.array(found, pa.list_(pa.int64()))], ["row", "host", "runs"])

    met = map_batches(left.select("row", "host", "packed"), own, "row bigint, host string, runs array<bigint>").select("row", "host", F.explode("runs").alias("run"))
    met = met.join(known, ["host", "run"]).groupBy("row").agg(F.collect_list("run").alias("met"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for packed, met in zip(batch.column("packed").to_pylist(), batch.column("met").to_pylist(), strict=True):
                own = [t for kind, t in _unpacked(packed) if kind == NEUTRAL]
                drop = covered(own, ranks(own), np.array(met or [], np.int64).view(np.uint64))
                texts.append("\n\n".join(t for t, d in zip(own, drop, strict=True) if not d))
            yield _result(batch.column("page_id"), batch.column("url"), texts)

    return out.unionByName(map_batches(left.join(met, "row", "left").select("page_id", "url", "packed", "met"), rest, _OUT))
