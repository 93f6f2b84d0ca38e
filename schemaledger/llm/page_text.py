"""Main text of web pages: what a page says about its parts, and a host suffix array for the rest.

A page becomes blocks of text with a zone: ``article`` inside an article or main element; ``junk`` inside navigation,
headers, footers, sidebars, forms, hidden parts and elements named as nothing else; ``doubt`` and ``doubt article`` where
only a part of a class name or id speaks against a block (``post-comments``); ``open`` elsewhere. Names such as ``no-sidebar``
or ``has-comments`` say nothing. Doubtful blocks go while the page has other text, so names never empty an article.

The suffixes of the host's pages tell the rest: every place of their whole token streams, articles included, is a suffix, keyed
by the hash of its first ``RUN`` tokens. Suffixes of one key form one stretch of the host's suffix array; a stretch with
suffixes of distinct pages is a repeated substring, longer ones being unions of shorter.

What a page without article leaves open loses all that repeated substrings cover, and the unique runs stay. In an article
repeats alone say little, as pages of one host may be copies of each other. There a block goes if substrings that more than half
of the host's pages hold cover it whole: a notice of the site. An article that is mostly such blocks is a copy and stays whole.

Pages of every host with ``LEAST_PAGES`` pages are searched for such substrings. A run that most pages of a host hold is held by
most of the host's pages in at least one batch of pages, so batches name their own and only named runs are counted over the
host. Where many pages stand alone beside those of other hosts, texts are dealt by host for the naming. The stretches are spread
over tasks by host and key, so a host of any size is compared whole and none meets in one task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import BROADCAST_ROWS, broadcast_if_small, written
from . import words as W
from .url_rules import host_of

RUN = 8  # tokens of the shortest repeated substring
LEAST_PAGES = 10  # pages of a host whose most common substrings are notices

_MOST_ALONE = 10_000  # pages with too few others of their host beside them, from which pages are dealt by host
_TOGETHER = 4_000  # pages of a partition and most of a host in one, where they are dealt by host

_RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object|select|button|canvas|audio|video"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_NESTED = _BLOCKS - {"p", "hr", "html", "body"}
_JUNK_TAGS = frozenset("nav footer aside form dialog menu".split())
_JUNK_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar note".split())
_JUNK_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal newsletter subscribe comment comments "
    "reply replies respond related share sharing social".split())
_STATE_NAMES = frozenset("no not has is with without less free open closed enabled disabled".split())
_ATTRIBUTE = re.compile(r"(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z0-9]+")


def _verdict_of_names(names: list[str]) -> str:
    """``junk`` if all class names or ids say nothing else, ``doubt`` if a part of one does, else an empty string."""
    parts = [p for p in map(_NAME.findall, names) if p]
    voting = [p for p in parts if not _JUNK_NAMES.isdisjoint(p) and _STATE_NAMES.isdisjoint(p)]
    if not voting:
        return ""
    return "junk" if len(voting) == len(parts) and all(_JUNK_NAMES.issuperset(p) for p in voting) else "doubt"


def _zone_inside(tag: str, attributes: str, zone: str) -> str:
    """The zone inside an element that opens in ``zone``."""
    in_article = zone.endswith("article")
    if zone == "junk" or tag in _JUNK_TAGS or (tag == "header" and not in_article):
        return "junk"
    names: list[str] = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = (a or b or c).lower()
        if name.lower() == "hidden" or (name.lower() == "role" and value.strip() in _JUNK_ROLES):
            return "junk"
        if name.lower() in ("class", "id"):
            names += value.split()
    if tag == "main":
        return "article"
    said = _verdict_of_names(names)
    if tag == "article" and not in_article:
        return "doubt article" if said or zone == "doubt" else "article"
    if said == "junk":
        return "junk"
    if said == "doubt" or zone.startswith("doubt"):
        return "doubt article" if in_article else "doubt"
    return zone


def page_blocks(page: str | None) -> list[tuple[str, str]]:
    """``(zone, text)`` of the blocks of a page in page order; character references decoded, white space collapsed.

    An article or main element adds a block without text, so that an empty article is seen too.
    """
    out: list[tuple[str, str]] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []  # open nested elements and the zone inside them
    zone, held, at = "open", [], 0

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((zone, text))
        held.clear()

    for found in _MARKUP.finditer(page):
        if found.start() > at:
            held.append(page[at: found.start()])
        at = found.end()
        tag = found[3].lower() if found[3] else ""
        if tag == "br":
            held.append(" ")
        if tag not in _BLOCKS:
            continue
        close()
        if tag == "body":
            stack, zone = [], "open"
        elif tag in _NESTED:
            if found[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif not found[4].endswith("/"):
                inside = _zone_inside(tag, found[4], zone)
                if tag in ("article", "main") and inside != "junk":
                    out.append((inside, ""))
                stack.append((tag, inside))
            zone = stack[-1][1] if stack else "open"
    held.append(page[at:])
    close()
    return out


def settled_zone(blocks: list[tuple[str, str]]) -> str | None:
    """The zone that is the text of a page by its own marks (an empty string: none is); None if its host has to tell."""
    zones = {zone for zone, text in blocks if text}
    for zone in ("article", "doubt article"):
        if zone in zones:
            return zone
    return None if zones & {"open", "doubt"} else ""


def page_runs(blocks: list[tuple[str, str]]) -> np.ndarray:
    """Keys of the suffixes of a page's token stream that hold ``RUN`` tokens: hashes of their first ``RUN`` tokens."""
    stream = " ".join(text for _, text in blocks if text)
    if stream.count(" ") + 1 < RUN:
        return np.zeros(0, np.uint64)
    return W.hashed_runs([stream.encode("utf-8", "surrogatepass")], RUN)[0]


def unique_text(blocks: list[tuple[str, str]], repeated: np.ndarray) -> str:
    """Text of a page without article: its open blocks less what repeated runs cover; doubtful ones if it has no others."""
    starts = np.flatnonzero(np.isin(page_runs(blocks), repeated))
    change = np.zeros(sum(text.count(" ") + 1 for _, text in blocks if text) + 1, np.int64)
    change[starts] += 1
    change[starts + RUN] -= 1
    covered = (np.cumsum(change) > 0).tolist()
    has_article = any(zone.endswith("article") for zone, _ in blocks)
    wanted = "open" if has_article or any(zone == "open" and text for zone, text in blocks) else "doubt"
    out, at = [], 0
    for zone, text in blocks:
        tokens = text.split(" ") if text else []
        own, at = covered[at: at + len(tokens)], at + len(tokens)
        kept = " ".join(t for t, gone in zip(tokens, own) if not gone) if zone == wanted else ""
        if kept:
            out.append(kept)
    return "\n".join(out)


def block_starts(texts: list[str]) -> tuple[list[int], list[bytes]]:
    """Blocks of at least ``RUN`` tokens and their first ``RUN`` tokens."""
    heads = [(i, text.split(" ", RUN)[:RUN]) for i, text in enumerate(texts)]
    long = [(i, " ".join(head).encode("utf-8", "surrogatepass")) for i, head in heads if len(head) == RUN]
    return [i for i, _ in long], [head for _, head in long]


def article_text(texts: list[str], begun: list[int], common: np.ndarray) -> str:
    """Text of an article's blocks, less those that ``common`` runs within them cover whole if these are under half of it.

    ``begun`` are the blocks whose first run is common; no other can be covered.
    """
    sizes = np.array([text.count(" ") + 1 for text in texts], np.int64)
    notice = np.zeros(len(texts), bool)
    keys, counts = W.hashed_runs([texts[i].encode("utf-8", "surrogatepass") for i in begun], RUN)
    held = np.isin(keys, common)
    for i, own in zip(begun, np.split(held, np.cumsum(counts)[:-1])):
        notice[i] = own[0] and own[-1] and bool((np.diff(np.flatnonzero(own)) <= RUN).all())
    if 2 * sizes[notice].sum() >= sizes.sum():
        notice[:] = False
    return "\n".join(text for text, gone in zip(texts, notice.tolist()) if not gone)


_BLOCKS_KIND = pa.list_(pa.struct([("zone", pa.string()), ("text", pa.string())]))


def _pairs(blocks: list[dict]) -> list[tuple[str, str]]:
    return [(b["zone"], b["text"]) for b in blocks]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 64):
            part = batch.slice(begin, 64)
            pages = [page_blocks(page) for page in part.column(2).to_pylist()]
            settled = pa.array(map(settled_zone, pages), pa.string())
            blocks = pa.array([[{"zone": z, "text": t} for z, t in page] for page in pages], _BLOCKS_KIND)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), settled, blocks], ["page_id", "url", "settled", "blocks"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of each page's suffixes, page by page."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys = np.unique(page_runs(_pairs(batch.column(2)[i].as_py()))).view(np.int64)
            if len(keys):
                at = pa.array(np.full(len(keys), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (0, 1, 3)), pa.array(keys)], ["row", "host", "page", "run"])


def _runs_of(column: pa.ListArray, i: int) -> np.ndarray:
    return column.values[column.offsets[i].as_py(): column.offsets[i + 1].as_py()].to_numpy().view(np.uint64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the pages of each host in a batch: how many rows hold them, and if these are most rows of the host there.

    A third column names the runs to count.
    """
    for batch in batches:
        hosts = batch.column(0).dictionary_encode()
        codes = hosts.indices.to_numpy(zero_copy_only=False)
        streams = batch.column(1).to_pylist()
        long = np.array([i for i, stream in enumerate(streams) if stream.count(b" ") + 1 >= RUN], np.int64)
        keys, of_host = [np.zeros(0, np.uint64)], [np.zeros(0, codes.dtype)]
        for begin in range(0, len(long), 64):
            part = long[begin: begin + 64]
            runs, counts = W.shingle_sets([streams[i] for i in part], RUN)
            at = np.repeat(codes[part], counts)
            if batch.num_columns == 3:
                pieces = zip(np.split(runs, np.cumsum(counts)[:-1]), part)
                asked = np.concatenate([np.isin(own, _runs_of(batch.column(2), i)) for own, i in pieces])
                runs, at = runs[asked], at[asked]
            keys.append(runs)
            of_host.append(at)
        key, host = np.concatenate(keys), np.concatenate(of_host)
        order = np.lexsort((key, host))
        key, host = key[order], host[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (host[1:] != host[:-1])))) if len(key) else np.zeros(0, np.int64)
        n = np.diff(first, append=len(key))
        often = 2 * n > np.bincount(codes)[host[first]]
        for begin in range(0, len(first), 1 << 16):
            cut = slice(begin, begin + (1 << 16))
            at = first[cut]
            yield pa.RecordBatch.from_arrays(
                [hosts.dictionary.take(pa.array(host[at])), pa.array(key[at].view(np.int64)), pa.array(n[cut]), pa.array(often[cut])],
                ["host", "run", "n", "often"])


def _state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for begin in range(0, batch.num_rows, 64):
            pages = batch.column(2).slice(begin, 64).to_pylist()
            starts = [block_starts(texts) for texts in pages]
            keys = W.hashed_runs([head for _, heads in starts for head in heads], RUN)[0]
            pieces = np.split(keys, np.cumsum([len(long) for long, _ in starts])[:-1])
            for i, (texts, (long, _), own) in enumerate(zip(pages, starts, pieces), begin):
                common = _runs_of(batch.column(3), i)
                begun = np.array(long, np.int64)[np.isin(own, common)].tolist()
                out.append(article_text(texts, begun, common) if begun else "\n".join(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            unique_text(_pairs(blocks), np.array(repeated or [], np.int64).view(np.uint64))
            for blocks, repeated in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _by_host(runs: DataFrame) -> DataFrame:
    """``host, runs``, marked for broadcast if all hosts together have few runs."""
    lists = runs.groupBy("host").agg(F.collect_list("run").alias("runs"))
    return F.broadcast(lists) if runs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lists


def common_runs(parsed: DataFrame) -> DataFrame:
    """``host, run``: runs that more than half of the rows of a host with at least ``LEAST_PAGES`` rows hold."""
    hosts = broadcast_if_small(parsed.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES))
    texts = F.filter("blocks.text", lambda text: text != "")
    streams = parsed.join(hosts, "host").select("host", "row", "pages", F.array_join(texts, " ").cast("binary").alias("stream"))
    kind = "host string, run long, n long, often boolean"
    beside = parsed.groupBy("host", F.spark_partition_id().alias("part")).agg(F.count("*").alias("rows")).where(F.col("rows") < LEAST_PAGES)
    together = streams
    if (beside.join(hosts, "host", "left_semi").agg(F.sum("rows")).first()[0] or 0) > _MOST_ALONE:
        together = streams.repartition(parsed.count() // _TOGETHER + 1, "host", F.expr(f"pmod(row, pages div {_TOGETHER} + 1)"))
    named = written(together.select("host", "stream").mapInArrow(_counted, kind).where("often").select("host", "run").distinct())
    held = streams.join(_by_host(named), "host").select("host", "stream", "runs").mapInArrow(_counted, kind)
    return written(held.groupBy("host", "run").agg(F.sum("n").alias("n")).join(hosts, "host").where("2 * n > pages").select("host", "run"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for each row of ``pages``; an empty text if a page has none.

    Null and empty pages have an empty text. Pages without a host (null or scheme-less URLs) are one host. Repeated rows
    come back as often as they came and are one page, but count each among the rows of which most hold a notice; equal pages of
    distinct ids or URLs cover each other's open text. Blocks of fewer than ``RUN`` tokens are never notices in an article.
    Other columns are not read. Keys of runs have 64 bits; nothing compares the tokens behind them.
    """
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    id_type = given.schema["page_id"].dataType.simpleString()
    parsed = written(
        given.mapInArrow(_parse, f"page_id {id_type}, url string, settled string, blocks array<struct<zone:string,text:string>>")
        .withColumns({"row": F.monotonically_increasing_id(), "host": host_of(F.col("url")), "page": F.xxhash64("page_id", "url")})
    )
    asking = parsed.where("settled IS NULL")
    suffixes = (
        parsed.join(broadcast_if_small(asking.select("host").distinct()), "host", "left_semi").select("row", "host", "blocks", "page")
        .mapInArrow(_suffixes, "row long, host string, page long, run long")
    )
    shared = suffixes.groupBy("host", "run").agg(F.min("page").alias("least"), F.max("page").alias("most")).where("least <> most")
    covered = (
        suffixes.join(asking.select("row"), "row", "left_semi").join(shared, ["host", "run"], "left_semi")
        .groupBy("row").agg(F.collect_list("run").alias("repeated"))
    )
    told = (
        asking.join(covered, "row", "left").select("page_id", "url", "blocks", "repeated")
        .mapInArrow(_settle, f"page_id {id_type}, url string, text string")
    )
    settled = parsed.where("settled IS NOT NULL").join(_by_host(common_runs(parsed)), "host", "left")
    own = F.filter("blocks", lambda b: (b["zone"] == F.col("settled")) & (b["text"] != ""))["text"]
    whole = settled.where("runs IS NULL OR settled = ''").select("page_id", "url", F.array_join(own, "\n").alias("text"))
    stated = (
        settled.where("runs IS NOT NULL AND settled <> ''").select("page_id", "url", own.alias("texts"), "runs")
        .mapInArrow(_state, f"page_id {id_type}, url string, text string")
    )
    return whole.unionByName(stated).unionByName(told)
