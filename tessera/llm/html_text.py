"""Main text of web pages, with boilerplate found by the runs that a host's pages share.

A page is cut into blocks of text. A block's place in the markup says what it most likely is: inside an article or a
main element (body), inside menus, headers, footers, sidebars, forms, notices, adverts or comments (chrome), or
neither (open). That is the prior; the host's pages decide the rest. Chrome blocks are dropped. Open blocks, with or
without body blocks beside them, lose the tokens of runs that stand on several distinct pages of the host, in chrome or
open blocks. Body blocks lose the tokens of runs that stand in the bodies of nearly all distinct pages of a host with
enough of them: articles quote each other, and only what almost every page says is the site's own. All else is kept.

Runs are those of MIN_RUN tokens; a longer repeated run is covered by the runs of that length in it. Bodies are dealt
by ranges of host and content, and a chunk's token streams are joined into one, whose suffix array gives the runs that
stand on most of the chunk's pages. A run on most of a host's pages is on most of some chunk's, so only such are added
up over the host; runs that the chunks' counts can't settle are counted again by name. Hosts of any size thus get exact
counts. Runs of open blocks are counted over whole hosts by the hash of host and run.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, joined_by_weight, mix64, pinned, shuffle_width, span_hashes, strings, word_spans

MIN_RUN = 8  # tokens of the shortest run that counts; a power of two
MIN_PAGES = 2
GROUP_PAGES = 256  # pages whose runs a task adds up before it gives them to the shuffle
BODY_PAGES = 20  # distinct pages of a host from which on runs in bodies are looked for
BODY_TENTHS = 8  # tenths of a host's distinct pages above which a run in bodies is the site's
CHUNK_TENTHS = 6  # tenths of a chunk's pages above which a run is reported
CHUNK_PAGES, CHUNK_TOKENS = 4096, 1 << 20

# Element names of HTML by what they do to text.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select option textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
CHROME = frozenset("nav header footer aside form dialog menu".split())
BODY = frozenset("article main".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var wbr ins del big strike".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEAD = frozenset("title meta link style script base noscript template".split())
WHOLE = frozenset("html body main".split())
#: Words of class, id and role values that mark what isn't main text; of an article's, only these.
ARTICLE_MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsored|promo|related|comments?)(?:$|[\s_-])", re.IGNORECASE)
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor|sponsored|promo|promoted|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|"
    r"footer|masthead|site-header|page-header|topbar|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|sharing|social|related|recommended|comments?|comment-list|disqus|replies|respond|widget|toolbar|search|complementary|contentinfo|dialog|alert|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
OPEN, IN_BODY, IN_CHROME = 0, 1, 2


def is_marked(element: str, attributes: str) -> bool:
    """Whether an element says of itself that it isn't main text; pages as a whole and their main parts can't."""
    if element in WHOLE or not attributes.strip():
        return False
    marks = ARTICLE_MARKS if element == "article" else MARKS
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name in ("class", "id", "role") and marks.search(html.unescape(next((v for v in values if v), ""))):
            return True
        if name == "aria-hidden" and "true" in values:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", " ".join(values)):
            return True
    return False


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(place, text) of each block with text, in page order; white space is one space, references are decoded."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # element, place of what it holds, whether text in it is dropped
    place, silent = OPEN, False

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((place, text))
            parts.clear()

    at = 0
    while at < len(page):
        found = TAG.search(page, at)
        if found is None:
            if not silent:
                parts.append(page[at:])
            break
        if found.start() > at and not silent:
            parts.append(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name not in INLINE:
                end_block()
            if depth is not None:
                if any(s[1] != place or s[2] != silent for s in stack[depth - 1 : depth] or [("", OPEN, False)]):
                    end_block()
                del stack[depth:]
                place, silent = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
            continue
        if name not in HEAD and any(e[0] == "head" for e in stack):  # an element of the body ends the head
            end_block()
            del stack[next(i for i, e in enumerate(stack) if e[0] == "head") :]
            place, silent = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
        marked = is_marked(name, found[3])
        hides = name in SILENT
        if name not in INLINE or marked or hides:
            end_block()
        if name in VOID:
            continue
        if name in CLOSES_P and stack and any(s[0] == "p" for s in stack):
            depth = max(i for i, s in enumerate(stack) if s[0] == "p")
            if all(s[0] in INLINE or s[0] == "p" for s in stack[depth:]):
                del stack[depth:]
                place, silent = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
            continue
        within = IN_CHROME if marked or name in CHROME or place == IN_CHROME else IN_BODY if name in BODY else place
        if found[3].endswith("/") and name not in INLINE and name in ("svg", "math"):
            continue
        stack.append((name, within, silent or hides))
        place, silent = within, silent or hides
    end_block()
    return out


def repeated_suffixes(tokens: np.ndarray, page: np.ndarray, stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, their groups, distinct pages of each group); suffixes of a group share their first depth tokens.

    The suffix array is sorted by prefix doubling, which is stopped at depth, a power of two. Runs stay inside a stream.
    """
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n < depth:
        return none, none, none
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < depth:
        ahead = np.full(n, -1, np.int64)
        ahead[:-length] = rank[length:]
        rank = np.unique(rank * (n + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        length *= 2
    usable = np.flatnonzero(stream[: n - depth + 1] == stream[depth - 1 :])
    order = usable[np.lexsort((page[usable], rank[usable]))]
    if not len(order):
        return none, none, none
    new_rank = np.concatenate([[True], rank[order[1:]] != rank[order[:-1]]])
    new_page = new_rank | np.concatenate([[True], page[order[1:]] != page[order[:-1]]])
    group = np.cumsum(new_rank) - 1
    return order, group, np.bincount(group[new_page])


def covered_by(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n tokens lie in a run of length tokens from one of starts."""
    steps = np.zeros(n + length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:n]) > 0


def covered_tokens(tokens: np.ndarray, page: np.ndarray, stream: np.ndarray, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> np.ndarray:
    """Which tokens lie in a run of min_run tokens or more that stands on min_pages distinct pages or more."""
    order, group, pages = repeated_suffixes(tokens, page, stream, min_run)
    return covered_by(order[pages[group] >= min_pages] if len(order) else order, len(tokens), min_run)


def page_text(blocks: list[tuple[int, str]], covered: np.ndarray, in_body: np.ndarray) -> str:
    """Main text of a page: what isn't covered of its body and its open blocks. covered has its tokens outside the body, in_body those inside.

    A body that is covered whole is what the page has to say, and stays.
    """
    kept, at, body_at = [], 0, 0
    spared = len(in_body) > 0 and bool(in_body.all())
    for place, text in blocks:
        if place == IN_BODY and (spared or not len(in_body)):
            kept.append(text)
            continue
        tokens = text.split(" ")
        if place == IN_BODY:
            marks, body_at = in_body[body_at : body_at + len(tokens)], body_at + len(tokens)
        else:
            marks, at = covered[at : at + len(tokens)], at + len(tokens)
        if place != IN_CHROME:
            unique = " ".join(w for w, c in zip(tokens, marks, strict=True) if not c)
            if unique:
                kept.append(unique)
    return " ".join(kept)


def streams_of(blocks: list[tuple[int, str]], inside: bool = False) -> tuple[list[str], list[int], list[int]]:
    """(tokens, stream, place) outside the body, or inside it; what stands next to each other in one place is one stream, so runs can go on across blocks."""
    words: list[str] = []
    streams: list[int] = []
    places: list[int] = []
    stream, last = 0, None
    for place, text in blocks:
        if (place == IN_BODY) == inside:
            tokens = text.split(" ")
            stream += last != place
            words += tokens
            streams += [stream] * len(tokens)
            places += [place] * len(tokens)
        last = place
    return words, streams, places


def main_texts(pages: list[list[tuple[int, str]]], min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, body_pages: int = BODY_PAGES) -> list[str]:
    """Main texts of one host's pages, which are distinct, from their blocks."""
    with_body = sum(any(place == IN_BODY for place, _ in blocks) for blocks in pages)
    found = []
    for inside, least in ((False, min_pages), (True, with_body * BODY_TENTHS // 10 + 1)):
        codes: dict[str, int] = {}
        numbers: list[int] = []
        page_of: list[int] = []
        stream_of: list[int] = []
        ends = [0]
        for p, blocks in enumerate(pages):
            words, streams, _ = streams_of(blocks, inside)
            first = stream_of[-1] + 1 if stream_of else 0
            numbers += [codes.setdefault(w, len(codes)) for w in words]
            page_of += [p] * len(words)
            stream_of += [first + x for x in streams]
            ends.append(len(numbers))
        covered = covered_tokens(np.array(numbers, np.int64), np.array(page_of, np.int64), np.array(stream_of, np.int64), min_run, least)
        if inside and with_body < body_pages:
            covered[:] = False
        found.append([covered[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)])
    return [page_text(blocks, outside, inside) for blocks, outside, inside in zip(pages, *found, strict=True)]


def token_hashes(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]))
    return span_hashes(raw, starts, ends)


def hashed_runs(tokens: np.ndarray, at: np.ndarray, host: int, min_run: int) -> np.ndarray:
    """Hashes of the runs of min_run tokens from at on, given the tokens' hashes; equal runs of other hosts hash otherwise."""
    whole = np.full(len(at), host & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(min_run):
        whole += tokens[at + k] * np.uint64(pow(_BASE, 2 * k + 3, 1 << 64))
    return mix64(whole).view(np.int64)


def run_hashes(blocks: list[tuple[int, str]], host: int, min_run: int, inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first token, whether open) of each run of min_run tokens outside the body, or inside it."""
    words, streams, places = streams_of(blocks, inside)
    n = len(words) - min_run + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    stream = np.array(streams, np.int64)
    at = np.flatnonzero(stream[:n] == stream[min_run - 1 :])
    return hashed_runs(token_hashes(words), at, host, min_run), at, np.array(places, np.int64)[at] == OPEN


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def covered_runs(rows: DataFrame, min_run: int, min_pages: int, group_pages: int) -> DataFrame:
    """(run) of the runs in open blocks that stand on min_pages distinct pages or more: pages of other contents and other ids.

    A task gives one row for each run of group_pages pages. With two pages enough, these hold the smallest and the
    largest page, and a run that all of a hot host's pages have comes to the shuffle as one row a task.
    """
    two = min_pages == 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            runs, content, page, is_open = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(runs, kind="stable") if two else np.lexsort((page, content, runs))
            runs, content, page, is_open = runs[order], content[order], page[order], is_open[order]
            first = np.ones(len(runs), bool)
            first[1:] = runs[1:] != runs[:-1]
            if not two:
                first[1:] |= (content[1:] != content[:-1]) | (page[1:] != page[:-1])
            at = np.flatnonzero(first)
            if not len(at):
                columns = [runs, content, content, page, page, is_open]
            else:
                columns = [runs[at], *[f.reduceat(c, at) for c in (content, page) for f in (np.minimum, np.maximum)], np.logical_or.reduceat(is_open, at)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["run", "content", "content_high", "page", "page_high", "open"])

        for batch in batches:
            hosts, contents, ids = (batch.column(c).to_pylist() for c in ("host_key", "content", "page_key"))
            sources = strings(batch, "html")
            for row, host in enumerate(hosts):
                runs, _, is_open = run_hashes(blocks_of(sources[row].as_py()), host, min_run)
                held.append((runs, np.full(len(runs), contents[row], np.int64), np.full(len(runs), ids[row], np.int64), is_open))
                if len(held) >= group_pages:
                    yield flush()
        if held:
            yield flush()

    found = rows.select("host_key", "content", "page_key", "html").mapInArrow(run, "run long, content long, content_high long, page long, page_high long, open boolean").groupBy("run")
    if two:
        several = found.agg(F.min("content").alias("c"), F.max("content_high").alias("d"), F.min("page").alias("p"), F.max("page_high").alias("q"), F.max("open").alias("open")).where("c != d AND p != q")
    else:
        several = found.agg(F.count_distinct("content").alias("c"), F.count_distinct("page").alias("p"), F.max("open").alias("open")).where(F.least("c", "p") >= min_pages)
    return several.where("open").select("run")


def covered_places(rows: DataFrame, covered: DataFrame, min_run: int) -> DataFrame:
    """(host_key, content, runs): the first tokens of the covered runs in the open blocks of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, contents = (batch.column(c).to_pylist() for c in ("host_key", "content"))
            sources = strings(batch, "html")
            for row, host in enumerate(hosts):
                runs, at, is_open = run_hashes(blocks_of(sources[row].as_py()), host, min_run)
                if is_open.any():
                    runs, at = runs[is_open], at[is_open]
                    columns = [np.full(len(runs), host, np.int64), np.full(len(runs), contents[row], np.int64), runs, at]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["host_key", "content", "run", "at"])

    # both sides of the join come from a shuffle of their own, so that a run of very many pages can be split
    places = rows.select("host_key", "content", "html").mapInArrow(run, "host_key long, content long, run long, at long")
    return places.join(covered, "run").groupBy("host_key", "content").agg(F.collect_set("at").alias("runs"))


def chunk_runs(rows: DataFrame, min_run: int, chunk_pages: int, chunk_tokens: int) -> DataFrame:
    """(host_key, run, pages, of, n): for each chunk of a host's distinct pages with a body, the runs on most of them.

    pages counts those with the run, and `of` the chunk's. A row without a run says how many table rows the chunk stands for.
    """
    names = ["host_key", "run", "pages", "of", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        host = content = None
        tokens = count = 0

        def flush() -> pa.RecordBatch:
            nonlocal tokens, count
            runs = pages = np.zeros(0, np.int64)
            if held:
                whole = np.concatenate([h for h, _ in held])
                page = np.repeat(np.arange(len(held)), [len(h) for h, _ in held])
                stream = np.concatenate([s for _, s in held]) + page * (int(max(s.max() for _, s in held)) + 1)
                order, group, pages = repeated_suffixes(whole, page, stream, min_run)
                if len(order):
                    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                    some = np.flatnonzero(10 * pages > CHUNK_TENTHS * len(held))
                    runs, pages = hashed_runs(whole, order[first[some]], host, min_run), pages[some]
            columns = [[host] * (len(runs) + 1), [None, *runs.tolist()], [0, *pages.tolist()], [len(held)] * (len(runs) + 1), [count] + [0] * len(runs)]
            held.clear()
            tokens = count = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            hosts, contents = (batch.column(c).to_pylist() for c in ("host_key", "content"))
            sources = strings(batch, "html")
            for row, here in enumerate(hosts):
                if count and (here != host or len(held) >= chunk_pages or tokens >= chunk_tokens):
                    yield flush()
                count += 1
                if here == host and contents[row] == content:
                    continue
                host, content = here, contents[row]
                words, streams, _ = streams_of(blocks_of(sources[row].as_py()), inside=True)
                if words:
                    held.append((token_hashes(words), np.array(streams, np.int64)))
                    tokens += len(words)
        if count:
            yield flush()

    parts = shuffle_width(rows.sparkSession)
    # ranges keep a host's pages together, and cut large hosts
    dealt = rows.select("host_key", "content", "html").repartitionByRange(parts, "host_key", "content").sortWithinPartitions("host_key", "content")
    return dealt.mapInArrow(run, "host_key long, run long, pages long, of long, n long")


def body_runs(rows: DataFrame, min_run: int, body_pages: int, chunk_pages: int = CHUNK_PAGES, chunk_tokens: int = CHUNK_TOKENS) -> tuple[DataFrame, bool]:
    """(host_key, n, body_runs) of all hosts, with the runs that more than BODY_TENTHS tenths of their distinct pages have in the body; and whether there are any.

    A host has fewer such runs than its pages have tokens, on average, and a quarter more.
    """
    found = pinned(chunk_runs(rows, min_run, chunk_pages, chunk_tokens))
    sizes = pinned(found.where("run IS NULL").groupBy("host_key").agg(F.sum("of").alias("all"), F.sum("n").alias("n")))
    sums = found.where("run IS NOT NULL").groupBy("host_key", "run").agg(F.sum("pages").alias("pages"), F.sum("of").alias("of"))
    # chunks that don't report a run have it on CHUNK_TENTHS tenths of their pages at most
    most = F.col("pages") * 10 + (F.col("all") - F.col("of")) * CHUNK_TENTHS
    near = pinned(sums.join(sizes.where(F.col("all") >= body_pages), "host_key").where(most > F.col("all") * BODY_TENTHS))
    certain = F.col("pages") * 10 > F.col("all") * BODY_TENTHS
    sure = near.where(certain).select("host_key", "run")
    unsure = near.where(~certain & (F.col("of") < F.col("all"))).select("host_key", "run", "all")
    if unsure.take(1):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hosts, contents = (batch.column(c).to_pylist() for c in ("host_key", "content"))
                sources = strings(batch, "html")
                for row, host in enumerate(hosts):
                    runs = np.unique(run_hashes(blocks_of(sources[row].as_py()), host, min_run, inside=True)[0])
                    columns = [np.full(len(runs), host, np.int64), np.full(len(runs), contents[row], np.int64), runs]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["host_key", "content", "run"])

        pages = rows.select("host_key", "content", "html").join(unsure.select("host_key").distinct(), "host_key", "left_semi")
        each = pages.mapInArrow(run, "host_key long, content long, run long").join(unsure, ["host_key", "run"]).distinct()
        counted = each.groupBy("host_key", "run").agg(F.count("*").alias("pages"), F.first("all").alias("all")).where(certain)
        sure = pinned(sure.unionByName(counted.select("host_key", "run")))
    lists = sure.groupBy("host_key").agg(F.collect_set("run").alias("body_runs"))
    return pinned(sizes.select("host_key", "n").join(lists, "host_key", "left")), bool(sure.take(1))


def extract(
    pages: DataFrame, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, group_pages: int = GROUP_PAGES, body_pages: int = BODY_PAGES, chunk_pages: int = CHUNK_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) for each page; the text is empty if there is none.

    A null html counts as empty; pages without a readable host count as of one host; null ids are kept. Rows of one id
    count as one page of their host, and so do rows of one content. An empty table gives no rows; other columns are
    ignored. Html is shuffled once for the bodies' runs, and again only where runs are to be taken out.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host_key", F.xxhash64(host_of("url"))).withColumn("content", F.xxhash64("html"))
    # a page without an id is told from others by its content
    keyed = rows.withColumn("page_key", F.when(F.col("page_id").isNull(), F.col("content")).otherwise(F.xxhash64("page_id")))
    covered = pinned(covered_runs(keyed, min_run, min_pages, group_pages))
    hosts, some = body_runs(rows, min_run, body_pages, chunk_pages)
    if covered.take(1):
        marks = pinned(covered_places(rows, covered, min_run))
        rows = rows.join(marks, ["host_key", "content"], "left")
    else:
        rows = rows.withColumn("runs", F.lit(None).cast("array<bigint>"))
    if some:
        rows = joined_by_weight(rows, hosts, "host_key", "n")
    else:
        rows = rows.withColumn("body_runs", F.lit(None).cast("array<bigint>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, marks, own, hosts = strings(batch, "html"), batch.column("runs"), batch.column("body_runs"), batch.column("host_key").to_pylist()
            texts = []
            for row in range(batch.num_rows):
                blocks = blocks_of(sources[row].as_py())
                covered = np.zeros(sum(text.count(" ") + 1 for place, text in blocks if place != IN_BODY), bool)
                for at in marks[row].as_py() or ():
                    covered[at : at + min_run] = True
                in_body = np.zeros(0, bool)
                if own[row].is_valid:
                    runs, at, _ = run_hashes(blocks, hosts[row], min_run, inside=True)
                    in_body = covered_by(at[np.isin(runs, own[row].values.to_numpy())], sum(text.count(" ") + 1 for place, text in blocks if place == IN_BODY), min_run)
                texts.append(page_text(blocks, covered, in_body))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host_key", "runs", "body_runs").mapInArrow(run, "page_id long, url string, text string, n_chars long")
