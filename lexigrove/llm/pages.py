"""Main text of HTML pages, with a suffix array per host.

A page is read into blocks by its markup. Blocks of menus, headers, footers, sidebars, notices, adverts, forms, scripts
and comments are template, blocks inside an article or main element are its author's text, the others are loose. The
template and loose blocks of a host's pages are concatenated as token streams; in their suffix array, suffixes that
agree for ``RUN`` tokens lie together, and tokens of runs that distinct pages share are covered. A page without an article
yields the uncovered runs of its loose blocks.

A page with an article yields the uncovered runs of its article blocks. A host's distinct articles have suffix arrays of
their own, as a passage that two articles share is text: a run inside a block is covered there if at least ``LEAST`` articles hold it and
``SPREAD`` of all. Articles of which such runs are ``COPIED`` or more are versions of one text: they neither count nor lose
anything. Shards propose the runs that reach ``SPREAD`` among their own articles, as each run that reaches it on the host
does in at least one shard; proposed runs are then counted over all shards.

A host of more than ``SHARD_TOKENS`` tokens is dealt by page into shards of about that size. Its shards exchange 64-bit
fingerprints of their runs, one row a run and shard, so runs that only pages of different shards share are covered too.

Null and empty pages have an empty text. Unclosed and misnested tags are closed where HTML would. Repeated rows are
one page as far as sharing goes and each gets its text. Ids may repeat or be null. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import NON_SPACE, Words, arrow_map, mix64, release, staged, text_steps

RUN = 8
#: When a run inside articles is boilerplate: articles of the host that hold it, as a number and a share.
LEAST, SPREAD = 5, 0.75
#: Share of an article's tokens from which on what others hold too makes it a version of them.
COPIED = 0.75
SHARD_TOKENS = 1_000_000
#: The word between an article's blocks, and its hash. Its token is 0; other words have 24-bit ones.
_GAP = "\x00"
_GAP_HASH = Words(np.zeros(1, np.uint8), np.array([0, 1]), NON_SPACE).hashes()[0]
_MUL = np.uint64(0xD6E8FEB86659FD93)

#: Element names by role, and words of class, id or role attributes that mark template.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select".split())
TEMPLATE = frozenset("head title nav header footer aside form button menu dialog".split()) | RAW
MAIN = frozenset(["article", "main"])
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banner|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|header|masthead|footer|copyright|comments?|replies|disqus|share|sharing|social|related|recommended|widget|login|signup|search|contentinfo|complementary)(?:$|[\s_-])")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARK = re.compile(r"(?i)(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?i)(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true)")
_CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _marked(attrs: str) -> bool:
    return bool(attrs) and (any(MARKS.search(a or b or c or "") for a, b, c in _MARK.findall(attrs)) or bool(_HIDDEN.search(attrs)))


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(kind, text) in page order; kind is 'main', 'loose' or 'template'."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # element, kind inside it
    piece: list[str] = []
    kind = "loose"

    def flush() -> None:
        if piece:
            text = " ".join(html_module.unescape("".join(piece)).split())
            if text:
                out.append((kind, text))
            piece.clear()

    def back(to: int) -> None:
        nonlocal kind
        del stack[to:]
        kind = stack[-1][1] if stack else "loose"

    at, n = 0, len(page)
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS or name in TEMPLATE:
            flush()
        elif name == "br":
            piece.append(" ")
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None:
                back(k)
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(f"(?ai)</{name}").search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else n
            continue
        if name in _CLOSES and stack and stack[-1][0] in _CLOSES[name]:
            back(len(stack) - 1)
        elif name == "p" or name in BLOCKS:
            # An open paragraph ends at the next block; inline elements left open inside it end too.
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), None)
            if k is not None and stack[k][0] == "p":
                back(k)
        if name in MAIN and not _marked(m[3]):
            # A menu or header left open does not hold the article; a comment or sidebar does.
            while stack and stack[-1][1] == "template" and stack[-1][0] in ("head", "title", "nav", "header", "form", "menu", "ul", "li", "a"):
                stack.pop()
            inside = stack[-1][1] if stack else "loose"
            new = "template" if inside == "template" else "main"
        elif kind == "template" or _marked(m[3]):
            new = "template"
        elif name in TEMPLATE:
            new = "main" if kind == "main" and name == "header" else "template"
        else:
            new = kind
        stack.append((name, new))
        kind = new
    if at < n:
        piece.append(re.sub(r"<[a-zA-Z/!][^<]*\Z", "", page[at:]))
    flush()
    return out


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, r1 (row key), host, main, loose, template (arrays of block texts)."""
    types = [pa.list_(pa.string())] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                rows = []
                for page in part.column(part.num_columns - 1).to_pylist():
                    found = blocks_of(page or "")
                    rows.append([[t for k, t in found if k == kind] for kind in ("main", "loose", "template")])
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=["page_id", "url", "r1", "host", "main", "loose", "template"])

    u, h = F.col(f"`{url}`"), F.col(f"`{html}`")
    host = F.coalesce(F.regexp_extract(F.lower(u), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    chosen = pages.select(F.col(f"`{page_id}`").alias("page_id"), u.alias("url"), F.xxhash64(F.col(f"`{page_id}`"), u, h).alias("r1"), host.alias("host"), h.alias("html"))
    d = chosen.schema
    return arrow_map(chosen, run, f"page_id {d['page_id'].dataType.simpleString()}, url string, r1 long, host string, main array<string>, loose array<string>, template array<string>")


def _sorted_runs(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of all streams by their first ``run`` tokens: places in order, where groups of equal ones begin, each place's stream, bounds of the streams."""
    sizes = np.array([len(s) for s in streams], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    ids = np.unique(np.concatenate([x for s in streams for x in (s, np.zeros(1, np.uint64))]), return_inverse=True)[1].astype(np.int64)
    # A separator of its own ends each stream, so no run crosses streams.
    ids[bounds[1:] - 1] = ids.max() + 1 + np.arange(len(streams))
    n, rank, step = len(ids), ids, 1
    while step < run:
        second = np.zeros(n, np.int64)
        reach = min(step, run - step)
        second[: n - reach] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        step += reach
    order = np.argsort(rank, kind="stable")
    group = rank[order]
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return order, new, np.repeat(np.arange(len(streams)), sizes + 1), bounds


def shared_tokens(streams: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """Per stream, which tokens lie in a run of ``run`` tokens that another stream has too, by suffix array."""
    order, new, page, bounds = _sorted_runs(streams, run)
    n = len(order)
    lo, hi = np.minimum.reduceat(page[order], new), np.maximum.reduceat(page[order], new)
    hits = order[np.repeat(lo != hi, np.diff(np.concatenate((new, [n]))))]
    edge = np.zeros(n + run + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.subtract.at(edge, hits + run, 1)
    covered = np.cumsum(edge)[:n] > 0
    return [covered[a : b - 1] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def spread_runs(streams: list[np.ndarray], least: float, run: int = RUN) -> np.ndarray:
    """Fingerprints of the runs within blocks that at least ``least`` streams hold, by suffix array."""
    order, new, page, bounds = _sorted_runs(streams, run)
    # Equal suffixes lie in the order of their places, so a group's streams are ascending.
    first = np.concatenate(([True], np.diff(page[order]) != 0))
    first[new] = True
    at = order[new[np.add.reduceat(first.astype(np.int64), new) >= least]]
    at = at[bounds[page[at] + 1] - 1 - at >= run]
    found = [streams[k][i : i + run] for k, i in zip(page[at], at - bounds[page[at]], strict=True)]
    return np.array([fingerprints(x, run)[0] for x in found if x.all()], np.int64)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, dict]]:
    """(host, shard, {r1: other columns}) of consecutive rows with columns host, shard, r1, loose, template, ..."""
    at, rows = None, {}
    for batch in batches:
        for host, shard, r1, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, shard) != at:
                if rows:
                    yield *at, rows
                at, rows = (host, shard), {}
            rows[r1] = rest
    if rows:
        yield *at, rows


def _stream(loose: list[str], template: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for b in [*template, *loose] for t in b.split(" ")], np.uint64)


def fingerprints(stream: np.ndarray, run: int = RUN) -> np.ndarray:
    """A 64-bit hash of the ``run`` tokens from each place on that has as many."""
    n = max(0, len(stream) - run + 1)
    h = np.zeros(n, np.uint64)
    for k in range(run if n else 0):
        h = mix64(h * _MUL + stream[k : k + n])
    return h.view(np.int64)


def _crossing(blocks: DataFrame) -> DataFrame:
    """(r1, runs): fingerprints of the runs that only this page of its shard has, and a page of another shard too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, shard, rows in _by_shard(batches):
            keys = sorted(rows)
            found = [np.unique(fingerprints(_stream(*rows[k]))) for k in keys]
            f, first, n = np.unique(np.concatenate(found), return_index=True, return_counts=True)
            owner = np.repeat(np.array(keys, np.int64), [len(x) for x in found])[first]
            made = [pa.array([host] * len(f), pa.string()), pa.array([shard] * len(f), pa.int32()), pa.array(f, pa.int64()), pa.array(owner, pa.int64(), mask=n > 1)]
            yield pa.RecordBatch.from_arrays(made, names=["host", "shard", "f", "r1"])

    held = staged(arrow_map(blocks, run, "host string, shard int, f long, r1 long"), "runs")
    across = held.groupBy("host", "f").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).filter("lo <> hi").select("host", "f")
    return held.filter("r1 is not null").join(across, ["host", "f"]).groupBy("r1").agg(F.collect_list("f").alias("runs"))


def _uncovered(blocks: DataFrame) -> DataFrame:
    """(r1, texts): the uncovered runs of each page's loose blocks. Rows of a shard are consecutive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _by_shard(batches):
            keys = sorted(rows)
            streams = [_stream(*rows[k][:2]) for k in keys]
            texts = []
            for k, stream, covered in zip(keys, streams, shared_tokens(streams), strict=True):
                loose, template, runs = rows[k]
                if runs:
                    hits = np.flatnonzero(np.isin(fingerprints(stream), np.array(runs, np.int64)))
                    covered[(hits[:, None] + np.arange(RUN)).ravel()] = True
                texts.append(_cut(loose, covered, sum(b.count(" ") + 1 for b in template)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.list_(pa.string()))], names=["r1", "texts"])

    return arrow_map(blocks, run, "r1 long, texts array<string>")


def _article_tokens(articles: DataFrame) -> DataFrame:
    """host, shard, a, tokens (three bytes a word) of the first of equal articles in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            first = [x not in seen and not seen.add(x) for x in names]
            batch = batch.filter(pa.array(first))
            for lo, hi, data, offs in text_steps(batch.column(3)):
                words = Words(data, offs, NON_SPACE)
                h = words.hashes()
                short = np.where(h == _GAP_HASH, np.uint64(0), h % np.uint64((1 << 24) - 1) + np.uint64(1))
                raw, bound = short.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), (words.bound * 3).tolist()
                tokens = pa.array([raw[x:y] for x, y in zip(bound[:-1], bound[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:3], tokens], names=["host", "shard", "a", "tokens"])

    return arrow_map(articles, run, "host string, shard int, a long, tokens binary")


def _tokens(raw: bytes) -> np.ndarray:
    three = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return np.pad(three, ((0, 0), (0, 1))).view("<u4").ravel().astype(np.uint64)


def _proposed(dealt: DataFrame) -> DataFrame:
    """(host, n, runs): a row a shard, its number of articles and the runs that ``SPREAD`` of them hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, _, rows in _by_shard(batches):
            streams = [_tokens(x[0]) for x in rows.values()]
            # A host in one shard needs as many articles as any.
            alone = next(iter(rows.values()))[1] == 1
            least = max(SPREAD * len(streams), LEAST if alone else 1)
            runs = spread_runs(streams, least) if len(streams) >= least else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([len(streams)], pa.int64()), pa.array([runs.tolist()], pa.list_(pa.int64()))], names=["host", "n", "runs"])

    return arrow_map(dealt, run, "host string, n long, runs array<long>")


def _held(tokens: DataFrame) -> DataFrame:
    """(host, a, size, at, runs): the places of proposed runs in each article that has any. The last column holds the host's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.int64))
        for batch in batches:
            out = []
            for host, a, raw, runs in zip(*batch.columns, strict=True):
                if known[0] != host.as_py():
                    known = host.as_py(), np.asarray(runs.values)
                stream = _tokens(raw.as_py())
                found = fingerprints(stream)
                at = np.flatnonzero(np.isin(found, known[1]))
                if len(at):
                    out.append((known[0], a.as_py(), int(np.count_nonzero(stream)), at.tolist(), found[at].tolist()))
            made = zip(*out, strict=True) if out else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(made, kinds, strict=True)], names=["host", "a", "size", "at", "runs"])

    return arrow_map(tokens, run, "host string, a long, size long, at array<long>, runs array<long>")


def _boilerplate(every: DataFrame) -> DataFrame | None:
    """(host, a, at): where the covered runs of articles begin, for articles that have any."""
    spark = every.sparkSession
    articles = every.filter(F.size("main") > 0).select("host", "a", F.array_join("main", f" {_GAP} ").alias("text"))
    shards = articles.groupBy("host").agg(F.sum(F.size(F.split("text", " "))).alias("tokens"))
    shards = staged(shards.select("host", F.ceil(F.col("tokens") / SHARD_TOKENS).cast("int").alias("shards")), "article_shards")
    own = articles.join(shards, "host").withColumn("shard", F.pmod("a", "shards").cast("int"))
    dealt = _article_tokens(own.select("host", "shard", "a", "text")).join(shards, "host")
    dealt = dealt.select("host", "shard", "a", "tokens", "shards").repartition("host", "shard").sortWithinPartitions("host", "shard")
    proposed = staged(_proposed(dealt), "proposed")
    del dealt
    release(spark)
    runs = proposed.filter(F.size("runs") > 0).select("host", F.explode("runs").alias("run")).groupBy("host").agg(F.collect_set("run").alias("runs"))
    totals = proposed.groupBy("host").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    runs = staged(runs.join(totals.select("host"), "host", "left_semi"), "runs")
    if runs.isEmpty():
        return None
    tokens = _article_tokens(own.join(runs.select("host"), "host", "left_semi").select("host", "shard", "a", "text"))
    held = staged(_held(tokens.join(runs, "host").select("host", "a", "tokens", "runs")).dropDuplicates(["host", "a"]), "held")
    each = held.select("host", "a", "size", F.explode(F.arrays_zip("at", "runs")).alias("x")).select("host", "a", "size", "x.at", F.col("x.runs").alias("run"))
    common = lambda d, n: d.groupBy("host", "run").agg(F.countDistinct("a").alias("k")).join(n, "host").filter((F.col("k") >= LEAST) & (F.col("k") >= SPREAD * F.col("n"))).select("host", "run")
    each = staged(each.join(common(each, totals), ["host", "run"]), "common")
    at = F.col("at")
    cover = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(RUN).cast("long"), F.coalesce(F.get(at, k + 1) - x, F.lit(RUN).cast("long")))), F.lit(0).cast("long"), lambda s, x: s + x)
    judged = each.groupBy("host", "a", "size").agg(F.sort_array(F.collect_list("at")).alias("at")).select("host", "a", (cover >= COPIED * F.col("size")).alias("copied"))
    judged = staged(judged, "judged")
    copies = judged.filter("copied").groupBy("host").agg(F.count("*").alias("copies"))
    left = totals.join(copies, "host", "left").select("host", (F.col("n") - F.coalesce("copies", F.lit(0))).alias("n"))
    each = each.join(judged.filter("not copied").select("host", "a"), ["host", "a"])
    return each.join(common(each, left), ["host", "run"]).groupBy("host", "a").agg(F.collect_list("at").alias("at"))


def _cut(blocks: list[str], covered: np.ndarray, at: int = 0, gap: int = 0) -> list[str]:
    """What is left of blocks whose tokens begin at place ``at`` of ``covered``, with ``gap`` places between blocks."""
    kept = []
    for b in blocks:
        words = b.split(" ")
        left = [w for w, c in zip(words, covered[at : at + len(words)], strict=True) if not c]
        at += len(words) + gap
        if left:
            kept.append(" ".join(left))
    return kept


def _without(articles: DataFrame) -> DataFrame:
    """(r1, article) from r1, main, at: the blocks without the runs that begin there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for main, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                covered = np.zeros(sum(b.count(" ") + 2 for b in main), bool)
                covered[(np.array(at)[:, None] + np.arange(RUN)).ravel()] = True
                texts.append(_cut(main, covered, gap=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.string()))], names=["r1", "article"])

    return arrow_map(articles, run, "r1 long, article array<string>")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text (blocks joined by an empty line), n_chars (code points)."""
    every = staged(parsed(pages, page_id, url, html), "blocks").withColumn("a", F.xxhash64(F.array_join("main", f" {_GAP} ")))
    tokens = lambda c: F.aggregate(F.transform(c, lambda x: F.size(F.split(x, " "))), F.lit(0), lambda a, b: a + b)
    sized = every.filter((F.size("loose") > 0) | (F.size("template") > 0)).select("host", "r1", "loose", "template")
    shards = sized.groupBy("host").agg(F.sum(tokens("loose") + tokens("template")).alias("tokens"))
    shards = staged(shards.select("host", F.ceil(F.col("tokens") / SHARD_TOKENS).cast("int").alias("shards")), "shards")
    dealt = sized.join(shards, "host").withColumn("shard", F.pmod(F.col("r1"), F.greatest("shards", F.lit(1))).cast("int"))
    runs = F.lit(None).cast("array<long>").alias("runs")
    if not shards.filter("shards > 1").isEmpty():
        wide = dealt.filter("shards > 1").select("host", "shard", "r1", "loose", "template")
        crossing = staged(_crossing(wide.repartition("host", "shard").sortWithinPartitions("host", "shard")), "crossing")
        dealt, runs = dealt.join(crossing, "r1", "left"), "runs"
    dealt = dealt.select("host", "shard", "r1", "loose", "template", runs).repartition("host", "shard").sortWithinPartitions("host", "shard")
    kept = staged(_uncovered(dealt).filter(F.size("texts") > 0), "uncovered")
    release(pages.sparkSession)
    cut = _boilerplate(every)
    texts = kept.select("r1", "texts", F.lit(None).cast("array<string>").alias("article"))
    if cut is not None:
        found = every.filter(F.size("main") > 0).join(cut, ["host", "a"]).select("r1", "main", "at")
        texts = texts.unionByName(_without(found).withColumn("texts", F.lit(None).cast("array<string>")))
    texts = staged(texts.groupBy("r1").agg(F.first("texts", True).alias("texts"), F.first("article", True).alias("article")), "texts")
    release(pages.sparkSession)
    alone = every.join(texts, "r1", "left")
    article = F.coalesce("article", "main")
    text = F.when(F.size("main") > 0, F.array_join(article, "\n\n")).otherwise(F.coalesce(F.array_join("texts", "\n\n"), F.lit("")))
    return alone.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
