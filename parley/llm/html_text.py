"""HTML extraction with a suffix array for each host.

A page becomes blocks of tokens in page order, each marked as inside the article element or not, and as
menu, advert, footer and the like or not. The token streams of a host's pages are concatenated, their
suffixes are sorted by their first RUN tokens, and neighbours in that order that agree on RUN tokens and
come from at least PAGES distinct pages are runs that the host repeats: its boilerplate. A page without an
article element loses the covered tokens and keeps its unique runs. Where a page marks its article, the
mark decides: a run that repeats inside articles is a copied article or a quotation, which must stay.

A hot host is dealt into groups of about GROUP pages by a hash of the page, and none grows with the host. There
the distinct pages of each run are counted by the run's hash over the whole host, and each page gets its repeated runs."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .wordhash import shingles, texts_words

#: Tokens of a repeated run (a power of 2), distinct pages that must share it, pages of a group.
RUN, PAGES, GROUP = 8, 3, 128
#: What stands between the blocks of a text.
JOIN = "\n\n"
#: Hosts of more than GROUP pages whose counts are broadcast; if there are more, Spark joins them in its own way.
LARGE_HOSTS = 100_000

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object canvas select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
SKIP = frozenset("head nav footer aside form button dialog menu".split())
ARTICLE = frozenset("article main".split())
#: Words that mark what isn't the article where they begin or end a class name, id or role.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo cookie cookies consent gdpr notice popup modal menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead topbar comment comments disqus newsletter pagination pager complementary contentinfo widget".split()
)
#: Words that do so alone, or before one of the words in PARTS.
WEAK = frozenset("search form login signup subscribe subscription share sharing social related recommended reply replies respond overlay promotion".split())
PARTS = frozenset("area articles bar block box buttons container form icons items links list panel posts section stories widget wrapper".split())
#: Words that say that a name is about something else: a state, an absence, a behaviour.
STATES = frozenset("no not non without with has is hide show free enabled disabled open closed".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: The rest of a tag up to its end; quoted values may hold one. Possessive, so that it never goes back.
_ATTRS = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+""")
_ATTR = re.compile(r"""([^\s"'/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"']++)))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    inside: bool  # an article element
    skipped: bool  # a menu, advert or the like


def marks(name: str) -> bool:
    """Whether a class name, id or role marks what isn't the article: site-footer and cookieBanner do, no-sidebar,
    overflow-hidden and search-results don't."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or not STATES.isdisjoint(words):
        return False
    if words[0] in MARKS or words[-1] in MARKS:
        return True
    return words[0] in WEAK and (len(words) == 1 or words[1] in PARTS)


def _marked(attrs: str) -> bool:
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            if any(map(marks, value.split())):
                return True
        elif name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NONE.search(value):
            return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, whether it is an end tag, attributes) of the tags, in order; comments, declarations and what
    scripts and the like hold have no name. Each character is looked at a bounded number of times."""
    at, n, spent, closes = 0, len(page), 0, True
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        if page.startswith("<![CDATA[", begin) and closes:
            end = page.find("]]>", begin)
            if end >= 0:
                at = end + 3
                yield begin, at, "", False, ""
                continue
            closes = False
        last = page.startswith("</", begin)
        name = _NAME.match(page, begin + 1 + last)
        if name is None and not page.startswith(("<!", "<?", "</"), begin):
            at = begin + 1
            continue
        plain = page.find(">", begin)
        if plain < 0:
            return
        if name is None:
            at = plain + 1
            yield begin, at, "", False, ""
            continue
        end = plain
        # quotes that never close would be looked at again for each tag: that may cost a few times the page
        if spent <= 4 * n:
            whole = _ATTRS.match(page, name.end()).end()
            if whole < n and page[whole] == ">":
                end = whole
            else:
                spent += whole - begin
        at = max(end + 1, name.end())
        found, attrs = name[0].lower(), page[name.end() : end]
        if found in RAW and not last and not attrs.endswith("/"):
            close = re.compile(rf"</{re.escape(found)}\s*>", re.I).search(page, at)
            at, found = close.end() if close else n, ""
        yield begin, at, found, last, attrs


def blocks(page: str | None) -> list[Block]:
    """Blocks with text, in page order. Broken markup never fails: an end tag that closes nothing is
    ignored, one that closes an outer element closes the inner ones, and what stays open ends with the page.
    Time grows with the length of the page, whatever its markup."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # name, inside, skipped
    opened: Counter[str] = Counter()  # names on the stack
    inside = skipped = False
    text: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                out.append(Block(" ".join(words), inside, skipped))
            text.clear()

    def close(k: int) -> None:
        nonlocal inside, skipped
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]
        inside, skipped = stack[-1][1:] if stack else (False, False)

    for begin, end, name, last, attrs in _tags(page):
        text.append(page[at:begin])
        at = end
        if not name:
            continue
        if name in ("br", "td", "th"):
            text.append(" ")
        if name in VOID and name != "hr":
            continue
        if last:
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if any(x[0] in BLOCK for x in stack[k:]):
                    flush()
                close(k)
            continue
        if name in BLOCK:
            flush()
            if name == "hr":
                continue
            if name in ("p", "li", "tr", "dt", "dd", "option") and opened[name]:  # they end their like implicitly
                k = len(stack) - 1
                while stack[k][0] != name and stack[k][0] not in BLOCK:
                    k -= 1
                if stack[k][0] == name:
                    close(k)
        skips = skipped or name in SKIP or (name == "header" and not inside) or (name not in ("html", "body") and bool(attrs) and _marked(attrs))
        holds = inside or (not skips and (name in ARTICLE or "articleBody" in attrs or 'role="main"' in attrs))
        stack.append((name, holds, skips))
        opened[name] += 1
        inside, skipped = holds, skips
    text.append(page[at:])
    flush()
    return out


def repeated(streams: list[np.ndarray], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each page's token numbers, which tokens lie in a run of `run` tokens that at least `pages` distinct
    pages share. Sorting suffixes by their first 1, 2, 4, .. tokens ranks them; equal ranks are equal runs."""
    sizes = [len(s) for s in streams]
    n = sum(sizes)
    if not n:
        return [np.zeros(0, bool) for _ in streams]
    page = np.repeat(np.arange(len(streams)), sizes)
    rank = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:
        after = np.concatenate([rank[width:], np.full(min(width, n), -1)])
        crosses = np.concatenate([page[width:], np.full(min(width, n), -1)]) != page
        after[crosses] = -1
        rank = np.unique((rank << 32) + after + 1, return_inverse=True)[1].astype(np.int64)
        width *= 2
    last = np.cumsum(sizes)[page]
    full = np.flatnonzero(np.arange(n) + run <= last)  # suffixes of at least `run` tokens
    order = full[np.lexsort((page[full], rank[full]))]
    fresh = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (page[order][1:] != page[order][:-1])]) if len(order) else np.zeros(0, bool)
    distinct = np.bincount(rank[order], fresh, minlength=int(rank.max()) + 1)
    hit = full[distinct[rank[full]] >= pages]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + run, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.split(covered, np.cumsum(sizes)[:-1])


def run_hashes(page: list[Block]) -> np.ndarray:
    """The hashes of a page's runs of RUN tokens, by their first token."""
    words, _ = texts_words([" ".join(b.text for b in page)], lower=False)
    return shingles(words, RUN).astype(np.int64) if len(words) >= RUN else np.zeros(0, np.int64)


def covered_by(page: list[Block], runs: np.ndarray) -> np.ndarray:
    """Which tokens of a page lie in one of the runs with these hashes."""
    edge = np.zeros(sum(b.text.count(" ") + 1 for b in page) + 1, np.int64)
    hit = np.flatnonzero(np.isin(run_hashes(page), runs))
    edge[hit] += 1
    edge[hit + RUN] -= 1
    return np.cumsum(edge[:-1]) > 0


def _unmarked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hosts that have pages with text and without an article element."""
    for b in batches:
        pages = [blocks(h) for h in b["html"]]
        yield pd.DataFrame({"host": sorted({h for h, p in zip(b["host"], pages, strict=True) if p and not any(x.inside for x in p)})}, dtype=object)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for host, page, text in zip(b["host"], b["page"], b["html"], strict=True):
            yield pd.DataFrame({"run": np.unique(run_hashes(blocks(text)))}).assign(host=host, page=page)[["host", "page", "run"]]


def host_runs(hot: DataFrame) -> DataFrame | None:
    """(host, page, runs) of rows (host, page, html): the hashes of the runs of each page that at least PAGES distinct
    pages of its host share. Only hosts with a page that marks no article; None if there are none."""
    hosts = materialise(hot.select("host", "html").mapInPandas(_unmarked, "host string").distinct(), "unmarked-hosts")
    if hosts.isEmpty():
        return None
    runs = materialise(hot.join(hosts, "host").select("host", "page", "html").mapInPandas(_runs, "host string, page bigint, run bigint").distinct(), "page-runs")
    often = runs.groupBy("host", "run").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= PAGES).drop("pages")
    return materialise(runs.join(often, ["host", "run"]).groupBy("host", "page").agg(F.collect_list("run").alias("runs")), "repeated-runs")


def main_texts(parsed: list[list[Block]], known: list[np.ndarray] | None = None) -> list[str]:
    """The main text of each page of one host. known: the hashes of each page's repeated runs, if they were counted before."""
    number: dict[str, int] = {}
    split = [[b.text.split(" ") for b in page] for page in parsed]
    if known is None:
        cover = repeated([np.fromiter((number.setdefault(t, len(number)) for b in page for t in b), np.int64) for page in split])
    else:
        cover = [covered_by(page, runs) for page, runs in zip(parsed, known, strict=True)]
    out = []
    for page, words, covered in zip(parsed, split, cover, strict=True):
        if any(b.inside for b in page):
            out.append(JOIN.join(b.text for b in page if b.inside and not b.skipped))
            continue
        kept, at = [], 0
        for b, w in zip(page, words, strict=True):
            if not b.skipped:
                left = [t for t, c in zip(w, covered[at : at + len(w)], strict=True) if not c]
                if left:
                    kept.append(" ".join(left))
            at += len(w)
        out.append(JOIN.join(kept))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    Null or empty html, and pages with nothing but boilerplate, have the empty text. Pages without a host,
    such as those with a null url, are one group, dealt like a hot host. Pages that are equal count as
    one page where distinct pages are asked for; rows that repeat an id are extracted each by itself, and null ids are ids.
    Of an empty table nothing comes; other columns are ignored. Whole pages are read."""
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    large = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
    large = materialise(large, "large-hosts")
    large = F.broadcast(large) if large.count() <= LARGE_HOSTS else large
    at = F.pmod(F.xxhash64("id", "url"), F.ceil(F.coalesce("n", F.lit(1)) / GROUP)).cast("int")
    page = F.xxhash64("html").alias("page")
    told = host_runs(rows.where("html <> ''").join(large.select("host"), "host").select("host", page, "html"))
    if told is None:
        rows = rows.withColumn("runs", F.lit(None).cast("array<bigint>"))
    else:
        rows = rows.select("*", page).join(told, ["host", "page"], "left").drop("page")
    # dealt by host and part: by the host alone, a hot one would be one task
    dealt = rows.join(large, "host", "left").withColumn("part", at).withColumn("hot", F.col("n").isNotNull()).drop("n").repartition("host", "part")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        htmls = group["html"].fillna("").tolist()
        once = list(dict.fromkeys(htmls))
        known = None
        if group["hot"].iloc[0]:
            of = dict(zip(htmls, group["runs"], strict=True))
            known = [np.zeros(0, np.int64) if of[h] is None else np.asarray(of[h], np.int64) for h in once]
        text = dict(zip(once, main_texts([blocks(h) for h in once], known), strict=True))
        out = pd.DataFrame({"id": group["id"], "url": group["url"], "text": [text[h] for h in htmls]})
        out["n_chars"] = out["text"].map(len).astype("int64")
        return out

    return dealt.groupBy("host", "part").applyInPandas(run, "id bigint, url string, text string, n_chars bigint").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
