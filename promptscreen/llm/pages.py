"""Main text of web pages by nearest-URL page differencing.

A page is cut into text blocks (lines). Blocks inside elements that never hold
article text (navigation, forms, scripts, ...; also by class, id or role) are
``chrome``; blocks inside ``article`` or ``main`` are ``body``; the others are
``open``. Pages of a host with equal open lines are one text, with the place of
the first of them. The texts of a host are put in the order of their URL paths,
and each is paired with the texts just before and after it. Each pair's lines
are aligned by longest common subsequence, and open lines the pages share are
deleted: templates repeat from page to page, articles do not. Body lines are
kept even when shared, since articles may quote the same passage or be the same
article.

A pair that shares most of its open text may be near copies or short articles
under a long template. Lines that nearly all texts of the host have are its
template and go. The other shared lines stay if they outweigh by far what is
left of the page (a copy, changed in a line), or if all of one page is in the
other.

The order of pages comes from a distributed sort of narrow rows; pages are
compared by line hashes, so no host, however large, meets in one task.

Defined results: null and empty pages have empty text; a null or odd URL is a
host of its own kind (``''``); rows with equal URL and html are one page for
pairing, and each gets the result; a host's only page has no pair and keeps its
body and open lines; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
from functools import partial
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptscreen.llm.common import batch, column, store, text_chunks, total_vectors

CHROME, OPEN, BODY = 0, 1, 2
COPY_SHARE = 0.5            # pairs that share no more are no copies
COMMON = 0.9                # share of a host's texts that have a line of its template
LEFT = 4                    # shared lines of a near copy are this many times what is left of it
FILTER_BITS = 22            # bits of the membership filter: 512 KB, broadcast
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title xmp noframes math canvas object".split())
NEVER = frozenset("nav header footer aside form button select dialog menu label fieldset option head".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr
    ul""".split())
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side-?bar|menu|nav(?:bar|igation)?"
                   r"|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login"
                   r"|social|share|sharing|related|recommended|widget|comments?|replies|reply|disqus|pagination|pager|toolbar|skip)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([A-Za-z_:][A-Za-z0-9_:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _marked(name: str, attrs: str) -> bool:
    if name in NEVER:
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and MARKS.search(value):
            return True
        if key == "role" and value.strip().lower() in ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of every non-empty block of a page, in page order."""
    if not page:
        return []
    out: list[tuple[int, str]] = []
    words: list[str] = []
    stack: list[tuple[str, bool, bool]] = []        # open elements: name, chrome, body
    chrome = body = 0
    at = 0

    def flush():
        text = " ".join(markup.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append((CHROME if chrome else BODY if body else OPEN, text))

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            words.append(page[at:])
            break
        words.append(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue                                 # comment, doctype
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page) if name in ("script", "style") else at
            words.append(" ")
            continue
        if name in BLOCK or name in NEVER:
            flush()
        elif name == "br":
            words.append(" ")
        if name in VOID or m[3].endswith("/"):
            continue
        if not closing:
            bad, good = _marked(name, m[3]), name in ("article", "main")
            if name == "p":                          # a paragraph ends an open one
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a", "u", "font"):
                    _, x, y = stack.pop()
                    chrome, body = chrome - x, body - y
            stack.append((name, bad, good))
            chrome, body = chrome + bad, body + good
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, x, y in stack[k:]:
                        chrome, body = chrome - x, body - y
                    del stack[k:]
                    break
    flush()
    return out


def place(url: str | None) -> tuple[str, str]:
    """Host and path, as pages are paired by (scheme, query and fragment do not count)."""
    try:
        u = urlsplit((url or "").strip())
        return (u.hostname or "").lower(), u.path or "/"
    except ValueError:
        return "", url or ""


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by
    bit-parallel rows: one big-integer step for each line of ``b``."""
    n = len(a)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, v, rows = (1 << n) - 1, (1 << n) - 1, [(1 << n) - 1]
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = set(), n - 1, len(b)
    while i >= 0 and j > 0:                         # zero bits mark where the length grows
        if (rows[j] >> i) & 1:
            i -= 1
        elif not (rows[j - 1] >> i) & 1:
            j -= 1
        else:
            out.add(i)
            i, j = i - 1, j - 1
    return out


def deletions(lines: list[int], kinds: list[int], sizes: list[int], neighbours: list[tuple[list[int], list[int]]],
              common: set[int], texts: int) -> set[int]:
    """Positions of the lines a page loses: those it shares with its neighbours
    (lines and kinds of each); ``common`` are the lines of the template of its
    host of ``texts`` different texts."""
    gone: set[int] = set()
    own = {i for i, k in enumerate(kinds) if k == OPEN}
    total = sum(sizes[i] for i in own)
    for other, other_kinds in neighbours:
        mine = common_lines(lines, other) & own
        size = sum(sizes[i] for i in mine)
        if size > COPY_SHARE * total:
            template = {i for i in mine if lines[i] in common}
            inside = mine == own or {x for x, k in zip(other, other_kinds, strict=True) if k == OPEN} <= set(lines)
            rest = size - sum(sizes[i] for i in template)
            if mine == own or inside and texts < 3:      # one in the other, and no third text to tell
                template = set()
            if inside or rest > LEFT * (total - size):
                mine = template
        gone |= mine
    return gone


def text_key(host: str, kinds: list[int], lines: list[int]) -> str | None:
    """One key for all pages of a host with the same open lines."""
    own = [x for k, x in zip(kinds, lines, strict=True) if k == OPEN]
    return hashlib.blake2b(f"{host!r}|{own}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if own else None


def page_key(url, page) -> bytes:
    return hashlib.blake2b(f"{url!r}|{page!r}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _lines(batches):
    """Key, place and line hashes of every page; no texts."""
    for rb in text_chunks(batches, "html"):
        rows = []
        for url, page in zip(column(rb, "url").to_pylist(), column(rb, "html").to_pylist(), strict=True):
            found = blocks(page)
            host, path = place(url)
            kinds, lines = [k for k, _ in found], [line_hash(t) for _, t in found]
            rows.append((page_key(url, page).hex(), host, path, kinds, lines, [len(t) for _, t in found], text_key(host, kinds, lines)))
        types = (("key", pa.string()), ("host", pa.string()), ("path", pa.string()), ("kinds", pa.list_(pa.int32())),
                 ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("same", pa.string()))
        yield batch(**{n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(types)})


def _neighbours(batches):
    """Keys before and after each page in its host, from rows sorted by place;
    first and last rows of the partition are told, for the seams."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    frames = [rb.to_pandas() for rb in batches]
    df = pd.concat(frames) if frames else pd.DataFrame({"host": [], "path": [], "key": []})
    n = len(df)
    host, key = df["host"].to_numpy(object), df["key"].to_numpy(object)
    same = host[1:] == host[:-1] if n else np.zeros(0, bool)
    before = [None, *np.where(same, key[:-1], None)] if n else []
    after = [*np.where(same, key[1:], None), None] if n else []
    seam = np.zeros(n, bool)
    if n:
        seam[[0, -1]] = True
    yield batch(part=pa.array([part] * n, pa.int32()), at=pa.array(range(n), pa.int64()), host=pa.array(list(host), pa.string()),
                key=pa.array(list(key), pa.string()), before=pa.array(list(before), pa.string()), after=pa.array(list(after), pa.string()),
                seam=pa.array(seam))


def neighbours(places: DataFrame) -> DataFrame:
    """``(key, before, after)`` for distinct ``(host, path, key)``: the pages
    next to each in the global order of places."""
    sort = ["host", "path", "key"]
    ordered = store(places.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(
        _neighbours, "part int, at long, host string, key string, before string, after string, seam boolean"), "page-order")
    seams = ordered.filter("seam").select("part", "at", "host", "key").orderBy("part", "at").collect()     # two rows a partition
    fix = []
    for x, y in zip(seams, seams[1:], strict=False):
        if x["part"] != y["part"] and x["host"] == y["host"]:
            fix += [(x["key"], None, y["key"]), (y["key"], x["key"], None)]
    spark = places.sparkSession
    fixes = spark.createDataFrame(fix, "key string, b string, a string").groupBy("key").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return (ordered.join(F.broadcast(fixes), "key", "left")
            .select("key", F.coalesce("before", "b").alias("before"), F.coalesce("after", "a").alias("after")))


def template_lines(texts: DataFrame) -> DataFrame:
    """``(host, n, common)``: the number of texts of a host, and the open lines that nearly all of them have."""
    own = F.array_distinct(F.transform(F.filter(F.arrays_zip("kinds", "lines"), lambda x: x["kinds"] == OPEN), lambda x: x["lines"]))
    hosts = texts.groupBy("host").agg(F.count("*").alias("n"))
    shared = texts.select("host", F.explode(own).alias("line")).groupBy("host", "line").agg(F.count("*").alias("c")).filter("c > 1")
    return shared.join(hosts, "host").filter(F.col("c") >= COMMON * F.col("n")).groupBy("host", "n").agg(F.collect_list("line").alias("common"))


def _gone(batches):
    """Which of its open lines (by their number among them) each text loses;
    texts that lose none are left out."""
    names = ("same", "kinds", "lines", "sizes", "one", "one_kinds", "two", "two_kinds", "common", "n")
    for rb in batches:
        keys, gone = [], []
        for same, kinds, lines, sizes, one, one_kinds, two, two_kinds, common, n in zip(*(column(rb, c).to_pylist() for c in names), strict=True):
            near = [x for x in ((one, one_kinds), (two, two_kinds)) if x[0] is not None]
            if g := deletions(lines, kinds, sizes, near, set(common or ()), n or 0):
                number = {i: k for k, i in enumerate(i for i, k in enumerate(kinds) if k == OPEN)}
                keys.append(same), gone.append(sorted(number[i] for i in g))
        yield batch(same=pa.array(keys, pa.string()), gone=pa.array(gone, pa.list_(pa.int32())))


def _slots(keys: list[str]) -> np.ndarray:
    return np.array([int(k[:8], 16) >> (32 - FILTER_BITS) for k in keys], np.int64)


def _members(batches):
    bits = np.zeros(1 << FILTER_BITS, bool)
    for rb in batches:
        bits[_slots(column(rb, "key").to_pylist())] = True
    yield batch(bits=pa.array([np.packbits(bits).tobytes()], pa.binary()))


def _texts(shared, losing: bool, batches):
    """Pages that may lose lines (``losing``) with their blocks, or the others
    with their final text."""
    bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
    for rb in text_chunks(batches, "html"):
        urls, pages = column(rb, "url").to_pylist(), column(rb, "html").to_pylist()
        keys = [page_key(u, p).hex() for u, p in zip(urls, pages, strict=True)]
        mine = bits[_slots(keys)] == losing if keys else np.zeros(0, bool)
        part = rb.filter(pa.array(mine))
        found = [blocks(p) for p, m in zip(pages, mine, strict=True) if m]
        ids = {"page_id": column(part, "page_id"), "url": column(part, "url")}
        if losing:
            yield batch(**ids, key=pa.array([k for k, m in zip(keys, mine, strict=True) if m], pa.string()),
                        kinds=pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int32())),
                        texts=pa.array([[t for _, t in f] for f in found], pa.list_(pa.string())))
        else:
            yield _final(ids, [[t for k, t in f if k != CHROME] for f in found])


def _final(ids, kept):
    texts = ["\n\n".join(k) for k in kept]
    return batch(**ids, text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))


def _without(batches):
    for rb in batches:
        kept = []
        for kinds, texts, gone in zip(*(column(rb, c).to_pylist() for c in ("kinds", "texts", "gone")), strict=True):
            lost, own = set(gone or ()), 0
            kept.append([])
            for k, t in zip(kinds, texts, strict=True):
                if k != CHROME and not (k == OPEN and own in lost):
                    kept[-1].append(t)
                own += k == OPEN
        yield _final({"page_id": column(rb, "page_id"), "url": column(rb, "url")}, kept)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages``.

    Every page's lines are aligned with its neighbours' by their hashes. Only
    texts of pages that lose lines are then shuffled, to meet their deletions;
    a bounded membership filter tells them from the others.
    """
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    cut = store(src.select("url", "html").mapInArrow(_lines, "key string, host string, path string, kinds array<int>, "
                                                             "lines array<long>, sizes array<int>, same string"), "page-lines")
    held = cut.filter("same is not null")
    first = store(held.groupBy("same").agg(F.min(F.struct("path", "key")).alias("first"), F.first("host").alias("host"))
                  .select("same", "host", "first.path", "first.key"), "page-texts")
    one_each = (held.dropDuplicates(["key"]).drop("host", "path", "same").join(first.select("same", "host", "key"), "key"))
    near = neighbours(first.select("host", "path", "key"))
    lines = one_each.select("key", "lines", "kinds")
    pairs = (one_each.join(near, "key", "left").join(template_lines(one_each), "host", "left")
             .join(lines.toDF("before", "one", "one_kinds"), "before", "left").join(lines.toDF("after", "two", "two_kinds"), "after", "left"))
    lost = store(pairs.select("same", "kinds", "lines", "sizes", "one", "one_kinds", "two", "two_kinds", "common", "n")
                 .mapInArrow(_gone, "same string, gone array<int>"), "text-deletions")
    gone = store(held.select("key", "same").distinct().join(lost, "same").select("key", "gone"), "page-deletions")
    bits = total_vectors(gone.select("key").mapInArrow(_members, "bits binary"), "bits", np.uint8, (1 << FILTER_BITS) // 8, add=np.bitwise_or)
    shared = pages.sparkSession.sparkContext.broadcast(bits.tobytes())
    kind = src.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, url string, text string, n_chars long"
    whole = src.mapInArrow(partial(_texts, shared, False), out)
    losing = src.mapInArrow(partial(_texts, shared, True), f"page_id {kind}, url string, key string, kinds array<int>, texts array<string>")
    return whole.unionByName(losing.join(gone, "key", "left").mapInArrow(_without, out))
