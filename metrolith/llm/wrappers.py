"""Operator 7: main text of web pages by union-free wrappers inferred for each host.

A page is read as a stream of tags and text; its elements form nested sequences in which equal neighbours fold into a
repeated group. The wrapper of a host is what its pages align to: walking two sequences side by side, equal tags match
and recurse, differing texts become slots, an element that one side lacks becomes optional, and a run of equal ones a
repeated group. The result is a regular expression without unions (`expression` writes it out) with the amounts of text
and of link text seen in each place, and the texts that repeat there. It decides what is extracted (`Rules`): where the
host's pages hold their article; which texts in it are fixed, so parts of the template, not content of a slot; and
whether a place with a name such as "notice" is content on this host, by the text that its slots hold. A name alone
decides only for what is never an article, and only where something else is left.

Wrappers are folded within partitions, then merged over buckets of partitions, then over hosts, so no task holds the
pages of a hot host. Pages meet their host's wrapper in a join that Spark broadcasts only below its size threshold.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, work_folder

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_REST = re.compile(r"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>")  # of a tag, quoted values whole
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>?", re.I) for x in ("script", "style", "textarea", "title")}
_TRIES = 16  # tags whose quotes lead to the end of the page, before quotes no longer count
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = frozenset("noscript template svg iframe select object".split())  # with all that is in them, if an end tag closes them
_VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("html head body article main section nav header footer aside form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address fieldset legend details summary dialog center menu button label".split())
_ENDS_P = _BLOCK - {"button", "label"}
_OPEN_UNTIL = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"})}
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dt dd ul ol table tr dl figcaption".split())
_OUTSIDE = frozenset("head nav header footer aside form menu button fieldset dialog label".split())
_ROLES = {"navigation": 2, "banner": 2, "contentinfo": 2, "complementary": 2, "search": 2, "dialog": 2, "alertdialog": 2, "menu": 2, "menubar": 2, "form": 2, "alert": 1}
#: Parts of names of classes and ids: 2 marks what is never the article, 1 what seldom is, which the masses decide.
_STRONG = re.compile(r"ads?|adv|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletters?|subscri\w*|signup|sidebars?|menus?|nav|navs|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|respond|pagers?|pagination")
_WEAK = re.compile(r"promos?|promo\w+|banners?|notices?|alerts?|side|rail|foot|share|sharing|social|related|recommend\w*|widgets?|login|search")
_FILLER = frozenset("box bar list lists links link wrap wrapper wrappers container holder block blocks area section sections item items inner outer posts articles stories news buttons button icons icon top bottom left right site page pages global main primary secondary header form feed slot unit zone region panel row col column text title post article entry content story blog user reader thread data the js id wp".split())
_MAIN = re.compile(r"(?:^|[\s_-])(?:main|article|content|post|entry|story|article-body|post-content|entry-content)(?=$|[\s_-])", re.I)
_DEPTH = 60  # elements nested deeper count with their ancestor

#: Path of elements, text, its characters inside links, the elements' numbers, whether any element around it is never the
#: article, and the depth of the first one that seldom is (0: none).
Block = tuple[tuple[str, ...], str, int, tuple[int, ...], bool, int]


def _signature(tag: str, attributes: str) -> str:
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    return ".".join([tag, *" ".join(re.sub(r"\d+", "0", found.get(k, "")) for k in ("id", "class", "role")).split()])


@lru_cache(maxsize=50_000)
def noise(signature: str) -> int:
    """2 for what is never the article, by its tag, role or name; 1 for what seldom is, by its name; else 0.

    A name counts if all its parts are known (share-buttons, but not share-price) or its last one is a strong one.
    """
    tag, *names = signature.split(".")
    if tag in _OUTSIDE:
        return 2
    level = 0
    for name in names:
        parts = [x for x in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-").split("-") if x and x != "0"]
        levels = [2 if _STRONG.fullmatch(x) else 1 if _WEAK.fullmatch(x) else 0 for x in parts]
        known = all(n or x in _FILLER for n, x in zip(levels, parts, strict=True))
        level = max(level, _ROLES.get(name.lower(), 0), max(levels) if levels and known else 0, 2 if levels and levels[-1] == 2 else 0)
    return level


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, rest) of a page: text (its text in rest), start and end tags; comments, declarations and raw text
    such as scripts are left out. In time proportional to the page, however broken: what can't be closed is looked for
    once, or a fixed number of times, and not again."""
    out: list[tuple[str, str, str]] = []
    at, size, gt, tries = 0, len(page), -1, _TRIES

    def beyond(place: int) -> int:
        """The next > at or behind place; size if there is none."""
        nonlocal gt
        if gt < place:
            gt = page.find(">", place)
            if gt < 0:
                gt = size
        return gt

    lt = page.find("<")
    while at < size:
        if lt < 0:
            out.append(("text", "", page[at:]))
            break
        if lt > at:
            out.append(("text", "", page[at:lt]))
        follows = page[lt + 1 : lt + 2]
        kind = "start"
        if follows == "/":
            kind = "end"
        elif follows in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = size if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                at = size if end < 0 else end + 3
            else:
                at = beyond(lt) + 1
            lt = page.find("<", at)
            continue
        name = _NAME.match(page, lt + 1 + (kind == "end"))
        if name is None:
            if kind == "end" and page[lt + 2 : lt + 3]:  # a bogus comment
                at = beyond(lt) + 1
            else:
                out.append(("text", "", "<"))
                at = lt + 1
            lt = page.find("<", at)
            continue
        tag = name[0].lower()
        after, end = page.find("<", name.end()), beyond(name.end())
        if after < 0 or end < after:
            rest = page[name.end() : end]
            quoted = kind == "start" and (rest.count('"') % 2 or rest.count("'") % 2)
        else:
            rest, quoted = "", True
        at = end + 1
        if quoted:
            whole = _REST.match(page, name.end()) if tries else None
            if whole:
                rest, at = whole[0][:-1], whole.end()
            else:
                tries = max(0, tries - 1)
                at = min(end, after if after >= 0 else size)
                rest = page[name.end() : at]
                at += at == end
            after = page.find("<", at)
        lt = after
        out.append((kind, tag, rest))
        if kind == "start" and tag in _RAW:
            close = _RAW[tag].search(page, at)
            at = close.end() if close else size
            lt = page.find("<", at)
    return out


def _hidden(found: list[tuple[str, str, str]]) -> dict[int, int]:
    """For each start tag of a hidden element that has an end tag, that tag's place; self-closed ones are empty."""
    opened: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for i, (kind, tag, rest) in enumerate(found):
        if tag in _HIDDEN:
            own = opened.setdefault(tag, [])
            if kind == "end":
                if own:
                    out[own.pop()] = i
            elif not rest.rstrip().endswith("/"):
                own.append(i)
    return out


def blocks(page: str | None) -> list[Block]:
    """All blocks of text in page order, white space turned into single spaces, character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, str, int, bool, int]] = []  # tag, signature, number, never, depth of the first seldom one
    open_: dict[str, list[int]] = {}  # tag: its places in the stack
    parts: list[str] = []
    linked = links = made = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                never, seldom = stack[-1][3:] if stack else (False, 0)
                out.append((tuple([x[1] for x in stack[:_DEPTH]]), text, min(linked, len(text)), tuple([x[2] for x in stack[:_DEPTH]]), never, seldom))
            parts.clear()
        linked = 0

    def last(*tags: str) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=-1)

    def close(place: int) -> None:
        flush()
        for x in stack[place:]:
            open_[x[0]].pop()
        del stack[place:]

    def push(tag: str, signature: str) -> None:
        nonlocal made
        made += 1
        level = noise(signature)
        never, seldom = stack[-1][3:] if stack else (False, 0)
        open_.setdefault(tag, []).append(len(stack))
        stack.append((tag, signature, made, never or level == 2, seldom or (min(len(stack) + 1, _DEPTH) if level == 1 else 0)))

    found = tokens(page or "")
    hidden = _hidden(found)
    until = -1
    for i, (kind, tag, rest) in enumerate(found):
        if i <= until:
            continue
        if kind == "text":
            parts.append(rest)
            if links:
                linked += len(rest)
            continue
        if tag in _HIDDEN:
            until = hidden.get(i, i)
            continue
        if kind == "end":
            if tag == "a":
                links = max(0, links - 1)
            place = last(tag)
            if place >= 0:
                close(place)
            elif tag in _BLOCK:
                flush()
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag == "hr":
            flush()
        if tag in _VOID or tag in _RAW:
            continue
        if tag not in _BLOCK:
            if tag == "a":
                links += 1
            if "=" not in rest and tag not in _OUTSIDE:
                continue
            signature = _signature(tag, rest)
            if noise(signature) and not rest.rstrip().endswith("/"):
                flush()
                push(tag, signature)
            continue
        links = 0 if tag not in ("label", "button") else links
        if tag in _ENDS_P:
            place = last("p")
            if place > last("td", "th", "article", "section", "div", "body"):
                close(place)
        if tag in _OPEN_UNTIL:
            same, bound = _OPEN_UNTIL[tag]
            place = last(*same.split())
            if place > last(*bound):
                close(place)
        flush()
        if not rest.rstrip().endswith("/"):
            push(tag, _signature(tag, rest))
    flush()
    return out


# A wrapper item: [signature, mark, pages, characters, link characters, children]; of a text slot the signature is "#",
# the sixth place its fixed text, or None once texts differed, and the seventh {hash of a text: pages that have it}.
# mark: "" once, "?" optional, "+" repeated, "*" both.


def _both(a: str, b: str) -> str:
    many, none = "+" in a + b or "*" in a + b, "?" in a + b or "*" in a + b
    return "*" if many and none else "+" if many else "?" if none else ""


def hashed(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text)


def page_items(found: list[Block]) -> list:
    """The page's own expression: nested sequences, equal neighbours folded."""
    root: list = []
    numbers: dict[int, int] = {}  # of the element that an item was last made or met for
    for path, text, linked, own, _, _ in found:
        level = root
        for signature, number in zip(path, own, strict=True):
            if not level or level[-1][0] != signature:
                level.append([signature, "", 1, 0, 0, []])
            item = level[-1]
            if numbers.setdefault(id(item), number) != number:
                numbers[id(item)], item[1] = number, "+"
            item[3] += len(text)
            item[4] += linked
            level = item[5]
        if level and level[-1][0] == "#":
            old = level[-1]
            level[-1] = ["#", "", 1, old[3] + len(text), old[4] + linked, None, old[6] | {hashed(text): 1}]
        else:
            level.append(["#", "", 1, len(text), linked, text, {hashed(text): 1}])
    return root


def _texts(a: dict, b: dict, most: int = 256) -> dict:
    """Pages by text; beyond `most` texts, those of the fewest pages go."""
    out = Counter(a)
    out.update(b)
    return dict(out if len(out) <= 2 * most else sorted(out.items(), key=lambda kv: (-kv[1], kv[0]))[:most])


def align(a: list, b: list) -> list:
    """The sequence to which both sequences fit; counts add up."""
    out: list = []

    def put(item: list) -> None:
        if out and out[-1][0] == item[0]:  # a mismatch beside an equal element: a repeated group
            last = out[-1]
            if item[0] == "#":
                out[-1] = ["#", _both(_both(last[1], item[1]), "+"), max(last[2], item[2]), last[3] + item[3], last[4] + item[4], None, _texts(last[6], item[6])]
            else:
                out[-1] = [item[0], _both(_both(last[1], item[1]), "+"), max(last[2], item[2]), last[3] + item[3], last[4] + item[4], align(last[5], item[5])]
        else:
            out.append(item)

    left, right = [x[0] for x in a], [x[0] for x in b]
    same = [("equal", 0, len(a), 0, len(b))] if left == right else SequenceMatcher(None, left, right, autojunk=False).get_opcodes()
    for what, i, j, k, n in same:
        if what == "equal":
            for x, y in zip(a[i:j], b[k:n], strict=True):
                both = [x[0], _both(x[1], y[1]), x[2] + y[2], x[3] + y[3], x[4] + y[4]]
                put([*both, x[5] if x[5] == y[5] else None, _texts(x[6], y[6])] if x[0] == "#" else [*both, align(x[5], y[5])])
        else:
            for x in [*a[i:j], *b[k:n]]:
                put([x[0], _both(x[1], "?"), *x[2:]])
    return out


def expression(items: list) -> str:
    """The wrapper written out: <tag ...> for elements, # for slots, quoted fixed texts, marks behind groups."""
    return " ".join((("#" if x[5] is None else json.dumps(x[5], ensure_ascii=False)) if x[0] == "#" else f"(<{x[0]}> {expression(x[5])} </>)") + x[1] for x in items)


@dataclass(frozen=True)
class Rules:
    """What a wrapper says of its host's pages: where the article is, which texts are fixed parts of the template, and
    which places (paths) of a doubtful name are slots of content all the same."""

    main: tuple[str, ...] = ()
    fixed: frozenset[str] = frozenset()
    content: frozenset[tuple[str, ...]] = frozenset()
    by_mass: bool = False  # no element is named the article, so headings before the largest one belong to it


FIXED_PAGES, FIXED_SHARE = 4, 0.6  # a text is fixed if so many of a place's pages have it


def rules_of(items: list) -> Rules:
    """Reads the rules off a wrapper, by the characters outside links that its slots hold."""
    doubtful: list[tuple[tuple[str, ...], int]] = []
    fixed: set[str] = set()
    content: set[tuple[str, ...]] = set()

    def mass(x: list, path: tuple[str, ...], first: bool = True) -> int:
        """Of what may be content further in; fills in the doubtful places on its way."""
        if x[0] == "#":
            return max(0, x[3] - x[4])
        path = (*path, x[0])
        level = noise(x[0])
        if level == 2 or level == 1 and first and path not in content:
            if level == 1:
                doubtful.append((path, sum(mass(y, path, False) for y in x[5])))
            return 0
        return sum(mass(y, path, first and level != 1) for y in x[5])

    def texts(level: list) -> None:
        for x in level:
            if x[0] == "#":
                fixed.update(t for t, n in x[6].items() if n >= max(FIXED_PAGES, FIXED_SHARE * x[2]))
            else:
                texts(x[5])

    texts(items)
    plain = sum(mass(x, ()) for x in items)
    content.update(path for path, n in doubtful if n > plain)

    best: list[tuple[int, int, tuple[str, ...]]] = []
    doubtful = []

    def look(level: list, path: tuple[str, ...]) -> None:
        for x in level:
            if x[0] == "#" or noise(x[0]) == 2 or noise(x[0]) == 1 and (*path, x[0]) not in content:
                continue
            tag, _, marks = x[0].partition(".")
            rank = 3 if tag == "article" else 2 if tag == "main" or "main" in marks.split(".") else 1 if tag not in _LEAVES and marks and _MAIN.search(marks.replace(".", " ")) else 0
            if rank:
                best.append((rank, mass(x, path), (*path, x[0])))
            look(x[5], (*path, x[0]))

    look(items, ())
    whole = sum(mass(x, ()) for x in items)
    good = [x for x in best if x[1] >= 0.3 * whole and x[1]]
    if good:
        rank, _, path = max(good, key=lambda x: (x[0], x[1], -len(x[2])))
        return Rules(path, frozenset(fixed), frozenset(content), rank == 1)
    path, level = (), items
    while True:
        heavy = max((x for x in level if x[0] != "#"), key=lambda x: mass(x, path), default=None)
        own = mass(heavy, path) if heavy else 0
        if not own or heavy[0].partition(".")[0] in _LEAVES or own < 0.5 * sum(mass(x, path) for x in level):
            return Rules(path, frozenset(fixed), frozenset(content), True)
        path, level = (*path, heavy[0]), heavy[5]


def extract(page: str | None, rules: Rules | None = None) -> str:
    """The article's blocks joined by line ends: the content of the wrapper's slots at its place, or at the page's own if
    the page lacks that. Fixed texts go, but only where they are less than a third of the article: texts that make up
    more of it are shared by copies. Where names leave nothing, they don't count, and then tags don't either."""
    found = blocks(page)

    def take(rules: Rules, path: tuple[str, ...]) -> list[str]:
        k = len(path)
        return [x[1] for x in found if (x[0][:k] == path or rules.by_mass and x[0][-1:] and x[0][-1].partition(".")[0] == "h1") and not x[4] and (not x[5] or x[0][: x[5]] in rules.content)]

    got = take(rules, rules.main) if rules else []
    if not got:
        rules = Rules(fixed=rules.fixed) if rules else Rules()
        own = rules_of(page_items(found))
        got = take(own, own.main) or take(own, ()) or [x[1] for x in found if not x[4]]
    if not got:
        inside = [x for x in found if not any(s.partition(".")[0] in _OUTSIDE for s in x[0])]
        got = [x[1] for x in inside or found]
    if rules.fixed:
        kept = [t for t in got if len(t) > 300 or hashed(t) not in rules.fixed]
        if sum(map(len, kept)) * 3 > sum(map(len, got)) * 2:
            return "\n".join(kept)
    return "\n".join(got)


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", hosts_a_task: int = 2_000) -> DataFrame:
    """(host, pages, wrapper, main, fixed, content, by_mass): one row a host. wrapper is its expression, the others its `Rules`.

    All pages take part, whole. A null url or one without a host belongs to the host "".
    """
    small_batches(pages.sparkSession)
    given = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("h"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, list]] = {}
        part = TaskContext.get().partitionId() % 256

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([part] * len(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([json.dumps(w) for _, w in held.values()])], names=["host", "bucket", "pages", "items"])
            held.clear()
            return made

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = page_items(blocks(page.as_py()))
                n, before = held.get(host, (0, None))
                held[host] = (n + 1, own if before is None else align(before, own))
                if len(held) > hosts_a_task:
                    yield out()
        if held:
            yield out()

    def merge(rows: pd.DataFrame) -> list:
        total = json.loads(rows["items"].iloc[0])
        for x in rows["items"].iloc[1:]:
            total = align(total, json.loads(x))
        return total

    def by_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "bucket": [rows["bucket"].iloc[0]], "pages": [rows["pages"].sum()], "items": [json.dumps(merge(rows))]})

    def by_host(rows: pd.DataFrame) -> pd.DataFrame:
        total = merge(rows)
        rules = rules_of(total)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "pages": [rows["pages"].sum()], "wrapper": [expression(total)], "main": [list(rules.main)], "fixed": [sorted(rules.fixed)], "content": [[list(x) for x in sorted(rules.content)]], "by_mass": [rules.by_mass]})

    parts = given.mapInArrow(fold, "host string, bucket int, pages long, items string")
    parts = parts.groupBy("host", "bucket").applyInPandas(by_bucket, parts.schema)
    return parts.groupBy("host").applyInPandas(by_host, "host string, pages long, wrapper string, main array<string>, fixed array<string>, content array<array<string>>, by_mass boolean")


def host_of(url_col: str):  # noqa: ANN201 - a Column
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, host) for every row of pages.

    A null or empty html gives the empty text; markup without an article gives the blocks outside of what is noise;
    repeated rows, null ids and null urls stay; an empty table gives no row; columns of other names are ignored. Pages of
    any length are read whole, in time proportional to it. The wrappers are written to the shared folder.
    """
    spark = pages.sparkSession
    folder = work_folder(spark, "wrappers")
    infer(pages, url_col, html_col).select(F.col("host").alias("h"), "main", "fixed", "content", "by_mass").write.parquet(folder)
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))
    joined = given.join(spark.read.parquet(folder), F.col("host") == F.col("h"), "left").drop("h")
    types = dict(joined.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Rules] = {}
        for batch in batches:
            texts = []
            for i, (page, host) in enumerate(zip(batch.column("html"), batch.column("host").to_pylist(), strict=True)):
                if host not in held:
                    if len(held) >= 256:
                        held.clear()
                    main, fixed, content = (batch.column(c)[i].as_py() or [] for c in ("main", "fixed", "content"))
                    held[host] = Rules(tuple(main), frozenset(fixed), frozenset(map(tuple, content)), bool(batch.column("by_mass")[i].as_py()))
                texts.append(extract(page.as_py(), held[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("host")], names=["page_id", "url", "text", "n_chars", "host"])

    return joined.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long, host string")
