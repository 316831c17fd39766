"""Main text of web pages: the best-scoring contiguous run of a page's words and tags.

Every word and tag gets a weight; the run of greatest sum is found in one scan (the running sum restarts where it
falls below zero). A word's weight is that of a plain word plus that of every context it stands in: elements such as
`nav`, and class, id and role names. Contexts are token kinds like any other: pages that mark their article label
their own words, and a kind's weight moves from its prior to the log-odds of these labels as more words are seen. No
name bars a text; where nearly all words of a page are in one context, that context is what the others are
measured by. Tags have a small negative weight each. Inside the run, blocks of negative context are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.texts import map_texts

SAMPLE_PAGES = 512          # labelled pages that weights are fitted on, at most
SHRINK = 20                 # words (or tags) that a prior is worth

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|title|object|xmp|noembed|noframes"
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
             "table tbody td tfoot th thead tr ul caption".split())
TITLES = {"h1", "h2", "h3"}
# Elements that close an open one of the same group, and those that hide it from being closed.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SHELTERS = set("ul ol table dl div article section blockquote td main body aside nav footer header".split())

# Priors: what a word in such an element, or in one of such a class, id or role, weighs beside a plain word's 1.
ELEMENTS = {"nav": -6, "footer": -4, "aside": -4, "header": -2.5, "form": -2.5, "menu": -4, "dialog": -3, "button": -4, "select": -5,
            "option": -5, "label": -1.5, "legend": -1.5, "fieldset": -1, "canvas": -2, "audio": -2, "video": -2}
HIDDEN_PRIOR = -6
OFTEN = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr popup modal "
            "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer copyright comment comments disqus related "
            "recommended recommendations newsletter subscribe subscription pagination pager toolbar login signup social "
            "sharing widget widgets masthead topbar complementary contentinfo".split())
SOMETIMES = set("share alert notice notices notification notifications reply replies respond header foot side aside search skip "
                "banner promo promotion overlay print hidden teaser".split())
CONTENT = set("article content post entry story main body text".split())
WHOLE_OFTEN, PART_OFTEN, WHOLE_SOMETIMES, PART_SOMETIMES, CONTENT_PRIOR = -4.0, -2.5, -2.5, -0.3, 0.5
BESIDE_WORDS = re.compile(r"(?:with|has|no|without|left|right)[_\-]")         # names that say what stands beside the element
MOST_CONTEXT = 6.0                  # of one element, either way

TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
MARKS = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

WORD, LINK, BESIDE, HIDES = "word", "in:a", "beside", "in:hidden"
# Where no page marks its article. ``BESIDE`` is added to words outside the article that their page marks.
DEFAULT_WEIGHTS = {WORD: 1.0, BESIDE: -0.5, LINK: -2.0, "p": -0.05, "br": -0.05, "b": -0.05, "i": -0.05, "em": -0.05, "strong": -0.05,
                   "a": -0.3, "li": -0.3, "ul": -0.5, "ol": -0.5, "nav": -4.0, "footer": -4.0, "aside": -4.0, "form": -3.0,
                   "header": -2.0, "div": -0.5, "td": -0.3, "tr": -0.3}
DEFAULT_TAG, LEAST_WORD, LEAST_TAG = -0.5, 0.1, -0.02
OUTSIDE = -0.25             # what a word of negative context takes from the sum: an advert must not split an article
FEW, MANY = 5, 20           # words: fewer than FEW in good contexts, and a bad one with MANY sets the measure


@lru_cache(maxsize=100_000)
def prior(kind: str) -> float:
    """Weight of a context kind before any page is seen."""
    sort, _, name = kind.partition(":")
    if sort == "in":
        return {"hidden": HIDDEN_PRIOR, "a": DEFAULT_WEIGHTS[LINK]}.get(name, ELEMENTS.get(name, 0.0))
    if BESIDE_WORDS.match(name):
        return 0.0
    name = name.lower()
    parts = set(re.split(r"[-_]+", name)) - {name}
    good = CONTENT_PRIOR if name in CONTENT or parts & CONTENT else 0.0
    bad = WHOLE_OFTEN if name in OFTEN else WHOLE_SOMETIMES if name in SOMETIMES else PART_OFTEN if parts & OFTEN else \
        PART_SOMETIMES if parts & SOMETIMES else 0.0
    return good + bad


def tokens(html: str, holders: set[int]):
    """(token, text or tag, state) in page order. token: "text", "open", "close", "break".

    state is (contexts, marked): the (kind, element number) pairs around the place, and whether it is in an element that
    marks the article. ``holders`` is filled with the numbers of elements that hold a title or a marked article.
    """
    stack: list[tuple] = []         # name, number and the state inside
    at, number, outside = 0, 0, ((), False)
    state = outside
    for m in TOKENS.finditer(html):
        if m.start() > at:
            yield "text", html[at:m.start()], state
        at = m.end()
        name = m["name"] or m["name2"]
        if m["raw"]:
            yield "open", m["raw"].lower(), state
            continue
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if name == "p" and not any(s[0] == "p" for s in stack):
                yield "break", "p", state
            for i in range(len(stack) - 1, -1, -1):
                # An inline end tag does not reach over an open block.
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            state = stack[-1][2] if stack else outside
            yield "close", name, state
            continue
        if name in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[name]:
                    del stack[i:]
                    break
                if stack[i][0] in SHELTERS:
                    break
        elif name in BLOCKS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":              # a block ends an open paragraph
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        state = stack[-1][2] if stack else outside
        rest = m["rest"] or m["rest2"] or ""
        if name == "h1" or name in ("article", "main"):
            holders.update(s[1] for s in stack)
        if name not in VOID:
            contexts, marked = state
            number += 1
            kinds = []
            if name in ELEMENTS and not (marked and name == "header") or name == "a":
                kinds.append(f"in:{name}")
            if rest and name not in ("body", "html", "main") and name not in TITLES:
                for sort, a, b, c in MARKS.findall(rest):
                    kinds += [f"{sort.lower()}:{word}" for word in (a or b or c).split()]
            if rest and HIDDEN.search(rest):
                kinds.append(HIDES)
            if kinds:
                contexts = (*contexts, *((k, number) for k in dict.fromkeys(kinds)))
            state = (contexts, marked or name in ("article", "main"))
            stack.append((name, number, state))
        yield "open", name, state
    if at < len(html):
        yield "text", html[at:], state


def context_weight(contexts: tuple, weights: dict[str, float], holders: set[int], links: bool) -> float:
    """Sum over the elements around a place. Names and forms of an element that holds a title say nothing about it."""
    each: dict[int, float] = {}
    for kind, number in contexts:
        if kind == LINK and not links or number in holders and (kind == "in:form" or not kind.startswith("in:")):
            continue
        each[number] = each.get(number, 0.0) + (weights[kind] if kind in weights else prior(kind))
    return sum(max(-MOST_CONTEXT, min(MOST_CONTEXT, v)) for v in each.values())


def label_counts(html: str) -> dict[str, tuple[int, int]]:
    """Kind -> (inside, outside) the article a page marks, words for contexts and tags by name; empty if it marks none.

    What stands in the article, but in contexts of a bad prior, counts as outside.
    """
    inside, outside, any_mark, holders = Counter(), Counter(), False, set()
    parts = list(tokens(html, holders))
    for token, what, (contexts, marked) in parts:
        any_mark |= marked
        side = inside if marked and context_weight(contexts, {}, holders, False) > -1 else outside
        if token == "text":
            words = len(what.split())
            if words:
                side[WORD if not contexts else f"{WORD}:"] += words
                for kind in {k for k, _ in contexts}:
                    side[kind] += words
        elif token != "break":
            side[what] += 1
    return {k: (inside[k], outside[k]) for k in inside.keys() | outside.keys()} if any_mark else {}


def fit_weights(pages: DataFrame, html: str = "html", most: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most ``most`` different pages that mark their article, those of the smallest hashes.

    Hashes are ranked first, so that only the chosen pages leave their tasks. The driver sees ``most`` numbers and
    one count pair per kind that those pages hold. Without such pages: ``DEFAULT_WEIGHTS``.
    """
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    marked = pages.select(body.alias("html")).where(F.lower("html").rlike("<(article|main)[ >]")) \
        .withColumn("hash", F.xxhash64("html"))
    chosen = [r["hash"] for r in marked.select("hash").distinct().orderBy("hash").limit(most).collect()]
    if not chosen:
        return dict(DEFAULT_WEIGHTS)
    sample = marked.where((F.col("hash") <= chosen[-1])).groupBy("hash").agg(F.min("html").alias("html"))

    def make():
        def work(texts):
            total: dict[str, list[int]] = {}
            for t in texts:
                for k, (a, b) in label_counts(t).items():
                    pair = total.setdefault(k, [0, 0])
                    pair[0] += a
                    pair[1] += b
            shown = [{"name": k, "inside": a, "outside": b} for k, (a, b) in total.items()]
            return [[shown if i == 0 else [] for i in range(len(texts))]]
        return work

    counted = map_texts(sample, [], "html", "seen array<struct<name:string,inside:bigint,outside:bigint>>", make)
    rows = counted.select(F.inline("seen")).groupBy("name").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).collect()
    return weights_of({r["name"]: (r["a"], r["b"]) for r in rows})


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of a kind inside against outside, drawn to its prior by ``SHRINK`` observations.

    Plain words stay positive; tags stay negative.
    """
    out = dict(DEFAULT_WEIGHTS)
    if not counts:
        return out
    plain, other = counts.get(WORD, (0, 0)), counts.get(f"{WORD}:", (0, 0))
    words = [plain[i] + other[i] for i in (0, 1)]
    tags = [sum(v[i] for k, v in counts.items() if k != WORD and ":" not in k) for i in (0, 1)]

    def odds(pair: tuple[int, int], of: list[int]) -> float:
        return math.log((pair[0] + 0.5) / (of[0] + 1)) - math.log((pair[1] + 0.5) / (of[1] + 1))

    for kind, pair in counts.items():
        share = sum(pair) / (sum(pair) + SHRINK)
        if kind == WORD:
            out[WORD] = max(LEAST_WORD, share * min(odds(pair, words), 2.0) + (1 - share) * DEFAULT_WEIGHTS[WORD])
            out[BESIDE] = math.log((pair[1] + 0.5) / (sum(pair) + 1))
        elif ":" in kind:
            if kind != f"{WORD}:":
                out[kind] = share * odds(pair, words) + (1 - share) * prior(kind)
        else:       # too few tags prove little: they stay near the default
            out[kind] = min(LEAST_TAG, share * odds(pair, tags) + (1 - share) * DEFAULT_WEIGHTS.get(kind, DEFAULT_TAG))
    out[LINK] = min(out.get(LINK, DEFAULT_WEIGHTS[LINK]), DEFAULT_WEIGHTS[LINK])
    return out


def best_run(weights: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the greatest positive sum (the first, longest one); (0, 0) if none."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, w in enumerate(weights):
        if run <= 0:
            run, start = 0.0, i
        run += w
        if run > best:
            best, found = run, (start, i + 1)
    return found


def word_weights(parts: list[tuple], weights: dict[str, float], holders: set[int]) -> list[tuple[float, float]]:
    """Per part the weight of a word there, and the same without the link it may stand in.

    Where hardly a word stands in a context of positive weight, and one context of negative weight holds many, all
    weights are raised until that context's words weigh what plain ones do.
    """
    any_mark = any(state[1] for token, what, state in parts if token == "text" and what.strip())
    beside = max(LEAST_WORD, weights[WORD] + weights[BESIDE])
    known, counted = {}, Counter()
    for token, what, state in parts:
        if state not in known:
            plain = beside if any_mark and not state[1] else weights[WORD]
            known[state] = tuple(plain + context_weight(state[0], weights, holders, links) for links in (True, False))
        if token == "text" and known[state][0] == known[state][1]:
            counted[known[state][1]] += len(what.split())
    good = sum(n for w, n in counted.items() if w > 0)
    large = [w for w, n in counted.items() if n >= MANY]
    lift = max(0.0, weights[WORD] - max(large)) if good < FEW and large else 0.0
    return [(known[state][0] + lift, known[state][1] + lift) for _, _, state in parts]


def extract(html: str, weights: dict[str, float]) -> str:
    """The blocks of the best run, one per line: references decoded, white space as one space, trimmed."""
    holders: set[int] = set()
    parts = list(tokens(html, holders))
    worth = word_weights(parts, weights, holders)
    scores = []
    for (token, what, state), (linked, plain) in zip(parts, worth):
        if token == "text":
            scores.append(len(what.split()) * (linked if plain > 0 else max(OUTSIDE, plain)))
        else:       # tags count less in an article, which may hold lists and tables, and in what is left out
            scores.append(0.0 if token == "break" else weights.get(what, DEFAULT_TAG) * (0.1 if state[1] or plain <= 0 else 1))
    start, end = best_run(scores)
    # The run ends at edges of blocks, not within a line.
    while 0 < start < end and not (parts[start - 1][0] == "break" or parts[start - 1][0] != "text" and parts[start - 1][1] in BLOCKS):
        start -= 1
    while start < end < len(parts) and not (parts[end][0] == "break" or parts[end][0] != "text" and parts[end][1] in BLOCKS):
        end += 1
    blocks, line, item = [], [], [0, 0, False]      # words, words in links, in a list

    def flush():
        text = " ".join(unescape("".join(line)).split())
        # An entry of a list that is a link and nothing else belongs to a menu.
        if text and not (item[2] and item[0] == item[1]):
            blocks.append(text)
        line.clear()
        item[:] = 0, 0, False

    lists = 0
    for (token, what, state), (_, plain) in zip(parts[start:end], worth[start:end]):
        if token == "text":
            if plain > 0:
                line.append(what)
                words = len(what.split())
                item[0] += words
                item[1] += words if any(k == LINK for k, _ in state[0]) else 0
                item[2] |= lists > 0
        elif token == "break" or what in BLOCKS:
            flush()
            if what == "li":
                lists = 1 if token == "open" else 0
            elif what in ("ul", "ol", "p"):
                lists = 0
        elif what == "br":
            line.append(" ")
    flush()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  weights: dict[str, float] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Weights are fitted on the pages unless given.

    Null or empty html gives an empty text; repeated rows give repeated rows; an empty table gives an empty one.
    """
    weights = dict(DEFAULT_WEIGHTS, **(weights if weights is not None else fit_weights(pages, html)))

    def make():
        def work(texts):
            found = [extract(t, weights) for t in texts]
            return [found, list(map(len, found))]
        return work

    return map_texts(pages, [page_id, url], html, "text string, n_chars long", make)
