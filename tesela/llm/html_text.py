"""Main text of web pages by two passes over their blocks.

Pass one decides blocks from their own evidence: where they stand (menus, footers, adverts, forms and the like are out, as named by
elements or by class, id and role), their link density, and their length with the density of stop words.  An <article> or <main> is
one more piece of evidence: its words count double where the parts of a page are compared, and in parts that have few dense words
beside the fullest one (teaser cards, or what stands around an article) a block must be twice as long to be text.  Short blocks and
those with middling evidence stay ambiguous.  Pass two gives these the label of the nearest decided neighbours in the same part or
the parts inside it: headings that of the next one below, others that on which both sides agree, else that of the nearer side.
"""

from __future__ import annotations

import bisect
import html as html_entities
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import whole_row

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can could did do does for from had has have he her him his how i if in into is it its
    just like me more most my no not of on one only or other our out over she so some than that the their them then there these they this those to
    up was we were what when where which who will with would you your
    au aux avec ce ces cette comme dans de des du elle elles en entre est et être il ils je la le les leur lui mais ne nous on ou où par pas plus
    pour qu que qui sa sans se ses si son sont sur tout très tu un une vous y
    aber alle als am an auch auf aus bei bin bis das dass dem den der des die dies doch durch ein eine einem einen einer er es für hat haben ich ihr im
    ist kann man mehr mit nach nicht noch nur oder sein seine sich sie sind so über um und uns unter vom von vor war was wenn wer werden wie wir wird
    zu zum zur
    al algo como con contra cual cuando de del desde donde el ella ellos en entre era es esta este esto fue ha han hasta hay la las le les lo los me
    mi muy no nos o otra otro para pero por porque que quien se ser si sin sobre son su sus también te tiene todo un una uno unos y ya yo
    """.split()
)

# Elements whose content is no text; that end a block; that stand outside the article; and names that mark such parts.
SKIPPED = "script style noscript template svg math iframe object canvas audio video select textarea button datalist title".split()
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4
    h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul
    """.split()
)
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A class or id marks its element if it is such a name, or names with affixes that say which part of them; `no-sidebar` or `legal-news` don't.
OUTSIDE_NAMES = frozenset(
    """
    ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promotion promos promotions banner
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead siteheader pageheader comment comments respond replies disqus cookie
    cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommend
    recommended recommendation recommendations widget widgets toolbar pagination pager copyright legal disclaimer paywall
    """.split()
)
OUTSIDE_AFFIXES = frozenset(
    """
    area articles bar block body bottom box button buttons card center col column container desktop dialog fixed form global group header holder icons
    inner item items large left links list main message mobile module outer overlay page panel popup post posts primary region right row secondary
    section site slot small stories sticky text title top unit wrap wrapper zone
    """.split()
)
_JOINED = re.compile(r"(?<![a-z])(side|site|page)[-_](bar|header)(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A closing tag of these elements ends all that is open inside.
CONTAINERS = frozenset("article aside body details dialog div fieldset figure footer form header html main menu nav ol section table ul dl".split())

#: Pass one: words from which a block with enough stop words is text; stop-word densities; link density from which a block is a menu.
LONG, DENSE, SPARSE, LINKED = 12, 0.20, 0.08, 0.5
#: Weight of a dense word in an article; share of the fullest part's weight from which a part is full; articles in articles that are told apart.
MARKED, FULL, DEPTH = 2, 0.5, 8

#: Open elements that are told apart; what nests deeper counts as in the innermost of these.
NESTED = 512

_ATTRS = r"(?:[^>\"'<]|\"[^\"<]*+\"|'[^'<]*+')*+"
# a tag without "<" inside is read at once; any other begins only, and TagEnds tells its end
_TOKEN = re.compile(rf"<!--|<!\[CDATA\[|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/><]*+)(?:(?P<attrs>{_ATTRS})(?P<end>>))?|<[!?]", re.S)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I) for name in SKIPPED}
_PAIRS = {name: re.compile(rf"<(?P<close>/?){name}(?=[\s/>])", re.I) for name in SKIPPED}
_ATTR = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
_QUOTES = re.compile(r"[>\"']")


class TagEnds:
    """Where a tag's closing bracket is: the first outside of quotes.  Found for all places of a page in one walk from its end, when first
    asked for, so that quotes which never close don't make every tag read the rest of the page."""

    def __init__(self, page: str):
        self._page, self._places, self._ends = page, None, []

    def after(self, at: int) -> int:
        """The place of the bracket that closes a tag whose attributes begin at `at`; -1 if none does."""
        if self._places is None:
            self._places = [m.start() for m in _QUOTES.finditer(self._page)]
            # of each bracket or quote: where a tag ends that reads it outside of quotes; in the one or the other kind of quotes
            outside = single = double = -1
            ends = []
            for place in reversed(self._places):
                kind = self._page[place]
                if kind == ">":
                    outside = place
                elif kind == "'":
                    outside, single = single, outside
                else:
                    outside, double = double, outside
                ends.append(outside)
            self._ends = ends[::-1]
        k = bisect.bisect_left(self._places, at)
        return self._ends[k] if k < len(self._places) else -1


_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
#: Signs that end or part sentences.
_SENTENCE = re.compile(r"[.!?…。！？؟।,;:，、；،]")

GOOD, BAD, OPEN = 1, -1, 0


def _is_named(value: str) -> bool:
    """Whether a class or id names a part outside the main text."""
    for token in _JOINED.sub(r"\1\2", value.lower()).split():
        parts = [p.rstrip("0123456789") for p in re.split(r"[-_]+", token)]
        if any(p in OUTSIDE_NAMES for p in parts) and all(not p or p in OUTSIDE_NAMES or p in OUTSIDE_AFFIXES for p in parts):
            return True
    return False


def _is_outside(name: str, attrs: str) -> tuple[bool, bool]:
    """(whether an element stands outside the main text, whether only its class or id says so)."""
    if name in OUTSIDE:
        return True, False
    if not attrs.strip():
        return False, False
    named = False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), html_entities.unescape(m[2] or m[3] or m[4] or "")
        if key == "role" and value.strip().lower() in OUTSIDE_ROLES:
            return True, False
        named = named or (key in ("class", "id") and name not in ("html", "body", "article", "main") and _is_named(value))
        if key in ("hidden",) or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True, False
    if re.search(r"(?:^|\s)hidden(?:\s|$)", _ATTR.sub(" ", attrs)):
        return True, False
    return named, named


def _skipped_to(page: str, name: str, tag_ends: TagEnds) -> dict[int, int]:
    """Where the content of each element of that name ends, by the end of its start tag; elements that don't end are left out."""
    open_at, ends = [], {}
    for m in _PAIRS[name].finditer(page):
        end = tag_ends.after(m.end())
        if end < 0:
            continue
        if m["close"]:
            if open_at:
                ends[open_at.pop()] = end + 1
        elif page[end - 1] != "/":
            open_at.append(end + 1)
    return ends


def page_blocks(page: str) -> list[tuple[str, int, int, str, bool, tuple[int, ...]]]:
    """(text, words, linked words, kind, outside, articles) of each block with text, in page order; kind: the element it is in; articles:
    the numbers of the article and main elements around it, outermost first."""
    blocks: list = []
    # open elements: name, outside, articles, named parts
    stack: list[tuple[str, bool, tuple[int, ...], tuple[int, ...]]] = []
    parts: list[tuple[str, bool]] = []
    outside = linked = False
    article: tuple[int, ...] = ()
    names: tuple[int, ...] = ()
    kind, at, articles, parts_named = "", 0, 0, 0
    named_in: list[tuple[int, ...]] = []  # of each block, the numbers of the elements around it that their names put outside
    skips: dict[str, dict[int, int]] = {}
    tag_ends, opened, last = TagEnds(page), Counter(), page.rfind(">")

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", "".join(p for p, _ in parts)).strip()
            if text:
                n = len(text.split())
                links = sum(len(p.split()) for p, a in parts if a)
                blocks.append((text, n, min(n, links), kind, outside, article))
                named_in.append(names)
            parts.clear()

    def say(raw: str) -> None:
        if raw:
            parts.append((html_entities.unescape(raw), linked))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at, mark, attrs = m.end(), m[0], m["attrs"] or ""
        if mark == "<!--":
            at = page.find("-->", at) + 3 if page.find("-->", at) >= 0 else len(page)
            continue
        if mark == "<![CDATA[":
            end = page.find("]]>", at)
            parts.append((page[at : end if end >= 0 else len(page)], linked))
            at = end + 3 if end >= 0 else len(page)
            continue
        name = (m["name"] or "").lower()
        if not m["end"]:
            # a declaration, or a tag with "<" inside or without an end; without an end it is text
            end = tag_ends.after(at) if name else (page.find(">", at) if at <= last else -1)
            if end < 0:
                say(mark)
                continue
            attrs, at = page[at:end], end + 1
        if not name:
            continue
        if m["close"]:
            if name == "a":
                linked = False
            elif name in BLOCKS:
                flush()
                # the innermost open element of that name closes, unless a container between is open that it can't reach through
                for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                    if stack[i][0] == name:
                        opened.subtract(x[0] for x in stack[i:])
                        del stack[i:]
                        break
                    if stack[i][0] in CONTAINERS and name not in CONTAINERS:
                        break
                outside, article, names = stack[-1][1:] if stack else (False, (), ())
                kind, linked = (stack[-1][0] if stack else ""), False
            continue
        if name in _ENDS:
            if name == "title" and any(s[0] == "svg" for s in stack):
                continue
            if name in ("script", "style"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            else:
                # an element that closes itself or never ends takes no text with it
                if name not in skips:
                    skips[name] = _skipped_to(page, name, tag_ends)
                at = skips[name].get(at, at)
            continue
        if name == "a":
            linked = True
        elif name == "br":
            parts.append((" ", linked))
        elif name in BLOCKS:
            flush()
            linked = False
            if name in VOID:
                continue
            if stack and (name == stack[-1][0] and name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or stack[-1][0] == "p"):
                opened[stack.pop()[0]] -= 1  # these close themselves
                outside, article, names = stack[-1][1:] if stack else (False, (), ())
            inside = article
            if name in ("article", "main") and len(article) < DEPTH:
                articles += 1
                inside = (*article, articles)
            # a page's header is outside, an article's own header counts only by its headings
            header = name == "header" or any(s[0] == "header" for s in stack)
            is_outside, only_named = _is_outside(name, attrs)
            if only_named and len(names) < DEPTH:
                parts_named += 1
                names = (*names, parts_named)
            outside = outside or (is_outside and not only_named) or (header and name == "header" and not inside)
            article, kind = inside, name
            if header and inside and name not in HEADINGS and name == "header":
                outside, names = False, ()
            if len(stack) < NESTED:
                stack.append((name, outside, article, names))
                opened[name] += 1
    flush()
    return _with_names(blocks, named_in) if parts_named else blocks


def _with_names(blocks: list, named_in: list[tuple[int, ...]]) -> list:
    """The blocks, those in named parts outside, unless the part wraps the page's text: it has several dense blocks and nine tenths of
    the dense words, and none stands in an article outside of it."""
    held: dict[int, list[int]] = {}  # words, blocks, words in articles
    total = [0, 0, 0]
    for (text, n, links, kind, outside, part), names in zip(blocks, named_in, strict=True):
        if not outside and n >= LONG and links <= LINKED * n and kind not in HEADINGS and _stop_density(text) >= DENSE:
            for counts in (total, *(held.setdefault(x, [0, 0, 0]) for x in names)):
                counts[0], counts[1], counts[2] = counts[0] + n, counts[1] + 1, counts[2] + (n if part else 0)
    wraps = {x for x, c in held.items() if c[1] > 1 and c[0] >= 0.9 * total[0] and c[2] == total[2]}
    return [(*b[:4], b[4] or any(x not in wraps for x in names), b[5]) for b, names in zip(blocks, named_in, strict=True)]


def _stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _reads_on(text: str) -> float:
    """Stands for the density where no function word is known: 1 for text with the signs that end or part sentences, in any script."""
    return 1.0 if _SENTENCE.search(text) else 0.0


def _in_words(block: tuple[str, int, int, str, bool, tuple[int, ...]]) -> tuple[str, int, int, str, bool, tuple[int, ...]]:
    """A block with its length in words of five letters where its script has no spaces."""
    text, n, links, *rest = block
    size = max(n, sum(map(str.isalnum, text)) // 5) if n else 0
    return (text, size, links * size // n if n else links, *rest)


def classify_blocks(blocks: list[tuple[str, int, int, str, bool, tuple[int, ...]]]) -> list[bool]:
    """Which blocks are main text: the two passes.

    Where they find none, as in languages whose function words aren't known, they are repeated with sentence signs as density and lengths
    that don't depend on spaces.  Where even so no block decides, all blocks that aren't outside nor mostly links are the text, if they
    make up 2 LONG words together, so a page of short paragraphs isn't empty.
    """
    if any(found := _two_passes(blocks, _stop_density)):
        return found
    sized = [_in_words(b) for b in blocks]
    if any(found := _two_passes(sized, _reads_on)):
        return found
    left = [not outside and links <= LINKED * n for _, n, links, _, outside, _ in sized]
    return left if sum(b[1] for b, keep in zip(sized, left, strict=True) if keep) >= 2 * LONG else found


def _two_passes(blocks: list[tuple[str, int, int, str, bool, tuple[int, ...]]], density_of: Callable[[str], float]) -> list[bool]:
    stops, weight = [], {}
    for text, n, links, kind, outside, part in blocks:
        stops.append(density_of(text))
        if not outside:
            dense = n >= LONG and stops[-1] >= DENSE and links <= LINKED * n and kind not in HEADINGS
            weight[part] = weight.get(part, 0) + dense * n * (MARKED if part else 1)
    best = max(weight.values(), default=0)
    # a part is full by its own words or by those of a part inside it
    full = {part[:i] for part, w in weight.items() if w >= FULL * best for i in range(len(part) + 1) if i or not part}
    labels = []
    for stop, (_, n, links, kind, outside, part) in zip(stops, blocks, strict=True):
        density = links / n if n else 0.0
        if outside or density > LINKED:
            labels.append(BAD)
        elif kind in HEADINGS:
            labels.append(OPEN)
        elif n >= (LONG if part in full else 2 * LONG) and stop >= DENSE:
            labels.append(GOOD)
        elif n >= LONG and stop < SPARSE and not (part and part in full):
            labels.append(BAD)
        else:
            labels.append(OPEN)  # a long block without stop words, too, in a full article: tables and other languages stand there

    def sides(order: range) -> list[tuple[int, int]]:
        """(label, distance) of the nearest decided block before each one in that order, in its part or the parts inside."""
        seen: dict[tuple[int, ...], tuple[int, int]] = {}
        out = [(OPEN, 0)] * len(blocks)
        for step, i in enumerate(order):
            part = blocks[i][5]
            label, where = seen.get(part, (OPEN, 0))
            out[i] = (label, step - where)
            if labels[i]:
                # what a page marks as outside doesn't speak for the articles around it
                for depth in range(len(part) + 1) if not (blocks[i][4] and part) else (0,):
                    seen[part[:depth]] = (labels[i], step)
        return out

    n = len(blocks)
    before, after, out = sides(range(n)), sides(range(n - 1, -1, -1)), list(labels)
    for i, (_, _, _, kind, _, part) in enumerate(blocks):
        if labels[i] == OPEN:
            lean = GOOD if part and part in full else BAD
            (up, far_up), (down, far_down) = ((label or lean, far if label else n + 1) for label, far in (before[i], after[i]))
            if up == down:
                out[i] = up
            elif kind in HEADINGS:
                # the title of a full article may have its links below
                out[i] = lean if lean == GOOD and before[i][0] == OPEN else down
            elif far_up == far_down and len(weight) > 1:
                out[i] = lean
            else:
                out[i] = up if far_up <= far_down else down
    return [x == GOOD for x in out]


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks in page order, joined by line ends.  Null, empty and text-free pages give ''."""
    if not page:
        return ""
    blocks = page_blocks(page)
    return "\n".join(b[0] for b, good in zip(blocks, classify_blocks(blocks), strict=True) if good)


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text string (never null) and n_chars long (its code points), from the whole html; columns of those names are replaced.

    Pages are independent: no shuffle, and a batch holds Arrow's usual number of rows.  Null and empty pages give ''.  Time and memory grow
    in proportion to a page, however broken: tags whose quotes never close are text, and nesting beyond NESTED elements isn't told apart.
    """

    @F.arrow_udf("struct<text:string,n_chars:bigint>")
    def extract(column: pa.Array) -> pa.Array:
        texts = [main_text(x) for x in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["text", "n_chars"])

    made = pages.select(whole_row(pages, ["text", "n_chars"]), extract(F.coalesce(F.col(html), F.lit(""))).alias("_main"))
    return made.select("_row.*", F.col("_main.text"), F.col("_main.n_chars"))


