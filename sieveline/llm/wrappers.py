"""HTML extraction by wrappers: union-free regular expressions inferred from pages of one host.

A page becomes a stream of tokens: opening and closing tags, and text slots.  Inside a page, a run of tokens that
repeats itself becomes a repeated group, innermost first.  The streams of a host are then aligned one after the other:
where they differ, the tokens that only one has become optional, and a single token run that the other has as a
repeated group joins that group.  What comes out is the host's wrapper: a sequence of tags, text slots, optional parts
and repeated groups, without alternatives (the union-free form of Crescenzi, Mecca and Merialdo, 2001).

Every distinct stream is then read through its host's wrapper, which tells which slots of the host's pages are the same.
What the host's distinct pages hold in a slot decides about it: a slot with the same text on nearly all of them is the
template's, one in blocks of links is a menu's, and text that nearly all pages repeat in a slot of the article (one of
several equal elements, say) is left out too.  Of what varies, the slots in the main element, or else all, are the
article; places in the layout and notes count where they hold most of the text.  Slots below elements and classes that
never hold articles are out, and where a host has too few pages to compare, tags and classes decide alone.

Pages are reduced to their streams before anything is gathered: a host's pages have few distinct streams, and those are
dealt into buckets by their hash, so a host that has a third of all pages is aligned in parts, then the parts' wrappers
are aligned with each other.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrow import map_batches, values
from sieveline.session import staged

#: Parts that a host's streams are aligned in before the parts are put together.
PARTS = 16
#: Tokens in a period of a repeated group that are looked for.
PERIOD = 24
#: Distinct pages that must have a slot before its texts are compared; the share of them that makes a text the
#: template's, and the share of a slot's characters that makes the slot the template's or a menu's.
LEAST, SAME = 3, 0.8
#: Text that nothing is said of must have this share of the text in places and notes, else those count as well.
LIGHT = 0.2

# Elements that never hold article text; elements without content; elements that stand inside a line;
# elements that an opening tag of the same kind (or of a block, for p) closes; words in class, id or role attributes.
DROPPED = frozenset(
    "nav header footer aside script style noscript template svg math iframe object embed canvas select option "
    "button input textarea label dialog menu head title audio video map datalist".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
SELF_CLOSED = frozenset("p li dt dd tr td th option".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adbox adslot banner sponsor sponsored promo promoted promotion nav "
    "navbar navigation menu submenu breadcrumb breadcrumbs cookie cookies consent gdpr newsletter comment comments "
    "commentlist disqus respond reply replies discussion share sharing social related recommended recommendations "
    "pagination pager toolbar hidden".split()
)
# Words for a place in the layout, which whole pages stand in as well, and for notes, which articles hold as well;
# words that say of a mark behind them that the element has it, or has none, not that it is one.
PLACES = frozenset(
    "footer foot sidebar side aside rail widget popup modal overlay subscribe subscription signup login search skip".split()
)
NOTES = frozenset("header masthead notice alert copyright legal disclaimer toc tags".split())
HAVING = frozenset("has have with no not without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _bare_name(token: str) -> str:
    return token.rstrip("!^~?*")


def _class_sign(value: str) -> str:
    """``^`` for a class or id with a word of boilerplate, ``~`` of a place in the layout, ``?`` of a note."""
    found = set()
    for name in value.split():
        for word in re.split(r"[^a-z0-9]+", name):
            if word in HAVING:
                break
            found.add("^" if word in MARKS else "~" if word in PLACES else "?" if word in NOTES else "")
    return next((x for x in "^~?" if x in found), "")


def _mark(name: str, attributes: str) -> str:
    """A tag's token: its name and a sign.

    ``!`` is boilerplate by element, role or hiding, ``^`` by class or id, ``*`` the main content; ``~`` (a place in
    the layout, or a form) and ``?`` (a note) are judged by what the host's pages hold there.
    """
    if name in DROPPED:
        return f"{name}!"
    main = name in ("article", "main")
    sign = "~" if name in ("form", "fieldset") else ""
    if attributes and attributes != "/":
        for key, *given in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((g for g in given if g), "").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return f"{name}!"
            if key == "role":
                if value in ROLES and not (name == "form" and value == "form"):
                    return f"{name}!"
                main = main or value in ("main", "article")
            elif key == "itemprop":
                main = main or value == "articlebody"
            elif key in ("class", "id") and name not in ("html", "body", "article", "main"):
                sign = min(sign, _class_sign(value), key=lambda x: "^~?".find(x) if x else 9)
    return f"{name}{'*' if main and sign != '^' else sign}"


def _state(stack: list[str]) -> str:
    """What the open tags say of a slot: ``!`` out, ``*`` main content, ``*?`` a note and ``*~`` a place in it, ``~`` a
    place or note outside of it, or nothing.  The innermost tag that says something decides, but nothing leads out of
    boilerplate by element, and of boilerplate by class only a main element."""
    state = ""
    for token in stack:
        sign = token[-1]
        if sign == "!":
            return "!"
        if sign == "*" and (state != "^" or token == "main*"):
            state = "*"
        elif sign == "^":
            state = "^"
        elif sign in "~?" and state != "^":
            state = ("*~" if sign == "~" or state == "*~" else "*?") if state.startswith("*") else "~"
    return "!" if state == "^" else state


class Page:
    """A page's token stream: ``tokens``, the text of each slot, and each slot's place in the stream."""

    def __init__(self, source: str) -> None:
        self.tokens: list[str] = []
        self.slots: list[int] = []
        self.texts: list[str] = []
        self._space = False
        stack: list[str] = []
        at = 0
        size = len(source)
        while at < size:
            found = _TOKEN.search(source, at)
            if found is None:
                rest = source[at:]
                cut = rest.rfind("<")  # a tag that the page's end cuts off
                if cut >= 0 and re.match(r"<[/a-zA-Z!?]?[^<]*\Z", rest[cut:]) and re.match(r"<(?:[/a-zA-Z!?]|\Z)", rest[cut:]):
                    rest = rest[:cut]
                self._text(rest, stack)
                break
            self._text(source[at : found.start()], stack)
            at = found.end()
            if found[2] is None:
                continue
            name = found[2].lower()
            if found[1]:
                names = [_bare_name(x) for x in stack]
                if name in names:
                    while stack:
                        top = stack.pop()
                        self.tokens.append(f"/{top}")
                        if _bare_name(top) == name:
                            break
                continue
            token = _mark(name, found[3])
            if token == "header!" and _state(stack).startswith("*"):
                token = "header"  # the article's own head
            if name in VOID:
                if name in ("br", "hr"):
                    self.tokens.append(name)
                continue
            if name not in INLINE:
                self._close_implied(stack, name)
            stack.append(token)
            self.tokens.append(token)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else size
                self.tokens.append(f"/{stack.pop()}")
        while stack:
            self.tokens.append(f"/{stack.pop()}")

    def _close_implied(self, stack: list[str], name: str) -> None:
        """Block tags end an open paragraph (and what stands inside its line), items end items of their kind."""
        names = [_bare_name(x) for x in stack]
        last = len(names)
        for i in range(len(names) - 1, -1, -1):
            if names[i] == "p" or (names[i] == name and name in SELF_CLOSED):
                last = i
            elif names[i] not in INLINE:
                break
        while len(stack) > last:
            self.tokens.append(f"/{stack.pop()}")

    def _text(self, raw: str, stack: list[str]) -> None:
        """A slot is named by its element and the state of its open tags: slots of different kinds are never aligned
        with each other."""
        if not raw:
            return
        if self.tokens and self.tokens[-1].startswith("#"):
            self.texts[-1] += raw
        elif raw.isspace():
            self._space = True
        else:
            self.slots.append(len(self.tokens))
            self.tokens.append(f"#{_bare_name(stack[-1]) if stack else ''}{_state(stack)}")
            self.texts.append((" " if self._space else "") + raw)
            self._space = False


# A wrapper is a list of items: a token; ["?", items] optional; ["+", items] repeated.  In JSON as it stands.
Item = object


def _key(item: Item) -> str:
    """What must be equal for two items to be aligned: optional marks and the insides' optional parts do not count."""
    if isinstance(item, str):
        return item
    kind, inner = item
    if kind == "?":
        return "".join(_key(x) for x in inner) if len(inner) == 1 else json.dumps([_key(x) for x in inner])
    body = [_key(x) for x in inner if isinstance(x, str) or x[0] != "?"]
    return "+" + json.dumps(body)


def fold(items: list[Item]) -> list[Item]:
    """Tandem repeats of balanced runs as repeated groups, short periods first, until nothing changes."""
    items = list(items)
    changed = True
    while changed:
        changed = False
        keys = [_key(x) for x in items]
        for period in range(1, min(PERIOD, len(items) // 2) + 1):
            i = 0
            out: list[Item] = []
            hit = False
            while i < len(items):
                body = keys[i : i + period]
                n = 1
                while keys[i + n * period : i + (n + 1) * period] == body and len(body) == period:
                    n += 1
                if n > 1 and _balanced(body):
                    merged = items[i : i + period]
                    for r in range(1, n):
                        merged = align(merged, items[i + r * period : i + (r + 1) * period])
                    out.append(merged[0] if period == 1 and not isinstance(merged[0], str) and merged[0][0] == "+" else ["+", merged])
                    i += n * period
                    hit = True
                else:
                    out.append(items[i])
                    i += 1
            if hit:
                items, keys, changed = out, [_key(x) for x in out], True
                break
    return items


def _balanced(keys: list[str]) -> bool:
    """Every tag that opens in the run closes in it, and none else."""
    depth = 0
    for k in keys:
        if k[0] in "+#" or k in ("br", "hr"):
            continue
        depth += -1 if k.startswith("/") else 1
        if depth < 0:
            return False
    return depth == 0


def _group(items: list[Item], bodies: dict[tuple[str, ...], list[Item]]) -> list[Item]:
    """Single runs that equal the body of a repeated group of the other side become that group, once."""
    if not bodies:
        return items
    keys = [_key(x) for x in items]
    out: list[Item] = []
    i = 0
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for body in sorted(bodies, key=len, reverse=True):
        by_first.setdefault(body[0], []).append(body)
    while i < len(items):
        for body in by_first.get(keys[i], ()):
            if tuple(keys[i : i + len(body)]) == body:
                out.append(["+", items[i : i + len(body)]])
                i += len(body)
                break
        else:
            out.append(items[i])
            i += 1
    return out


def _bodies(items: list[Item]) -> dict[tuple[str, ...], list[Item]]:
    found = {}
    for x in items:
        inner = x[1] if not isinstance(x, str) and x[0] == "?" and len(x[1]) == 1 else [x]
        if not isinstance(inner[0], str) and inner[0][0] == "+":
            body = tuple(_key(y) for y in inner[0][1] if isinstance(y, str) or y[0] != "?")
            if body:
                found[body] = inner[0][1]
    return found


def _bare(item: Item) -> tuple[bool, Item]:
    if not isinstance(item, str) and item[0] == "?" and len(item[1]) == 1:
        return True, item[1][0]
    return False, item


def _lcs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence; equal ends are taken off first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y:
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below = table[i], table[i + 1]
            for j in range(len(y) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j] and table[i][j] == table[i + 1][j + 1] + 1:
                pairs.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                i += 1
            else:
                j += 1
    return pairs + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper of everything that ``a`` or ``b`` is a wrapper of."""
    if a == b:
        return a
    a, b = _group(a, _bodies(b)), _group(b, _bodies(a))
    bare_a, bare_b = [_bare(x) for x in a], [_bare(x) for x in b]
    pairs = _lcs([_key(x) for _, x in bare_a], [_key(x) for _, x in bare_b])
    out: list[Item] = []
    i = j = 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += [["?", [x]] for _, x in bare_a[i:p]] + [["?", [x]] for _, x in bare_b[j:q]]
        if p < len(a):
            (oa, x), (ob, y) = bare_a[p], bare_b[q]
            both = x if isinstance(x, str) else ["+", align(x[1], y[1])]
            out.append(["?", [both]] if oa or ob else both)
        i, j = p + 1, q + 1
    return out


def infer(streams: Iterable[list[Item]]) -> list[Item]:
    """The wrapper of folded streams, aligned one after the other, longest first."""
    found: list[Item] | None = None
    for s in sorted(streams, key=lambda x: (-len(x), json.dumps(x))):
        found = s if found is None else align(found, s)
    return found or []


def read_through(wrapper: list[Item], tokens: list[str]) -> list[int] | None:
    """For each token of a page the number of the wrapper's leaf it stands for, or None if the wrapper does not fit.

    The wrapper is walked as a non-deterministic automaton over its leaves; of several ways the one that leaves out
    the fewest optional parts first is taken.
    """
    leaves: list[str] = []
    follow: dict[int, list[int]] = {}

    def build(items: list[Item], before: list[int]) -> tuple[list[int], list[int], bool]:
        """Leaves that can come first and last, and whether the items can be empty."""
        firsts: list[int] = []
        lasts = list(before)
        empty = True
        for x in items:
            if isinstance(x, str):
                n = len(leaves)
                leaves.append(x)
                for p in lasts:
                    follow.setdefault(p, []).append(n)
                f, tail, skip = [n], [n], False
            else:
                f, tail, skip = build(x[1], lasts)
                if x[0] == "+":
                    for p in tail:
                        have = follow.setdefault(p, [])
                        have += [n for n in f if n not in have]
                skip = skip or x[0] == "?"
            if empty:
                firsts += f
            lasts = [*tail, *lasts] if skip else list(tail)
            empty = empty and skip
        own = [x for x in lasts if x not in before] if empty else lasts
        return firsts, own, empty

    _, ends, _ = build(wrapper, [-1])
    layers: list[dict[int, int]] = [{-1: -1}]
    for t in tokens:
        now: dict[int, int] = {}
        for p in layers[-1]:
            for n in follow.get(p, ()):
                if leaves[n] == t and n not in now:
                    now[n] = p
        if not now:
            return None
        layers.append(now)
    last = next((p for p in layers[-1] if p in ends), None)
    if last is None:
        return None
    path = []
    for layer in reversed(layers[1:]):
        path.append(last)
        last = layer[last]
    return path[::-1]


def slot_sign(token: str) -> str:
    """The state at the end of a slot's token."""
    return token[len(_bare_name(token)) :]


def article_leaves(wrapper: list[Item], own: set[int] | None = None) -> set[int]:
    """The numbers of the slots that hold the article, by their tags alone.

    Slots in boilerplate are out.  The slots in main elements are the article's, without places in the layout if there
    are others; else, and for a page (its leaves ``own``) that has none of them, those that nothing is said of; else
    those in places and notes.
    """
    ranks: list[set[int]] = [set(), set(), set(), set()]
    rank = {"*": 0, "*?": 0, "*~": 1, "": 2, "~": 3}

    def walk(items: list[Item], number: int) -> int:
        for x in items:
            if not isinstance(x, str):
                number = walk(x[1], number)
                continue
            if x.startswith("#") and slot_sign(x) in rank:
                ranks[rank[slot_sign(x)]].add(number)
            number += 1
        return number

    walk(wrapper, 0)
    return next((x for x in ranks if x and (own is None or x & own)), set())


def kept_slots(wrapper: list[Item], tokens: list[str], keep: set[int]) -> list[int] | None:
    """Which of a page's slots (by order) are the article's."""
    path = read_through(wrapper, tokens)
    if path is None:
        return None
    slots = [leaf for leaf, t in zip(path, tokens, strict=True) if t.startswith("#")]
    return [i for i, leaf in enumerate(slots) if leaf in keep]


def page_text(page: Page, kept: Iterable[int]) -> str:
    """The kept slots' text: references decoded, white space as one space, blocks joined by a line end."""
    chosen = set(kept)
    blocks: list[str] = []
    line: list[str] = []
    slot = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    for t in page.tokens:
        if t.startswith("#"):
            if slot in chosen:
                line.append(page.texts[slot])
            slot += 1
        elif t == "br":
            line.append(" ")
        elif _bare_name(t.lstrip("/")) not in INLINE:
            flush()
    flush()
    return "\n".join(blocks)


def text_id(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def slot_facts(page: Page) -> list[tuple[int, int, int]]:
    """For each slot its text's hash, its characters, and those of them in blocks that are mostly links."""
    facts: list[tuple[int, int, int]] = []
    block: list[tuple[int, int, bool]] = []
    links = 0

    def flush() -> None:
        linked = sum(n for _, n, link in block if link) >= SAME * sum(n for _, n, _ in block)
        facts.extend((h, n, n if linked else 0) for h, n, _ in block)
        block.clear()

    for t in page.tokens:
        if t.startswith("#"):
            text = " ".join(html.unescape(page.texts[len(facts) + len(block)]).split())
            block.append((text_id(text), len(text), links > 0))
            continue
        name = _bare_name(t.lstrip("/"))
        if name == "a":
            links += -1 if t.startswith("/") else 1
        elif name not in INLINE and name != "br":
            flush()
    flush()
    return facts


def choose_slots(signs: list[str], leaves: list[int], judged: list[dict]) -> tuple[list[int], list[list[int]]]:
    """Which slots (by order) of a stream are the article's, and the texts in them that are the template's.

    ``judged`` has for leaves of the host's wrapper the distinct ``pages`` with it, ``chars`` on them, those ``linked``
    in blocks of links and those ``fixed`` in texts that nearly all of these pages hold (``same``).
    """
    known = {x["leaf"]: x for x in judged}

    def compared(leaf: int) -> dict | None:
        x = known.get(leaf)
        return x if x and x["pages"] >= LEAST and x["chars"] else None

    def is_menu(leaf: int) -> bool:
        x = known.get(leaf)
        return bool(x and x["chars"] and x["linked"] >= SAME * x["chars"])

    def is_template(leaf: int) -> bool:
        x = compared(leaf)
        return bool(x and x["fixed"] >= SAME * x["chars"])

    # Pages that are all alike tell nothing: then no slot is the template's.
    varying = any(compared(x) and not is_template(x) and not is_menu(x) for x in known)
    slots = [i for i in range(len(leaves)) if signs[i] != "!" and not (varying and is_template(leaves[i]))]

    def weight(of: list[int]) -> float:
        found = {leaves[i] for i in of} & set(known)
        return sum((known[x]["chars"] - known[x]["fixed"]) / known[x]["pages"] for x in found)

    main = [i for i in slots if signs[i] == "*" or (signs[i] == "*?" and not is_menu(leaves[i]))]
    free = [i for i in slots if signs[i] == "" and not is_menu(leaves[i])]
    for kept, places in ((main, "*~"), (free, "~")):
        soft = [i for i in slots if signs[i] == places and not is_menu(leaves[i])]
        if soft and weight(kept) < LIGHT * weight(soft):
            kept += soft
    kept = sorted(main or free)
    if not kept and not varying:  # a page of links only
        kept = [i for i in slots if signs[i] == ""] or [i for i in slots if signs[i] == "~"]
    same = [[i, t] for i in kept if varying and compared(leaves[i]) for t in known[leaves[i]].get("same", ())]
    return kept, same


def _streams(pages: DataFrame) -> DataFrame:
    """host and stream (the tokens) of the distinct streams in each batch of pages."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        def reduce(batch: pa.RecordBatch) -> dict:
            rows = zip(values(batch, "url").to_pylist(), values(batch, "html").to_pylist(), strict=True)
            seen = dict.fromkeys((host_of(url), " ".join(Page(source or "").tokens)) for url, source in rows)
            return {"host": [h for h, _ in seen], "stream": [s for _, s in seen]}

        return reduce

    return map_batches(pages, make, "host string, stream string")


def _infer_group(table: pa.Table) -> pa.Table:
    streams = {json.dumps(fold(json.loads(f))) for f in set(table.column("folded").to_pylist())}
    wrapper = infer([json.loads(s) for s in streams])
    return pa.table({"host": pa.array([table.column("host")[0].as_py()]), "folded": pa.array([json.dumps(wrapper)])})


def infer_wrappers(streams: DataFrame, parts: int = PARTS) -> DataFrame:
    """host and folded (the wrapper as JSON) from distinct folded streams, aligned in parts, then together."""
    part = F.pmod(F.xxhash64("folded"), F.lit(parts))
    some = streams.select("host", "folded", part.alias("part")).groupBy("host", "part")
    return some.applyInArrow(_infer_group, "host string, folded string").groupBy("host").applyInArrow(
        _infer_group, "host string, folded string"
    )


def judge_leaves(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """host, own (0, or the stream that its wrapper does not fit) and judged (JSON): what the host's distinct pages
    hold in each leaf that is not boilerplate by its tags."""
    pages = facts.dropDuplicates(["host", "page_hash"]).join(paths, ["host", "stream_id"])
    slot = F.arrays_zip("leaves", "signs", "texts", "chars", "linked")
    slots = F.array_distinct(F.filter(slot, lambda x: x["signs"] != "!"))
    # A row without text for each leaf of a page counts the leaf's pages.
    once = F.transform(
        F.array_distinct(F.transform(slots, lambda x: x["leaves"])),
        lambda leaf: F.struct(leaf.alias("leaves"), F.lit(None).cast("string").alias("signs"), F.lit(None).cast("long").alias("texts"), F.lit(0).alias("chars"), F.lit(0).alias("linked")),
    )
    rows = pages.select("host", "own", F.explode(F.concat(slots, once)).alias("x")).select(
        "host", "own", F.col("x.leaves").alias("leaf"), F.col("x.texts").alias("text"), F.col("x.chars").alias("chars"), F.col("x.linked").alias("linked")
    )
    leaf = ["host", "own", "leaf"]
    counted = rows.groupBy(*leaf, "text").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    alone = F.col("text").isNull()
    totals = counted.groupBy(*leaf).agg(
        F.max(F.when(alone, F.col("n"))).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    totals = staged(totals, "leaf-totals")
    often = counted.where(F.col("n") >= LEAST).join(totals.select(*leaf, "pages"), leaf)
    often = often.where(F.col("text").isNotNull() & (F.col("n") >= SAME * F.col("pages")))
    # A leaf has at most 1 / SAME times as many such texts as a page has texts in it.
    same = often.groupBy(*leaf).agg(F.sum("chars").alias("fixed"), F.collect_list("text").alias("same"))
    told = totals.join(same, leaf, "left").withColumn("fixed", F.coalesce("fixed", F.lit(0)))
    fields = F.struct("leaf", "pages", "chars", "linked", "fixed", "same")
    return told.groupBy("host", "own").agg(F.to_json(F.collect_list(fields)).alias("judged"))


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) and fits (whether the wrapper fits) of every row.

    Null and empty pages have an empty text.  Pages without a readable host share the host "".  Text that stands
    outside of any element counts as the body's.  Repeated rows get equal results; a table without rows gives none.
    Extra columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    pages = df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    found = _streams(pages.select("url", "html")).distinct()
    folded = staged(map_batches(found, _make_fold, "host string, stream string, folded string"), "page-streams")
    wrappers = staged(infer_wrappers(folded.select("host", "folded").distinct()), "wrappers")
    paths = folded.join(wrappers.select("host", F.col("folded").alias("wrapper")), "host")
    paths = map_batches(paths.select("host", "stream", "wrapper"), _make_path, PATH_SCHEMA)
    paths = staged(paths, "page-paths")
    facts = map_batches(pages.select("url", "html"), _make_facts, FACT_SCHEMA)
    judged = staged(judge_leaves(facts, paths), "leaves-judged")
    plans = map_batches(paths.join(judged, ["host", "own"], "left"), _make_plan, "host string, stream_id long, plan string, fits boolean")
    plans = staged(plans, "page-plans")
    keyed = map_batches(pages, _make_keyed, f"page_id {kind}, url string, html string, host string, stream_id long")
    joined = keyed.join(plans, ["host", "stream_id"], "left")
    return map_batches(
        joined.select("page_id", "url", "html", "plan", "fits"),
        _make_text,
        f"page_id {kind}, url string, text string, n_chars long, fits boolean",
    )


def stream_id(tokens: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(tokens).encode(), digest_size=8).digest(), "little", signed=True)


def _make_fold() -> Callable[[pa.RecordBatch], dict]:
    def run(batch: pa.RecordBatch) -> dict:
        streams = values(batch, "stream")
        folded = [json.dumps(fold(s.split(" ") if s else [])) for s in streams.to_pylist()]
        return {"host": values(batch, "host"), "stream": streams, "folded": folded}

    return run


PATH_SCHEMA = "host string, stream_id long, own long, leaves array<int>, signs array<string>"
FACT_SCHEMA = "host string, page_hash long, stream_id long, texts array<long>, chars array<int>, linked array<int>"


def _make_path() -> Callable[[pa.RecordBatch], dict]:
    read: dict[str, list] = {}

    def run(batch: pa.RecordBatch) -> dict:
        ids, owns, leaves, signs = [], [], [], []
        for s, w in zip(values(batch, "stream").to_pylist(), values(batch, "wrapper").to_pylist(), strict=True):
            if len(read) > 64:
                read.clear()
            wrapper = read.get(w)
            if wrapper is None:
                wrapper = read[w] = json.loads(w)
            tokens = s.split(" ") if s else []
            path = read_through(wrapper, tokens)
            number = stream_id(tokens)
            ids.append(number)
            owns.append(0 if path is not None else number or 1)
            if path is None:  # the page is then read through the wrapper of its own stream
                path = list(range(len(tokens)))
            found = [(leaf, slot_sign(t)) for leaf, t in zip(path, tokens, strict=True) if t.startswith("#")]
            leaves.append([leaf for leaf, _ in found])
            signs.append([sign for _, sign in found])
        return {"host": values(batch, "host"), "stream_id": ids, "own": owns, "leaves": leaves, "signs": signs}

    return run


def _make_facts() -> Callable[[pa.RecordBatch], dict]:
    def run(batch: pa.RecordBatch) -> dict:
        sources = [s or "" for s in values(batch, "html").to_pylist()]
        pages = [Page(s) for s in sources]
        facts = [slot_facts(p) for p in pages]
        return {
            "host": [host_of(u) for u in values(batch, "url").to_pylist()],
            "page_hash": [text_id(s) for s in sources],
            "stream_id": [stream_id(p.tokens) for p in pages],
            "texts": [[x[0] for x in f] for f in facts],
            "chars": [[x[1] for x in f] for f in facts],
            "linked": [[x[2] for x in f] for f in facts],
        }

    return run


def _make_plan() -> Callable[[pa.RecordBatch], dict]:
    def run(batch: pa.RecordBatch) -> dict:
        columns = [values(batch, x).to_pylist() for x in ("signs", "leaves", "judged")]
        plans = [json.dumps(choose_slots(s, n, json.loads(j) if j else [])) for s, n, j in zip(*columns, strict=True)]
        fits = [x == 0 for x in values(batch, "own").to_pylist()]
        return {"host": values(batch, "host"), "stream_id": values(batch, "stream_id"), "plan": plans, "fits": fits}

    return run


def _make_keyed() -> Callable[[pa.RecordBatch], dict]:
    def run(batch: pa.RecordBatch) -> dict:
        urls, sources = values(batch, "url"), values(batch, "html")
        return {
            "page_id": values(batch, "page_id"),
            "url": urls,
            "html": sources,
            "host": [host_of(u) for u in urls.to_pylist()],
            "stream_id": [stream_id(Page(s or "").tokens) for s in sources.to_pylist()],
        }

    return run


def _planned_text(page: Page, plan: str | None) -> str:
    kept, same = json.loads(plan) if plan else ([], [])
    if same:
        out = {(i, t) for i, t in same}
        facts = slot_facts(page)
        kept = [i for i in kept if (i, facts[i][0]) not in out]
    return page_text(page, kept)


def _make_text() -> Callable[[pa.RecordBatch], dict]:
    def run(batch: pa.RecordBatch) -> dict:
        found = [
            _planned_text(Page(s or ""), k)
            for s, k in zip(values(batch, "html").to_pylist(), values(batch, "plan").to_pylist(), strict=True)
        ]
        fits = values(batch, "fits")
        return {
            "page_id": values(batch, "page_id"),
            "url": values(batch, "url"),
            "text": found,
            "n_chars": [len(t) for t in found],
            "fits": fits,
        }

    return run
