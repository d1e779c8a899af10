"""Markup trees: parsing, segments of a document, inline markup as placeholders.

A node is [tag, attributes, children], a child is a node or a string.  Well-formed XML
is read as such: names keep their case and prefixes, and what stands before and behind
the root, comments and instructions come out again as they were (as nodes tagged RAW).
Anything else is read tolerantly, which never fails: unknown end tags are dropped, open
elements end with their parent, a block start closes an open p, void elements have no
content.
"""

from __future__ import annotations

import copy
import html
import re
from html.entities import html5
from html.parser import HTMLParser
from xml.parsers import expat

from ..functions import constants as C

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS, _OUTER, _SKIP = set(C.BLOCK_TAGS), set(C.BLOCK_TAGS) | set(C.OUTER_TAGS), set(C.SKIP_TAGS)
#: A node whose only child is text that is written as it is.
RAW = "#raw"
_TOKEN = re.compile(r"<\s*(/?)\s*([gx])\s*(\d+)\s*(/?)\s*>", re.I)
#: What looks like a tag: a name right behind the bracket, then nothing, a slash or attributes.
_ANY_TAG = re.compile(r"</?[a-z][a-z\d:-]*(?:\s[^<>]*|/)?>", re.I | re.A)
_NAMED = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_SPACE = re.compile(r"\s+")


def local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2].lower()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["#root", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _OUTER and any(n[0] == "p" for n in self.open):
            while self.open[-1][0] != "p":
                self.open.pop()
            self.open.pop()
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _character(m: re.Match) -> str:
    """A named character that XML does not know, as itself."""
    return m[0] if m[1] in ("amp", "lt", "gt", "quot", "apos") else html5.get(m[1] + ";", m[0])


def parse_xml(markup: str) -> list | None:
    """The tree of well-formed XML, or None."""
    text = _NAMED.sub(_character, re.sub(r"^(\ufeff?<\?xml[^>]*?encoding\s*=\s*)([\"'])[^\"']*", r"\1\2utf-8", markup or ""))
    raw = text.removeprefix("\ufeff").encode()
    root: list = ["#root", {}, []]
    stack = [root]
    border = [0, len(raw)]
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text, parser.ordered_attributes = True, True

    def start(tag, attrs):
        if len(stack) == 1:
            border[0] = parser.CurrentByteIndex
        node = [tag, dict(zip(attrs[::2], attrs[1::2], strict=True)), []]
        stack[-1][2].append(node)
        stack.append(node)

    def end(tag):
        stack.pop()
        if len(stack) == 1:
            at = parser.CurrentByteIndex
            border[1] = raw.index(b">", at) + 1 if raw[at : at + 2] == b"</" else at

    def kept(text):
        if len(stack) > 1:
            stack[-1][2].append([RAW, {}, [text]])

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda t: stack[-1][2].append(t)
    parser.CommentHandler = lambda t: kept(f"<!--{t}-->")
    parser.ProcessingInstructionHandler = lambda target, data: kept(f"<?{target} {data}?>")
    try:
        parser.Parse(raw, True)
    except expat.ExpatError:
        return None
    before = raw[: border[0]].decode()
    behind = raw[border[1] :].decode() if border[1] > border[0] else ""
    if before:
        root[2].insert(0, [RAW, {}, [before]])
    if behind:
        root[2].append([RAW, {}, [behind]])
    return root


def parse(markup: str) -> list:
    found = parse_xml(markup)
    if found is not None:
        return found
    b = _Builder()
    b.feed(markup or "")
    b.close()
    return b.root


def serialise(node) -> str:
    if isinstance(node, str):
        return escape(node)
    tag, attrs, children = node
    if tag == RAW:
        return children[0]
    inner = "".join(map(serialise, children))
    if tag == "#root":
        return inner
    head = tag + "".join(f' {k}="{html.escape(v, quote=True)}"' for k, v in attrs.items())
    return f"<{head}/>" if not children and tag in VOID else f"<{head}>{inner}</{tag}>"


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def text_of(node) -> str:
    return node if isinstance(node, str) else "" if node[0] == RAW else "".join(map(text_of, node[2]))


def encode(node) -> tuple[str, dict[int, tuple[str, list]]]:
    """Placeholder text of a block's content, and what each number stands for: ('g' or 'x', element).

    Elements are numbered in document order from 1; one without children or text is an
    x, any other a g.
    """
    found: dict[int, tuple[str, list]] = {}

    def inner(children) -> str:
        out = []
        for c in children:
            if isinstance(c, str):
                out.append(escape(c))
                continue
            if c[0] == RAW:
                continue
            n = len(found) + 1
            if not any(not isinstance(x, str) and x[0] != RAW for x in c[2]) and not text_of(c).strip():
                found[n] = ("x", c)
                out.append(f"<x{n}/>")
            else:
                found[n] = ("g", [c[0], c[1], []])
                out.append(f"<g{n}>{inner(c[2])}</g{n}>")
        return "".join(out)

    return _SPACE.sub(" ", inner(node[2])).strip(), found


def plain(encoded: str) -> str:
    t = re.sub(r"<x\d+/>", " ", encoded)
    t = re.sub(r"</?g\d+>", "", t)
    return html.unescape(_SPACE.sub(" ", t)).strip()


def problem(text: str, kinds: dict[int, str]) -> str | None:
    """Why a translated text's placeholders do not fit, or None: each exactly once, of its kind, pairs nested; any order will do."""
    stack: list[int] = []
    seen: list[int] = []
    for end, kind, number, closed in _TOKEN.findall(text):
        kind, n = kind.lower(), int(number)
        if kinds.get(n) != kind:
            return f"unknown {kind}{n}"
        if kind == "x":
            seen.append(n)
        elif closed:
            return f"g{n} must not be empty"
        elif end:
            if not stack or stack.pop() != n:
                return f"g{n} is not nested"
        else:
            stack.append(n)
            seen.append(n)
    if stack:
        return f"g{stack[-1]} stays open"
    return None if sorted(seen) == sorted(kinds) else "placeholders are missing or repeated"


def _clean(text: str) -> str:
    return html.unescape(_ANY_TAG.sub("", text))


def decode(text: str, found: dict[int, tuple[str, list]], strict: bool = True) -> tuple[list, bool]:
    """Children for a block, and whether the placeholders fitted.

    Without ``strict`` a text that does not fit keeps empty elements and those with an
    id, and its plain text; with it, it raises ValueError.
    """
    why = problem(text, {n: k for n, (k, _) in found.items()})
    if why is not None:
        if strict:
            raise ValueError(why)
        kept = [copy.deepcopy(e) if k == "x" else [e[0], e[1], []] for k, e in found.values() if k == "x" or e[1].get("id")]
        return [*kept, _clean(_TOKEN.sub("", text))], False
    root: list = []
    stack = [root]
    at = 0
    for m in _TOKEN.finditer(text):
        if piece := _clean(text[at : m.start()]):
            stack[-1].append(piece)
        at = m.end()
        n = int(m[3])
        if m[2].lower() == "x":
            stack[-1].append(copy.deepcopy(found[n][1]))
        elif m[1]:
            stack.pop()
        else:
            e = found[n][1]
            node = [e[0], dict(e[1]), []]
            stack[-1].append(node)
            stack.append(node[2])
    if piece := _clean(text[at:]):
        stack[-1].append(piece)
    return root, True


def _has_outer(node) -> bool:
    return any(not isinstance(c, str) and c[0] != RAW and (local(c[0]) in _OUTER or _has_outer(c)) for c in node[2])


def _left_out(node, keep_boilerplate: bool, translate_pre: bool) -> bool:
    tag, attrs, _ = node
    skip = _SKIP - {"pre"} if translate_pre else _SKIP
    if tag == RAW or local(tag) in skip or attrs.get("translate", "").lower() == "no":
        return True
    classes = attrs.get("class", "")
    if "notranslate" in classes.split():
        return True
    return not keep_boilerplate and (attrs.get("id") in C.BOILERPLATE_IDS or C.BOILERPLATE_CLASS in classes)


def segments(root, is_nav: bool = False, keep_boilerplate: bool = False, translate_pre: bool = False) -> list[dict]:
    """Blocks in document order: seg_no (with gaps), kind, source, plain, found and node."""
    out: list[dict] = []
    number = 0

    def add(node, kind):
        nonlocal number
        number += 1
        source, found = encode(node)
        text = plain(source)
        if any(c.isalpha() for c in text):
            out.append({"seg_no": number, "kind": kind, "source": source, "plain": text, "found": found, "node": node})

    def visit(node):
        for c in node[2]:
            if isinstance(c, str) or _left_out(c, keep_boilerplate, translate_pre):
                continue
            tag = local(c[0])
            if tag in _BLOCKS and not _has_outer(c):
                add(c, "heading" if len(tag) == 2 and tag[0] == "h" and tag != "hr" else "text")
            elif tag in _OUTER or _has_outer(c) or tag in ("html", "body", "main"):
                visit(c)
            elif c[2] and node[0] != "#root":
                # an inline element right inside a container
                add(c, "toc" if is_nav and tag in ("a", "span") else "text")

    visit(root)
    return out


def apply(entries: list[dict], translations: dict[int, str], bilingual: str | None = None, parents: dict[int, list] | None = None) -> dict[str, int]:
    """Puts translations into the nodes, or beside them in a bilingual text; counts applied, lenient and untranslated."""
    counts = {"applied": 0, "lenient": 0, "untranslated": 0}
    for e in entries:
        t = translations.get(e["seg_no"])
        if not t:
            counts["untranslated"] += 1
            continue
        children, ok = decode(t, e["found"], strict=False)
        counts["applied" if ok else "lenient"] += 1
        if bilingual and e["kind"] != "toc" and parents is not None:
            tag, attrs, _ = e["node"]
            twin = [tag, {k: v for k, v in attrs.items() if k != "id"} | {"class": (attrs.get("class", "") + " translation").strip(), "lang": bilingual}, children]
            parent = parents[id(e["node"])]
            parent[2].insert(next(k for k, c in enumerate(parent[2]) if c is e["node"]) + 1, twin)
        else:
            e["node"][2][:] = children
    return counts


def parents_of(root) -> dict[int, list]:
    out: dict[int, list] = {}
    todo = [root]
    while todo:
        n = todo.pop()
        for c in n[2]:
            if not isinstance(c, str):
                out[id(c)] = n
                todo.append(c)
    return out


def prose_pre(root) -> bool:
    """pre elements that hold prose become paragraphs with line breaks; those that look like code stay."""
    changed = False
    todo = [root]
    while todo:
        n = todo.pop()
        for c in n[2]:
            if isinstance(c, str) or c[0] == RAW:
                continue
            code = any(not isinstance(x, str) and local(x[0]) == "code" for x in c[2])
            if local(c[0]) == "pre" and not code and len(re.findall(C.CODE_LIKE, text_of(c))) < 2:
                parts: list = []
                for child in c[2]:
                    if not isinstance(child, str):
                        parts.append(child)
                        continue
                    for k, line in enumerate(child.split("\n")):
                        if k:
                            parts.append(["br", {}, []])
                        if line.strip():
                            parts.append(line.strip())
                while parts and not isinstance(parts[0], str) and parts[0][0] == "br":
                    parts.pop(0)
                while parts and not isinstance(parts[-1], str) and parts[-1][0] == "br":
                    parts.pop()
                c[0], c[1], c[2][:] = "p", {**c[1], "class": "pre-poem"}, parts
                changed = True
            else:
                todo.append(c)
    return changed


def strip_boilerplate(root) -> bool:
    """Drops a library's own header and footer, and elements whose own text is its marker; text after them stays."""
    changed = False
    todo = [root]
    while todo:
        n = todo.pop()
        kept = []
        for c in n[2]:
            if not isinstance(c, str) and c[0] != RAW:
                own = "".join(x for x in c[2] if isinstance(x, str))
                if c[1].get("id") in C.BOILERPLATE_IDS or C.BOILERPLATE_CLASS in c[1].get("class", "") or re.search(C.BOILERPLATE_MARK, own):
                    changed = True
                    continue
                todo.append(c)
            kept.append(c)
        n[2][:] = kept
    return changed


_STRETCHED = re.compile(C.STRETCHED)
_NO_WORDS = {"pre", "code", "script", "style"}


def _strings(root, skip: set[str]):
    """(list, place) of every text outside of skipped elements, in document order."""
    for k, c in enumerate(root[2]):
        if isinstance(c, str):
            yield root[2], k
        elif c[0] != RAW and local(c[0]) not in skip:
            yield from _strings(c, skip)


def body_of(root):
    """The body, or everything where there is none."""
    todo = [root]
    while todo:
        n = todo.pop()
        for c in n[2]:
            if not isinstance(c, str):
                if local(c[0]) == "body":
                    return c
                todo.append(c)
    return root


def _at_breaks(root):
    """(children, place) of every br between two texts."""
    todo = [root]
    while todo:
        n = todo.pop()
        for k, c in enumerate(n[2]):
            if not isinstance(c, str):
                todo.append(c)
                if local(c[0]) == "br" and 0 < k < len(n[2]) - 1 and isinstance(n[2][k - 1], str) and isinstance(n[2][k + 1], str):
                    yield n[2], k


def word_suspects(root) -> tuple[set[str], set[tuple[str, str]], set[str]]:
    """Stretched words, pairs of words at line breaks, and all words (in lower case) of a document."""
    body = body_of(root)
    texts = [at[k] for at, k in _strings(body, _NO_WORDS)]
    pairs = set()
    for at, k in _at_breaks(body):
        a, b = re.search(r"([A-Za-z]+)\s*$", at[k - 1]), re.match(r"\s*([a-z]+)", at[k + 1])
        if a and b:
            pairs.add((a[1], b[1]))
    every = {w.lower() for t in texts for w in re.findall(r"[A-Za-z]{3,}", t)}
    return {m[0] for t in texts for m in _STRETCHED.finditer(t)}, pairs, every


def fix_words(root, fixed: dict[str, str], joined: set[tuple[str, str]]) -> bool:
    """Puts fixed spellings for stretched words and joins words that a line break parts."""
    body, changed = body_of(root), False
    for at, k in _strings(body, _NO_WORDS):
        new = _STRETCHED.sub(lambda m: fixed.get(m[0], m[0]), at[k])
        changed |= new != at[k]
        at[k] = new
    for at, k in reversed(list(_at_breaks(body))):
        a, b = re.search(r"([A-Za-z]+)\s*$", at[k - 1]), re.match(r"\s*([a-z]+)", at[k + 1])
        if a and b and (a[1], b[1]) in joined:
            at[k - 1 : k + 2] = [at[k - 1][: a.start(1)] + a[1] + b[1] + at[k + 1][b.end(1) :]]
            changed = True
    return changed


def text_nodes(root) -> list[tuple[list, int]]:
    """Texts that a check for left-over words looks at, in document order; its number is a text's place in this list."""
    return [(at, k) for at, k in _strings(body_of(root), _NO_WORDS) if at[k].strip()]
