"""Reading of one Markdown text: its blocks by lines, and the marks within them in one pass.

Blocks follow the CommonMark rules for quotations, lists, fences, indented code, headings
of both kinds, rules, raw HTML and link definitions, and the usual extension for tables.
Within a block a stack of brackets and one of delimiters find links, images, references,
code, automatic links, raw tags and emphasis. Both take linear time. Places are offsets
into the text, so what is found can be cut out or replaced.
"""

from __future__ import annotations

import bisect
import html
import re

# Fixed values of the CommonMark rules.
HTML_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_TAG = r"(?:/[A-Za-z][A-Za-z0-9-]*\s*|[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?)"
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")), (re.compile(r"<\?"), re.compile(r"\?>")), (re.compile(r"<![A-Za-z]"), re.compile(r">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(HTML_BLOCKS.split())})(?:\s|/?>|$)", re.I), None), (re.compile(rf"<{_TAG}>\s*$"), None),
]
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"(=+|-+)[ \t]*$")
RULE = re.compile(r"(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$")
MARKER = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
TABLE_RULE = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TITLE = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)"
DEFINITION = re.compile(rf"[ ]{{0,3}}\[((?:[^\[\]\\]|\\.){{1,999}})\]:[ \t]*\n?[ \t]*(?:<((?:[^<>\n\\]|\\.)*)>|([^\s<]\S*))(?:[ \t]*(?:\n[ \t]*|[ \t])(?:{_TITLE})(?=[ \t]*(?:\n|$)))?[ \t]*(?:\n|$)", re.S)
ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
TOKEN = re.compile(r"\\[!-/:-@\[-`{-~]|\\\n| {2,}\n[ \t]*|[ \t]*\n[ \t]*|`+|!\[|\[|\]|\*+|_+|~+|<|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|(?<![A-Za-z0-9_/])(?:https?://|www\.)[^\s<]+")
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*)>")
EMAIL = re.compile(r"<([\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>")
INLINE_TAG = re.compile(rf"<(?:{_TAG}|!--.*?--|\?.*?\?|![A-Za-z][^>]*|!\[CDATA\[.*?\]\])>", re.S)
TABLE_TAG = re.compile(r"<(/?)table(?=[\s/>])[^>]*>", re.I)


def folded(label: str) -> str:
    return " ".join(label.split()).casefold()


def unescaped(text: str) -> str:
    return html.unescape(ESCAPE.sub(r"\1", text))


def cells(line: str) -> int:
    """How many cells a table's line has."""
    inner = re.sub(r"(?<!\\)\|$", "", line.strip().removeprefix("|"))
    return len(re.findall(r"(?<!\\)\|", inner)) + 1


class Block:
    """kind is heading, paragraph, code, rule, html, table or definition; ``lines``: (place, text) without marks of containers."""

    def __init__(self, kind: str, start: int, holders: list, level: int = 0, info: str = "", fence: str = "", end_with=None, indent: int = 0) -> None:
        self.kind, self.start, self.end, self.holders, self.level, self.info, self.fence, self.end_with, self.indent = kind, start, start, list(holders), level, info, fence, end_with, indent
        self.lines: list[tuple[int, str]] = []
        self.closed = False

    @property
    def text(self) -> str:
        return "\n".join(t for _, t in self.lines)

    def place(self, i: int) -> int:
        """The offset in the whole text of the i-th character of ``text``."""
        if not hasattr(self, "starts"):
            self.starts, at = [], 0
            for _, t in self.lines:
                self.starts.append(at)
                at += len(t) + 1
        k = max(0, bisect.bisect_right(self.starts, i) - 1)
        return self.lines[k][0] + i - self.starts[k]


class Holder:
    """A quotation or a list item that is open; ``width``: columns that an item's lines are indented by."""

    def __init__(self, kind: str, width: int = 0, marker: str = "", number: int = 0, group: int = 0) -> None:
        self.kind, self.width, self.marker, self.number, self.group, self.blank, self.loose = kind, width, marker, number, group, False, False


def _indent(line: str, at: int) -> int:
    column = 0
    while at < len(line) and line[at] in " \t":
        column += 4 - column % 4 if line[at] == "\t" else 1
        at += 1
    return column


def _skip(line: str, at: int, columns: int) -> int:
    done = 0
    while at < len(line) and line[at] in " \t" and done < columns:
        done += 4 - done % 4 if line[at] == "\t" else 1
        at += 1
    return at


def blocks(body: str) -> list[Block]:
    """The blocks of a text in order."""
    out: list[Block] = []
    holders: list[Holder] = []
    last: dict[int, Holder] = {}  # the newest item at each depth
    leaf: Block | None = None
    base = groups = 0

    def close() -> None:
        nonlocal leaf
        leaf = None

    def add(block: Block) -> Block:
        out.append(block)
        return block

    for line in body.split("\n"):
        if not holders and (leaf is None or leaf.kind == "paragraph"):  # most lines are plain or empty, and need no rule
            if not line:
                leaf = None
                base += 1
                continue
            if line[0].isalpha() or line[0] in "[!":
                last.clear()
                leaf = leaf or add(Block("paragraph", base, holders))
                leaf.lines.append((base, line.rstrip("\r")))
                leaf.end = base + len(line)
                base += len(line) + 1
                continue
        at, matched = 0, 0
        blank = not line.strip(" \t\r")
        for h in holders:
            if h.kind == "quote":
                if _indent(line, at) > 3 or line[(p := at + len(line[at:]) - len(line[at:].lstrip(" \t"))) : p + 1] != ">":
                    break
                at = p + 1
                at += line[at : at + 1] in (" ", "\t") and at < len(line)
            elif not line[at:].strip(" \t\r"):
                pass
            elif _indent(line, at) >= h.width:
                at = _skip(line, at, h.width)
            else:
                break
            matched += 1
        rest = line[at:]
        blank = not rest.strip(" \t\r")
        whole = matched == len(holders)
        if leaf is not None and whole and leaf.kind == "code" and leaf.fence:
            close_fence = _indent(line, at) < 4 and (m := re.fullmatch(r"[ \t]*(`{3,}|~{3,})[ \t\r]*", rest)) and m[1][0] == leaf.fence[0] and len(m[1]) >= len(leaf.fence)
            leaf.end = base + len(line)
            if close_fence:
                leaf.closed = True
                close()
            else:
                cut = _skip(line, at, leaf.indent)
                leaf.lines.append((base + cut, line[cut:]))
            base += len(line) + 1
            continue
        if leaf is not None and whole and leaf.kind == "html" and not (leaf.end_with is None and blank):
            leaf.lines.append((base + at, rest))
            leaf.end = base + len(line)
            if leaf.end_with is not None and leaf.end_with.search(rest):
                close()
            base += len(line) + 1
            continue
        if blank:
            if leaf is not None and leaf.kind == "code" and whole:
                leaf.lines.append((base + min(len(line), at + 4), rest[4:]))
            else:
                close()
            if not whole and any(h.kind == "quote" for h in holders[matched:]):
                del holders[matched + next(i for i, h in enumerate(holders[matched:]) if h.kind == "quote") :]
            for h in holders:
                h.blank = True
            base += len(line) + 1
            continue
        # new containers
        lazy = leaf if leaf is not None and leaf.kind == "paragraph" and not whole else None
        opened: list[Holder] = []
        while _indent(line, at) < 4 and not (not opened and whole and leaf is not None and leaf.kind == "code" and not leaf.fence and _indent(line, at) >= 4):
            p = at + len(line[at:]) - len(line[at:].lstrip(" \t"))
            if line[p : p + 1] == ">":
                at = p + 1 + (line[p + 1 : p + 2] in (" ", "\t") and p + 1 < len(line))
                opened.append(Holder("quote"))
                continue
            m = None if RULE.match(line, p) else MARKER.match(line, p)
            if not m:
                break
            empty = not line[m.end() :].strip(" \t\r")
            if leaf is not None and leaf.kind == "paragraph" and (whole or lazy) and not opened and (empty or (m[2] and m[2] != "1")) and matched == len(holders):
                break
            spaces = _indent(line, m.end())
            after = m.end() + 1 if empty or spaces > 4 else _skip(line, m.end(), spaces)
            width = _indent(line, at) + (m.end() - p) + (1 if empty or spaces > 4 else spaces)
            opened.append(Holder("item", width, m[1][-1], int(m[2]) if m[2] else 0))
            at = min(after, len(line))
        rest = line[at:]
        body_text = rest.lstrip(" \t")
        indent = _indent(line, at)
        begin = base + at + len(rest) - len(body_text)
        in_paragraph = leaf is not None and leaf.kind == "paragraph" and not opened
        if in_paragraph and not whole and not (indent < 4 and (HEADING.match(body_text) or FENCE.match(body_text) or RULE.match(body_text) or any(s.match(body_text) for s, _ in HTML[:6]))):  # a lazy line goes on with the paragraph
            leaf.lines.append((begin, body_text.rstrip("\r")))
            leaf.end = base + len(line)
            base += len(line) + 1
            continue
        if not whole or opened:
            if not whole:
                del holders[matched:]
            if not (in_paragraph and whole):
                close()
        for h in opened:
            close()
            depth = len(holders)
            if h.kind == "item":
                before = last.get(depth)
                goes_on = before is not None and before.kind == "item" and before.marker == h.marker and before.alive is not False
                h.group = before.group if goes_on else (groups := groups + 1)
                h.number = before.number + 1 if goes_on else h.number
                if goes_on and before.blank:
                    h.loose = True
            for k in [k for k in last if k > depth]:
                del last[k]
            h.alive = True
            last[depth] = h
            holders.append(h)
        if not opened:  # a block that stands outside ends the lists at its depth and below
            for k in [k for k in last if k >= len(holders)]:
                del last[k]
        for h in holders:
            if h.blank and h.kind == "item" and h not in opened:
                h.loose = True
            h.blank = False
        if opened and not body_text.strip():
            base += len(line) + 1
            continue
        if indent >= 4 and not in_paragraph:
            cut = _skip(line, at, 4)
            if leaf is None or leaf.kind != "code":
                leaf = add(Block("code", base + at, holders))
            leaf.lines.append((base + cut, line[cut:]))
            leaf.end = base + len(line)
        elif indent < 4 and (m := HEADING.match(body_text)):
            close()
            block = add(Block("heading", begin, holders, len(m[1])))
            block.lines = [(begin + m.start(2) if m[2] else begin, m[2] or "")]
            block.end = base + len(line)
        elif indent < 4 and (m := FENCE.match(body_text)):
            fence, info = (m[1], m[2]) if m[1] else (m[3], m[4])
            leaf = add(Block("code", begin, holders, info=info.strip(), fence=fence, indent=indent))
            leaf.end = base + len(line)
        elif in_paragraph and indent < 4 and whole and (m := SETEXT.match(body_text)):
            leaf.kind, leaf.level, leaf.end = "heading", 1 if m[1][0] == "=" else 2, base + len(line)
            close()
        elif indent < 4 and RULE.match(body_text):
            close()
            add(Block("rule", begin, holders)).end = base + len(line)
        elif indent < 4 and body_text[:1] == "<" and (found := next((i for i, (s, _) in enumerate(HTML[: 6 if in_paragraph else 7]) if s.match(body_text)), None)) is not None:
            leaf = add(Block("html", begin, holders, end_with=HTML[found][1]))
            leaf.lines.append((begin, body_text))
            leaf.end = base + len(line)
            if leaf.end_with is not None and leaf.end_with.search(body_text):
                close()
        elif in_paragraph and "|" in leaf.lines[-1][1] + body_text and indent < 4 and TABLE_RULE.match(body_text) and cells(leaf.lines[-1][1]) == cells(body_text):
            head = leaf.lines.pop()
            if leaf.lines:
                leaf.end = leaf.lines[-1][0] + len(leaf.lines[-1][1])
            else:
                out.remove(leaf) if out[-1] is not leaf else out.pop()
            leaf = add(Block("table", head[0], holders))
            leaf.lines, leaf.end = [head, (begin, body_text)], base + len(line)
        elif leaf is not None and leaf.kind == "table" and whole and not opened:
            leaf.lines.append((begin, body_text))
            leaf.end = base + len(line)
        else:
            if leaf is None or leaf.kind != "paragraph":
                leaf = add(Block("paragraph", begin, holders))
            leaf.lines.append((begin, body_text.rstrip("\r")))
            leaf.end = base + len(line)
        base += len(line) + 1
    for block in out:
        if block.kind == "code" and not block.fence:
            while block.lines and not block.lines[-1][1].strip():
                block.lines.pop()
            block.closed = True
    return [b for block in out for b in _definitions(block)]


def _definitions(block: Block) -> list[Block]:
    """A paragraph without the definitions it begins with, after these."""
    if block.kind != "paragraph" or not block.lines[0][1].startswith("["):
        return [block]
    text, at, out = block.text, 0, []
    if "]:" not in text:
        return [block]
    while at < len(text) and (m := DEFINITION.match(text, at)):
        one = Block("definition", block.place(m.start()), block.holders, info=folded(m[1]))
        group = 2 if m[2] is not None else 3
        one.lines = [(block.place(m.start(group)), m[group])]
        one.end = block.place(m.end() - (m.end() > m.start() and text[m.end() - 1 : m.end()] == "\n"))
        out.append(one)
        at = m.end()
    if at < len(text):
        left = Block("paragraph", block.place(at), block.holders)
        done = text.count("\n", 0, at)
        left.lines, left.end = block.lines[done:], block.end
        out.append(left)
    return out


def _destination(s: str, at: int) -> tuple[int, int, int] | None:
    """(start, end, place after it) of the target at ``at``."""
    if s[at : at + 1] == "<":
        i = at + 1
        while i < len(s) and s[i] not in "<>\n":
            i += 2 if s[i] == "\\" else 1
        return (at + 1, i, i + 1) if s[i : i + 1] == ">" else None
    i, depth = at, 0
    while i < len(s) and s[i] > " " and s[i] != "\x7f":
        if s[i] == "\\" and i + 1 < len(s) and s[i + 1] > " ":
            i += 1
        elif s[i] == "(":
            depth += 1
            if depth > 32:  # as the rules allow; bounds the time
                return None
        elif s[i] == ")":
            if not depth:
                break
            depth -= 1
        i += 1
    return None if depth else (at, i, i)


_SPACE = re.compile(r"[ \t]*\n?[ \t]*")


def _target(s: str, at: int, dead: set) -> tuple[int, int, int] | None:
    """(start, end of the target, place after it) of ``(target "title")`` at ``at``."""
    i = _SPACE.match(s, at + 1).end()
    if s[i : i + 1] == ")":
        return i, i, i + 1
    found = _destination(s, i)
    if found is None:
        return None
    start, end, after = found
    i = _SPACE.match(s, after).end()
    if i > after and (quote := s[i : i + 1]) in ('"', "'", "(") and quote:
        ending, k = ")" if quote == "(" else quote, i + 1
        if (ending, "dead") not in dead:
            while k < len(s) and s[k] != ending:
                k += 2 if s[k] == "\\" else 1
            if k >= len(s):
                dead.add((ending, "dead"))
        else:
            k = len(s)
        if k >= len(s):
            return None
        i = _SPACE.match(s, k + 1).end()
    return (start, end, i + 1) if s[i : i + 1] == ")" else None


def _flanks(s: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether a run of delimiters can open, and close."""
    before, after = s[start - 1] if start else " ", s[end] if end < len(s) else " "
    space = lambda c: c.isspace()
    mark = lambda c: not c.isalnum() and not c.isspace()
    left = not space(after) and (not mark(after) or space(before) or mark(before))
    right = not space(before) and (not mark(before) or space(after) or mark(after))
    if s[start] == "_":
        return left and (not right or mark(before)), right and (not left or mark(after))
    return left, right


#: What stands in every token, at most five characters behind its start or behind blanks alone.
_SPECIAL = re.compile(r"[\\\n`!\[\]*_~<&:.]")


def _token(s: str, at: int) -> re.Match | None:
    """As ``TOKEN.search``, which tries all its ways at each character; plain words are passed over."""
    found = _SPECIAL.search(s, at)
    if found is None:
        return None
    start = p = found.start()
    if s[p] == "\n":
        while start > at and s[start - 1] in " \t":
            start -= 1
    return TOKEN.search(s, max(at, min(start, p - 5)))


def inlines(s: str, labels: set[str]) -> tuple[list[tuple], str, str]:
    """(spans, plain text, canonical source) of a block's text.

    Spans are (kind, start, end, target's start, target's end, target, label); kinds:
    link, image, reference, image_reference, autolink, html, code. ``labels``: what the
    text's definitions name. The canonical source has asterisks for emphasis and a
    backslash for a line break.
    """
    if _token(s, 0) is None:
        return [], s, s
    nodes: list[list] = []  # plain, canonical
    spans: list[tuple] = []
    delimiters: list[dict] = []
    brackets: list[dict] = []
    ticks: dict[int, list[int]] = {}
    for run in re.finditer(r"`+", s) if "`" in s else ():
        ticks.setdefault(len(run[0]), []).append(run.start())
    dead: set = set()

    def emphasize(bottom: int) -> None:
        floors: dict = {}
        k = bottom
        while k < len(delimiters):
            closer = delimiters[k]
            if closer["closes"] and closer["n"]:
                floor = floors.get((closer["sign"], closer["opens"], closer["size"] % 3), bottom)
                j = k - 1
                while j >= floor:
                    opener = delimiters[j]
                    fits = opener["sign"] == closer["sign"] and opener["opens"] and opener["n"]
                    if fits and closer["sign"] == "~":
                        fits = opener["n"] == closer["n"] <= 2
                    elif fits and (opener["closes"] or closer["opens"]) and (opener["size"] + closer["size"]) % 3 == 0:
                        fits = opener["size"] % 3 == 0 and closer["size"] % 3 == 0
                    if fits:
                        break
                    j -= 1
                if j < floor:
                    floors[closer["sign"], closer["opens"], closer["size"] % 3] = k
                    k += 1
                    continue
                n = closer["n"] if closer["sign"] == "~" else 2 if min(opener["n"], closer["n"]) >= 2 else 1
                mark = "~" * 2 if closer["sign"] == "~" else "*" * n
                opener["n"], closer["n"] = opener["n"] - n, closer["n"] - n
                opener["opened"], closer["shut"] = mark + opener["opened"], closer["shut"] + mark
                for d in delimiters[j + 1 : k]:
                    d["opens"] = d["closes"] = False
                if not closer["n"]:
                    k += 1
            else:
                k += 1
        for d in delimiters[bottom:]:
            rest = d["sign"] * d["n"]
            nodes[d["node"]][:] = [rest, d["shut"] + rest + d["opened"]]
        del delimiters[bottom:]

    at = 0
    while m := _token(s, at):
        if m.start() > at:
            nodes.append([s[at : m.start()]] * 2)
        token, at = m[0], m.end()
        if token[0] == "\\" and token != "\\\n":
            nodes.append([token[1], token])
        elif "\n" in token:
            hard = token[0] == "\\" or token.startswith("  ")
            nodes.append([" " if hard else "\n", "\\\n" if hard else "\n"])
        elif token[0] == "`":
            places = ticks.get(len(token), [])  # a run of which an escape has taken a part is of no length that was met
            k = bisect.bisect_left(places, at)
            if k == len(places):
                nodes.append([token, token])
                continue
            end = places[k] + len(token)
            inner = s[at : places[k]].replace("\n", " ")
            plain = inner[1:-1] if inner[:1] == inner[-1:] == " " and inner.strip() else inner
            spans.append(("code", m.start(), end, at, places[k], plain, None))
            nodes.append([plain, token + inner + token])
            at = end
        elif token in ("[", "!["):
            brackets.append({"node": len(nodes), "image": token == "![", "at": at, "start": m.start(), "bottom": len(delimiters), "active": True})
            nodes.append([token, token])
        elif token == "]":
            nodes.append(["]", "]"])
            if not brackets:
                continue
            b = brackets.pop()
            if not b["active"]:
                continue
            target = label = None
            end = at
            if s[at : at + 1] == "(":
                target = _target(s, at, dead)
            if target is None:
                inner = s[b["at"] : m.start()]
                full = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S).match(s, at)
                name = folded(full[1]) if full and full[1].strip() else folded(inner) if len(inner) < 1000 else ""
                if name and name in labels and (full and full[1].strip() or not re.search(r"(?<!\\)[\[\]]", inner)):
                    label, end = name, full.end() if full else at
            if target is None and label is None:
                continue
            kind = ("image" if b["image"] else "link") if target else "image_reference" if b["image"] else "reference"
            end = target[2] if target else end
            spans.append((kind, b["start"], end, *(target[:2] if target else (None, None)), unescaped(s[target[0] : target[1]]) if target else None, label))
            emphasize(b["bottom"])
            nodes[b["node"]][0] = ""
            nodes[-1] = ["", s[m.start() : end]]
            at = end
            if not b["image"]:
                for other in brackets:
                    other["active"] = other["active"] and other["image"]
        elif token[0] in "*_~":
            opens, closes = _flanks(s, m.start(), at)
            if token[0] == "~" and len(token) > 2:
                opens = closes = False
            delimiters.append({"sign": token[0], "n": len(token), "size": len(token), "opens": opens, "closes": closes, "node": len(nodes), "opened": "", "shut": ""})
            nodes.append([token, token])
        elif token == "<":
            if a := AUTOLINK.match(s, m.start()) or EMAIL.match(s, m.start()):
                mail = ":" not in a[1].split("@")[0] and "@" in a[1]
                spans.append(("autolink", m.start(), a.end(), a.start(1), a.end(1), ("mailto:" if mail else "") + a[1], None))
                nodes.append([a[1], a[0]])
                at = a.end()
            elif a := INLINE_TAG.match(s, m.start()):
                spans.append(("html", m.start(), a.end(), None, None, a[0], None))
                nodes.append(["", a[0]])
                at = a.end()
            else:
                nodes.append(["<", "<"])
        elif token[0] == "&":
            nodes.append([html.unescape(token), token])
        else:  # an address that stands by itself
            address = re.sub(r"(?:[?!.,:*_~'\"\])]|&[A-Za-z0-9]+;)+$", lambda x: x[0][: x[0].rfind(")") + 1] if x[0].count(")") and m[0].count("(") >= m[0].count(")") else "", token)
            address = address or token
            at = m.start() + len(address)
            spans.append(("autolink", m.start(), at, m.start(), at, ("http://" if address.startswith("www.") else "") + address, None))
            nodes.append([address, address])
    nodes.append([s[at:]] * 2)
    emphasize(0)
    return spans, "".join(n[0] for n in nodes), "".join(n[1] for n in nodes)


def outer_tables(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost tables of raw HTML that are closed."""
    out, depth, start = [], 0, 0
    for m in TABLE_TAG.finditer(text):
        if not m[1]:
            start = m.start() if not depth else start
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append((start, m.end()))
    return out


def layout(found: list[Block]) -> list[tuple[str, str, str]]:
    """(gap before it, start of its first line, start of its others) of each block in the canonical form.

    Items begin with a hyphen or their number, and are apart by a line end if no item of
    their list is loose.
    """
    loose = {h.group for b in found for h in b.holders if h.kind == "item" and h.loose}
    started: set[int] = set()
    out = []
    before: list[Holder] = []
    for block in found:
        first = rest = ""
        new = None
        for h in block.holders:
            mark = "> " if h.kind == "quote" else "- " if h.marker in "-+*" else f"{h.number}. "
            if h.kind == "item" and id(h) not in started:
                started.add(id(h))
                new = new or h
                first += mark
            else:
                first += mark if h.kind == "quote" else " " * len(mark)
            rest += mark if h.kind == "quote" else " " * len(mark)
        common = ""
        for a, b in zip(before, block.holders):
            if a is not b:
                break
            mark = "> " if a.kind == "quote" else "  " if a.marker in "-+*" else " " * len(f"{a.number}. ")
            common += mark
        outer = {h.group for h in before if h.kind == "item"}
        tight = new is not None and new.group not in loose and any(h.group in outer for h in block.holders if h.kind == "item") and not any(h.group in loose for h in block.holders if h.kind == "item")
        out.append(("" if not out else "\n" if tight else f"\n{common.rstrip()}\n", first, rest))
        before = block.holders
    return out


def restored(body: str) -> str:
    """A text whose code an export has escaped, with its fences and spans back; one pass over the lines.

    A line of three or more escaped backticks or tildes is a fence. A block that is
    closed loses the escapes of its lines and a tag that isn't one plain word, and its
    fence is longer than any run of its character inside; one that isn't closed stays as
    it is, but for the pairs of escaped backticks that become spans in all prose.
    """
    lines = body.split("\n")
    plain = [re.sub(r"\\([`~])", r"\1", x) if re.match(r" {0,3}(?:(?:\\?`){3,}|(?:\\?~){3,})", x) else None for x in lines]
    out: list[str] = []
    opened: tuple[int, str, str] | None = None  # (line, fence, tag)

    def prose(x: str) -> str:
        return re.sub(r"\\`([^`\\\n]*[^`\\\s][^`\\\n]*)\\`", r"`\1`", x)

    for i, (line, fence) in enumerate(zip(lines, plain)):
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", fence) if fence is not None else None
        if opened is None:
            if m and not (m[1][0] == "`" and "`" in m[2]):
                opened = i, m[1], m[2].strip()
            out.append(prose(line))
        elif m and m[1][0] == opened[1][0] and len(m[1]) >= len(opened[1]) and not m[2].strip():
            start, run, tag = opened
            inner = [re.sub(r"\\([\\`*_{}\[\]()#+.!<>~|-])", r"\1", x) for x in lines[start + 1 : i]]
            longest = max((len(r) for x in inner for r in re.findall(re.escape(run[0]) + "+", x)), default=0)
            mark = run[0] * max(3, longest + 1)
            out[start:] = [mark + (tag if re.fullmatch(r"[A-Za-z0-9_+#.-]+", tag) else ""), *inner, mark]
            opened = None
        else:
            out.append(line)
    if opened is not None:  # never closed: prose after all
        out[opened[0] :] = [prose(x) for x in lines[opened[0] :]]
    return "\n".join(out)
