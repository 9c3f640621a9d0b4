"""A small, forgiving HTML tree."""

from __future__ import annotations

import re

# fixed values
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
# end of fixed values


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []  # kids: nodes and strings


def parse(source: str) -> Node:
    """A tree that follows the usual rules on tags left open; never fails."""
    root = Node("html")
    stack = [root]
    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else n]
        if text:
            stack[-1].kids.append(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag == "html" or tag == "body" and any(s.tag == "body" for s in stack):
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in _SIBLINGS:
            ends, within = _SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    if tag != "tr" or i == 0 or stack[-1].tag not in ends:
                        break
                elif stack[i].tag in within:
                    break
        if tag == "body" and stack[-1].tag == "head":
            stack.pop()
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
            node.kids.append(source[at : end.start() if end else n])
            at = end.start() if end else n
            if end:
                at = (source.find(">", end.start()) + 1) or n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root
