"""Charts and diagrams of a deck: parsed parts to text."""

from __future__ import annotations

import itertools
import re

from . import markdown as md

# fixed values
MOST_SERIES, MOST_POINTS, DEEPEST = 12, 60, 6
CATEGORY, SERIES = "Category", "Series"
# end of fixed values


def _words(tag) -> str:
    """All text below a tag, in order, on one line."""
    return re.sub(r"\s+", " ", _text(tag)).strip() if tag else ""


def _text(tag) -> str:
    return tag.text + "".join(_text(k) + ("\n" if k.name == "a:p" else "") for k in tag.kids)


def _points(holder) -> tuple[list[str], bool, bool]:
    """Cached values by position, whether some lie past the limit, whether some have no position."""
    values, past, bad = {}, False, False
    for pt in holder.all("c:pt") if holder else ():
        index = pt.attrs.get("idx", str(len(values)))
        if not re.fullmatch("[0-9]{1,18}", index.strip()):
            bad = True
        elif int(index) >= MOST_POINTS:
            past = True
        elif value := pt.first("c:v"):
            values[int(index)] = value.text.strip()
    return [values.get(n, "") for n in range(max(values, default=-1) + 1)], past, bad


def _named(series, number: int) -> str:
    given = series.first("c:tx")
    cached = _points(given)[0] if given and next(given.all("c:pt"), None) else [_words(given)]
    return cached[0] if cached and cached[0] else f"{SERIES} {number}"


def chart_text(space, values: bool) -> tuple[str, list[str]]:
    """Title, axis, categories and series of a chart of categories; their numbers too if ``values``. And what to tell."""
    chart = space.first("c:chart") or space
    every = list(chart.all("c:ser"))
    series = [s for s in every if s.first("c:cat") and s.first("c:val")]
    if not series:
        return "", ["a chart without categories skipped"] if every else []
    if next(chart.all("c:multiLvlStrRef"), None):
        return "", ["a chart with nested categories skipped"]
    read = series[:MOST_SERIES]
    (labels, *flags), columns = _points(read[0].first("c:cat")), [_points(s.first("c:val")) for s in read]
    names = [re.sub(r"\s+", " ", _named(s, n)) for n, s in enumerate(read, 1)]
    axis = lambda name: _words(a.first("c:title")) if (a := next(chart.all(name), None)) else ""
    header = axis("c:catAx") or CATEGORY
    told = [
        (len(series) > MOST_SERIES, f"a chart has more than {MOST_SERIES} series, the others were not read"), (len(every) > len(series), "series without categories in a mixed chart were not read"),
        (flags[0] or any(c[1] for c in columns), f"a chart has more than {MOST_POINTS} points a series, the others were not read"), (flags[1] or any(c[2] for c in columns), "chart points without a position were dropped"),
    ]
    body = ""
    if values:
        rows = itertools.zip_longest(labels, *(c[0] for c in columns), fillvalue="")
        body = md.render_table([[header, *names], *map(list, rows)]) or ""
        told.append((True, "chart numbers are those saved in the file, not the workbook's"))
    else:
        listed = [re.sub(r"\s+", " ", x) for x in labels if x]
        body = "\n".join(([f"- {header}: {', '.join(listed)}"] if listed else []) + [f"- {SERIES}: {', '.join(names)}"])
    heading = "\n".join(dict.fromkeys(x for x in (_words(chart.first("c:title")), axis("c:valAx")) if x))
    return "\n\n".join(x for x in (heading, body) if x), [text for yes, text in told if yes]


def diagram_text(model) -> str:
    """A diagram's points as a nested list, by its parent links; those that only a circle leads to come last, flat."""
    texts = {p.attrs["modelId"]: _words(p.first("dgm:t")) for p in model.all("dgm:pt") if "modelId" in p.attrs and p.attrs.get("type") not in ("pres", "doc")}
    links = {}
    for x in (model.first("dgm:cxnLst") or model).each("dgm:cxn"):
        if x.attrs.get("type", "parOf") == "parOf" and "srcId" in x.attrs and "destId" in x.attrs:
            order = x.attrs.get("srcOrd", "0")
            links[x.attrs["destId"]] = (x.attrs["srcId"], int(order) if order.isdecimal() else 0)
    below: dict[str | None, list[str]] = {}
    for point in sorted(texts, key=lambda p: links.get(p, ("", 0))[1]):  # stable: as in the file among equals
        parent = links.get(point, (None,))[0]
        below.setdefault(parent if parent in texts else None, []).append(point)
    lines, seen = [], set()
    todo = [(p, 0) for p in reversed(below.get(None, []))]
    while todo:
        point, depth = todo.pop()
        if point in seen:
            continue
        seen.add(point)
        if texts[point]:
            lines.append("  " * min(depth, DEEPEST) + f"- {texts[point]}")
        todo += [(k, depth + bool(texts[point])) for k in reversed(below.get(point, []))]
    return "\n".join(lines + [f"- {t}" for p, t in texts.items() if p not in seen and t])
