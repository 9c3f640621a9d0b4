"""The command line: ``python -m doclathe [file ...]``. Files, standard input or the clipboard, read and cleaned by one Spark job."""

from __future__ import annotations

import argparse
import json
import os
import re
import shutil
import subprocess
import sys

from . import __version__
from .core.fixed import MOST_INPUT_BYTES, MOST_PAGES
from .core.options import Clean, Extract, parse_ranges, preset

# fixed values
CLEAN_FLAGS = {"ascii": "ascii_punctuation", "unwrap": "unwrap", "strip-markdown": "strip_markdown", "strip-emoji": "strip_emoji", "preserve-code": "preserve_code", "compact-tables": "compact_tables", "normalize-unicode": "normalize_unicode", "unescape-markdown": "unescape_markdown", "strip-media": "strip_media", "tabs-to-spaces": "tabs_to_spaces", "transcript": "transcript"}
EXTRACT_FLAGS = {"hidden": "hidden_content", "section-headings": "section_headings", "dehyphenate": "dehyphenate", "running-headers": "drop_running_headers", "tables": "preserve_tables", "chart-data": "chart_data", "diagram-text": "diagram_text"}
SHORT = {"clipboard": "c", "write": "w", "copy": "C", "json": "j", "stats": "s", "quiet": "q", "transcript": "t"}
NOT_TEXT = (".docx", ".doc", ".rtf", ".pdf", ".odt", ".pages", ".pptx", ".pptm", ".potx", ".ppt", ".key", ".odp", ".xlsx")
PASTE = (("pbpaste",), ("wl-paste", "--no-newline"), ("xclip", "-selection", "clipboard", "-o"), ("xsel", "--clipboard", "--output"))
COPY = (("pbcopy",), ("wl-copy",), ("xclip", "-selection", "clipboard"), ("xsel", "--clipboard", "--input"))
# end of fixed values


class Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise Usage(message)


def _whole(least: int):
    def parse(text: str) -> int:
        if not text.isdecimal() or int(text) < least:
            raise argparse.ArgumentTypeError(f"needs a whole number >= {least}")
        return int(text)

    return parse


def _pages(text: str):
    try:
        return tuple(parse_ranges(text))
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def parser() -> argparse.ArgumentParser:
    p = _Parser("doclathe", description="Documents to clean, compact text.", allow_abbrev=False)
    p.add_argument("files", nargs="*")

    def switch(name: str, default=None) -> None:
        short = [f"-{SHORT[name]}"] if name in SHORT else []
        p.add_argument(*short, f"--{name}", action=argparse.BooleanOptionalAction, default=default, dest=name.replace("-", "_"))

    for name in (*CLEAN_FLAGS, *EXTRACT_FLAGS, "keep-tabs"):
        switch(name)
    for name in ("clipboard", "write", "copy", "json", "stats", "quiet"):
        switch(name, False)
    for name in ("safe", "balanced", "aggressive"):
        p.add_argument(f"--{name}", action="store_const", const=name, dest="preset", default="balanced")
        p.add_argument(f"--no-{name}", action="store_true", help=argparse.SUPPRESS)
    p.add_argument("-o", "--out")
    p.add_argument("-D", "--out-dir")
    p.add_argument("--max-blank-lines", type=_whole(0))
    p.add_argument("--pages", type=_pages, default=())
    p.add_argument("--max-pages", type=_whole(1), default=MOST_PAGES)
    p.add_argument("-V", "--version", action="version", version=__version__)
    return p


def parse(argv: list[str]) -> tuple[argparse.Namespace, Extract, Clean]:
    """Arguments and the options they stand for; of equal flags the last counts, flags count over presets. Usage if they don't agree."""
    a = parser().parse_args(argv)
    value = lambda flag: getattr(a, flag.replace("-", "_"))
    explicit = {field: value(flag) for flag, field in CLEAN_FLAGS.items()} | {"max_blank_lines": a.max_blank_lines}
    if a.keep_tabs is not None:
        explicit["tabs_to_spaces"] = not a.keep_tabs
    reading = {field: on for flag, field in EXTRACT_FLAGS.items() if (on := value(flag)) is not None}
    wrong = [
        (a.out is not None and len(a.files) > 1, "--out takes one input; use --out-dir for several"),
        (a.out is not None and a.out_dir is not None, "--out and --out-dir exclude each other"),
        (a.write and (a.out is not None or a.out_dir is not None), "--write excludes --out and --out-dir"),
        (a.write and not a.files, "--write needs files"),
        (a.clipboard and a.files, "--clipboard excludes files"),
        (a.json and (a.write or a.out_dir is not None), "--json excludes --write and --out-dir"),
        (a.out is not None and os.path.splitext(a.out)[1].lower() in NOT_TEXT, f"the output is text, not {os.path.splitext(a.out or '')[1]}: name it .md"),
    ]
    for bad, message in wrong:
        if bad:
            raise Usage(message)
    return a, Extract(pages=a.pages, most_pages=a.max_pages, **reading), preset(a.preset, **explicit)


def output_name(source: str, kind: str) -> str:
    if source.startswith("<"):
        return source.strip("<>") + ".md"
    base = os.path.basename(source)
    stem, ext = os.path.splitext(base)
    return base if ext and kind in ("text", "markdown") else stem + ".md"


def output_names(sources: list[tuple[str, str]]) -> list[str]:
    """Names for (source, format) inputs, distinct whatever the case: the first keeps its own, later ones get their folder's name or a number."""
    taken: set[str] = set()
    out = []
    for source, kind in sources:
        name = output_name(source, kind)
        stem, ext = os.path.splitext(name)
        folder = os.path.basename(os.path.dirname(source))
        tries = [name, f"{folder}-{name}"] if folder not in ("", ".") else [name]
        n = 2
        while tries[0].lower() in taken:
            tries.pop(0)
            if not tries:
                tries, n = [f"{stem}-{n}{ext}"], n + 1
        taken.add(tries[0].lower())
        out.append(tries[0])
    return out


def _tool(tools, give: bytes | None = None) -> bytes:
    for tool in tools:
        if shutil.which(tool[0]):
            return subprocess.run(tool, input=give, stdout=None if give is not None else subprocess.PIPE, check=True).stdout or b""
    raise OSError("no clipboard tool is installed")


def _inputs(a, spark, stdin):
    """(source, content) of what is asked for, by name; a file that isn't there has no content."""
    from pyspark.sql import functions as F

    if not a.files:
        if not a.clipboard and stdin.isatty():
            raise Usage("no input: give a file, a pipe or --clipboard")
        body = _tool(PASTE) if a.clipboard else stdin.buffer.read(MOST_INPUT_BYTES + 1)
        return spark.createDataFrame([("<clipboard>" if a.clipboard else "<stdin>", bytearray(body))], "source string, content binary")
    there = {os.path.abspath(f): f for f in a.files if os.path.isfile(f)}
    asked = spark.createDataFrame([(f, os.path.abspath(f)) for f in a.files], "source string, _path string")
    if not there:
        return asked.select("source", F.lit(None).cast("binary").alias("content"))
    literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in there]  # names, not patterns
    files = spark.read.format("binaryFile").load(literal).select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), F.when(F.col("length") <= MOST_INPUT_BYTES, F.col("content")).alias("content"))
    return asked.join(files, "_path", "left").select("source", "content")


def _stats_line(stats) -> str:
    def change(m) -> str:
        share = round((m["after"] - m["before"]) / m["before"] * 100) if m["before"] else 0
        return f"{'+' if share > 0 else ''}{share}%"

    c, t = stats["chars"], stats["tokens"]
    return f"{c['before']:,} chars -> {c['after']:,} ({change(c)})  ~{t['before']:,} -> ~{t['after']:,} tokens ({change(t)})"


def run(argv: list[str], spark=None, stdin=None, stdout=None, stderr=None) -> int:
    """0, or 1 if an input or output failed, or 2 for arguments that don't agree. One bad input doesn't stop the others."""
    stdin, stdout, stderr = stdin or sys.stdin, stdout or sys.stdout, stderr or sys.stderr

    def say(*words) -> None:
        print("doclathe:", *words, file=stderr)

    try:
        a, reading, cleaning = parse(argv)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        from .core.transcript import looks_like_transcript
        from .sources import files

        rows = {r["source"]: r for r in files.process(_inputs(a, spark, stdin), reading, cleaning).collect()}  # as many as arguments
    except Usage as e:
        say(e)
        print(parser().format_usage(), end="", file=stderr)
        return 2
    except OSError as e:
        say(e)
        return 1
    failed, good = False, []
    for source in dict.fromkeys(a.files) or rows:
        row = rows[source]
        if row["error"]:
            say(f"{source}: {row['error'] if os.path.isfile(source) or not a.files else 'no such file'}")
            failed = True
            continue
        good.append(row)
        if not a.quiet:
            for warning in row["warnings"]:
                say(f"{os.path.basename(source)}: {warning}")
            if a.stats and not cleaning.transcript and looks_like_transcript(row["text"]):
                say("this looks like a transcript: --transcript drops its time stamps and joins turns")
    if a.json:
        entries = [{"source": r["source"], "format": r["format"], "text": r["text"], "stats": r["stats"].asDict(True), "warnings": r["warnings"]} for r in good]
        payload = json.dumps(entries[0] if len(entries) == 1 else entries, indent=2, ensure_ascii=False) + "\n"
    else:
        payload = ""
        for r in good:
            payload += ("\n" if payload.endswith("\n") else "\n\n") + f"--- {os.path.basename(r['source'])} ---\n\n" if r is not good[0] else ""
            payload += r["text"]
    try:
        if good:
            failed |= _deliver(a, good, payload, stdout, say)
    except OSError as e:
        say(e)
        failed = True
    if a.stats and not a.quiet:
        for r in good:
            say(f"{os.path.basename(r['source'])}: {_stats_line(r['stats'])}")
            for s in r["sections"]:
                say(f"  {s['index']:>3}. {s['label'] or '':<30} {s['chars']:,} chars")
        if len(good) > 1:
            total = {m: {k: sum(r["stats"][m][k] for r in good) for k in ("before", "after")} for m in ("chars", "tokens")}
            say(f"total: {_stats_line(total)}")
    return int(failed)


def _deliver(a, good, payload: str, stdout, say) -> bool:
    """Writes to where it is asked for, to standard output if nowhere; whether something was refused."""
    def write(path: str, text: str) -> None:
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)

    refused = False
    if a.write:
        for r in good:
            if r["format"] in ("text", "markdown"):
                write(r["source"], r["text"])
            else:
                say(f"{r['source']}: a {r['format']} file isn't overwritten with text; use --out-dir")
                refused = True
    elif a.out_dir is not None:
        os.makedirs(a.out_dir, exist_ok=True)
        for r, name in zip(good, output_names([(r["source"], r["format"]) for r in good])):
            if not a.quiet and name != output_name(r["source"], r["format"]):
                say(f"{os.path.basename(r['source'])}: written as {name}")
            write(os.path.join(a.out_dir, name), r["text"])
    elif a.out is not None:
        write(a.out, payload)
    if a.copy:
        _tool(COPY, payload.encode())
    if not (a.write or a.copy or a.out is not None or a.out_dir is not None):
        stdout.write(payload)
    return refused
