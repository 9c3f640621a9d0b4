"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

Encoding. The encoding of a prefix of a piece is the encoding of a shorter prefix and one last token, and which
last token follows which is a property of the two alone (their joint text must encode to just them). So the
encoder needs, for each position, only the last token of the encoding up to there. The next token starts
within the longest token's length of the end: that length, computed from the merge list, is the sufficient
lookahead. Once the chains of last tokens from all positions of that window meet in one, what lies
before is stable and is emitted; only the window is held, whatever the length of the text.

Decoding. A state machine takes one token at a time: bytes become text by an incremental UTF-8 decoder, which keeps
at most an unfinished character; for vocabularies without a decoder its state is whether a token came before, as these
join their tokens with spaces.

A text is read in windows of about ``WINDOW`` characters that end before white space: what is normalised, lower-cased, split,
encoded, decoded and hashed at a time is a window (or one word, where that is longer), whatever the text's length.
Letters and numbers are those of Unicode 16.0, lower case is that of 17.0, as in the tokenizers library.

Defined results: null and empty texts have no tokens and decode to the empty string; no rows give no rows; rows
that repeat give the same tokens each; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, own_columns, trimmed

#: The longest stretch between two emissions, in units of the lookahead.
_STRIDE = 4
#: Cached words and pairs in a generation.
_CACHED = 300_000
#: Characters of a text that are handled at a time, about.
WINDOW = 1 << 16


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it is visible in Latin-1, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(free)) for b in range(256)]


class _Cache(dict):
    """A bounded cache of two generations: when the young one is full it becomes the old one, and what is used again comes back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            if len(self) >= _CACHED:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class Codec:
    """Encoder and decoder of a vocabulary file of the tokenizers library with BPE over bytes and a word end."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.spaced = spec.get("decoder") is None
        self.bytes = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(self.bytes)}
        #: Symbols of the longest token: the sufficient lookahead.
        self.lookahead = max(len(t) - len(self.end) * t.endswith(self.end) if self.end else len(t) for t in self.vocab)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.pieces, self.rare_pieces = regex.compile(pattern), regex.compile(_dated(pattern))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.follows = _Cache(self._follows)
        #: Tokens that their own text encodes to; no other token is ever emitted.
        self.solid = {t for t in self.vocab if self._merge(self._symbols_of(t)) == [t]}
        #: The sizes of such tokens, without and with the word end, by their last three symbols, large ones first; others have two or one.
        self.sizes: tuple[dict[str, tuple], dict[str, tuple]] = {}, {}
        for t in self.solid:
            ends = bool(self.end) and t.endswith(self.end)
            body = t.removesuffix(self.end) if ends else t
            got = self.sizes[ends].get(body[-3:], (2, 1))
            self.sizes[ends][body[-3:]] = tuple(sorted({*got, len(body)}, reverse=True))
        self.words = _Cache(self._chunk)

    # encoding of a piece

    def _symbols_of(self, token: str) -> list[str]:
        """The symbols that a token is merged from: characters, the last with the word end if the token has it."""
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short sequence: the pair of lowest rank first, from left to right."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min((self.rank.get(pair, 1 << 60) for pair in zip(symbols, symbols[1:])), default=1 << 60)
            if best == 1 << 60:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and self.rank.get((symbols[i], symbols[i + 1])) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _follows(self, pair: tuple[str, str]) -> bool:
        first, second = pair
        return self._merge([*self._symbols_of(first), *self._symbols_of(second)]) == [first, second]

    def stream(self, piece: str):
        """Tokens of a piece (a string over the byte alphabet), each as soon as no continuation can change it."""
        solid, follows, most, n = self.solid, self.follows, self.lookahead, len(piece)
        inner, final = self.sizes
        last: dict[int, str] = {}  # end position -> last token of the encoding up to there
        begin = {0: 0}  # end position -> start of that token
        done = 0
        for i in range(1, n + 1):
            tail = self.end if i == n else ""
            for size in (final if tail else inner).get(piece[i - 3 if i > 3 else 0 : i], (2, 1)):
                start = i - size
                if start < done or start and start not in last:
                    continue
                token = piece[start:i] + tail
                if token in solid and (start == 0 or follows[(last[start], token)]):
                    last[i], begin[i] = token, start
                    break
            if i == n or (i - done) >= _STRIDE * most:
                # the position that all chains from the window pass through
                ends = {n} if i == n else {e for e in range(max(done + 1, i - most + 1), i + 1) if e in last}
                if i == n:
                    meet = n
                else:
                    while len(ends) > 1:
                        top = max(ends)
                        ends.remove(top)
                        ends.add(begin[top])
                    meet = ends.pop()
                if meet > done:
                    out, at = [], meet
                    while at > done:
                        out.append(last[at])
                        at = begin[at]
                    yield from reversed(out)
                    if meet < n:
                        for old in range(done, meet):
                            last.pop(old, None)
                            begin.pop(old, None)
                    done = meet

    def _chunk(self, chunk: str) -> str:
        """Ids, as text, of a chunk without white space; a piece is a chunk of its own, so that one cache has both."""
        # up to U+052F all versions of Unicode agree
        pieces = (self.pieces if max(chunk) < "\u0530" else self.rare_pieces).findall(chunk)
        if len(pieces) > 1:
            return " ".join([self.words[p] for p in pieces])
        # visible ASCII stands for itself
        mapped = chunk if chunk.isascii() and chunk.isprintable() else "".join([self.bytes[b] for b in chunk.encode("utf-8", "surrogatepass")])
        return " ".join([str(self.vocab[t]) for t in self.stream(mapped)])

    # whole texts

    def windows(self, text: str):
        """The ids of each window's words, in order: one string of decimal ids for each chunk of the text."""
        at, n = 0, len(text)
        while at < n:
            to = n
            if n - at > WINDOW:
                cut = _BREAK.search(text, at + WINDOW)
                to = cut.start() if cut else n
            yield self._chunks(text[at:to])
            at = to

    def _chunks(self, text: str) -> list[str]:
        if any(x in text for x in self.special):
            out = []
            for part in self.split_special.split(text):
                if part in self.special:
                    out.append(str(self.special[part]))
                elif part:
                    out += self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if _LOWER_RARE.search(text):
                text = text.translate(_LOWER)
        chunks = text.lower().split()
        if any(x in text for x in _ODD_SPACE):  # str.split() also splits at these, which are symbols here
            chunks = [c for c in _SPACE.split(text.lower()) if c]
        return list(map(self.words.__getitem__, chunks))

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by single spaces."""
        return " ".join([ids for window in self.windows(text) for ids in window])

    def decoder(self):
        return SpacedState() if self.spaced else ByteState(self.byte, self.special)

    def decode_ids(self, ids: str) -> str:
        """Text of decimal ids; special tokens stay."""
        return "".join(self.decode_windows([ids.split(" ")] if ids else []))

    def decode_windows(self, windows):
        """The text of each window of ids, by one state machine that goes on from window to window."""
        state, names = self.decoder(), self.tokens_by_name
        for window in windows:
            yield state.push_all([names[i] for i in " ".join(window).split(" ")])
        yield state.close()

    def digests(self, text: str, keep: bool = False) -> tuple[int, str, str, list[int]]:
        """Number of tokens, SHA-256 of the ids and of the decoded text, taken window by window; with keep also the ids."""
        count, ids_hash, text_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []

        def told():
            nonlocal count
            for window in self.windows(text):
                if window:
                    joined = " ".join(window)
                    ids_hash.update((" " + joined if count else joined).encode())
                    count += joined.count(" ") + 1
                    if keep:
                        kept.extend(map(int, joined.split(" ")))
                    yield window

        for part in self.decode_windows(told()):
            text_hash.update(part.encode("utf-8", "surrogatepass"))
        return count, ids_hash.hexdigest(), text_hash.hexdigest(), kept

    @cached_property
    def tokens_by_name(self) -> dict[str, str]:
        return {str(i): t for i, t in self.token.items()}


#: Python takes these for white space, the vocabulary's pattern doesn't.
_ODD_SPACE = tuple(map(chr, range(0x1C, 0x20)))
_SPACE = re.compile("[" + "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+")


#: Where a window may end: before white space.
_BREAK = re.compile(r"[\x20\x09-\x0D]")


# fixed values: what Unicode 16.0 adds to the letters and numbers of 15.1, and 16.0 and 17.0 to the lower case (first
# and last upper-case letter, first lower-case one, distance from letter to letter). The library has these tables.
LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
LOWER_17 = ((0x1C89, 0x1C89, 0x1C8A, 1), (0xA7CB, 0xA7CB, 0x264, 1), (0xA7CC, 0xA7CE, 0xA7CD, 2), (0xA7D2, 0xA7D4, 0xA7D3, 2), (0xA7DA, 0xA7DA, 0xA7DB, 1), (0xA7DC, 0xA7DC, 0x19B, 1), (0x10D50, 0x10D65, 0x10D70, 1), (0x16EA0, 0x16EB8, 0x16EBB, 1))
# end of fixed values

#: For lower-casing: what Python's lower() doesn't know, and the sigma, whose final form the library doesn't use.
_LOWER = {a + i: b + i for a, last, b, step in LOWER_17 for i in range(0, last - a + 1, step)} | {ord("Σ"): ord("σ")}
_LOWER_RARE = re.compile("[" + "".join(map(chr, _LOWER)) + "]")


def _class_of(kind: str, added) -> str:
    """The code points of a general category as ranges of a character class: those of Python 3.13 (Unicode 15.1) and the added ones."""
    out, first = [f"\\U{a:08X}-\\U{b:08X}" for a, b in added], None
    for point in range(0x110001):
        inside = point < 0x110000 and unicodedata.category(chr(point))[0] == kind
        if inside and first is None:
            first = point
        elif not inside and first is not None:
            out.append(f"\\U{first:08X}-\\U{point - 1:08X}")
            first = None
    return "".join(out)


def _dated(pattern: str) -> str:
    """A pattern with its letters and numbers written out: the regex module has other versions of Unicode."""
    return pattern.replace(r"\p{L}", _class_of("L", LETTERS_16)).replace(r"\p{N}", _class_of("N", NUMBERS_16))


class ByteState:
    """Bytes to text, one token at a time; an unfinished character is all it keeps."""

    def __init__(self, byte: dict[str, int], special: dict[str, int]):
        self.byte, self.special = byte, special
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token: str) -> str:
        if token in self.special:
            return self.close() + token
        return self.utf8.decode(bytes([self.byte[c] for c in token]))

    def push_all(self, tokens: list[str]) -> str:
        return "".join(map(self.push, tokens))

    def close(self) -> str:
        return self.utf8.decode(b"", True)


class SpacedState:
    """Tokens joined by spaces, one at a time; whether one came before is all it keeps."""

    def __init__(self):
        self.begun = False

    def push(self, token: str) -> str:
        out = " " + token if self.begun else token
        self.begun = True
        return out

    def push_all(self, tokens: list[str]) -> str:
        out = " " + " ".join(tokens) if self.begun else " ".join(tokens)
        self.begun = True
        return out

    def close(self) -> str:
        return ""


_LOADED: dict[str, Codec] = {}


def codec(content: bytes) -> Codec:
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Codec(json.loads(content))
    return _LOADED[key]


def tokenize(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids (array<int>).

    The vocabulary file is read on the driver and sent to the executors once (1.7 MB, whatever the input).
    """
    content = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())
    rows = own_columns(docs, *keep, "text") if "text" not in keep else own_columns(docs, *keep)
    kinds = [rows.schema[c] for c in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        own = codec(content.value)
        for part in chunks(batches, "text", 2 << 20):
            done = [own.digests(t or "", with_ids) for t in part.column("text").to_pylist()]
            out = [part.column(c) for c in keep]
            out += [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array([d[3] for d in done], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(trimmed(run), ddl)
