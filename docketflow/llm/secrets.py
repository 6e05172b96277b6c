r"""Secret scan that looks below nested encodings.

Base findings are those of the text itself. Beyond them a worklist decodes layers:

* the text with its percent escapes resolved, and with its ``\uXXXX``, ``\u{X}``, ``\UXXXXXXXX`` and ``\xXX`` escapes;
* the bytes of every base64 run, also of one wrapped over lines of any width, read from each of its first four characters:
  a run may be glued to a path, a sign or letters, which shifts it;
* zlib, gzip, bz2 and xz data, wherever in a run their first bytes appear, to the end of their last member;
* stretches of such bytes that are ASCII in UTF-16 or UTF-32, as plain text.

Bytes are read as Latin-1, a character each, whatever they hold: all patterns are ASCII, so text in UTF-8 or beside binary
data gives the same findings. Every new layer is scanned and decoded in turn until no new layer appears; layers seen before
(same content from the same place) are not taken up again, so data that decode to themselves end. Each character of a layer
carries the range of the original text it comes from, so findings map back.

Compressed data are read in windows of some WINDOW characters. A window ends behind a character that no finding and no
encoded run can hold, so nothing is cut; only an unbroken run longer than a window makes it grow. A text whose layers
amount to MAX_DECODED bytes, which takes data made to explode, is left there and marked: ``stopped`` is true. All others are
read to the end. A null text is treated as empty. Rows are independent; repeated rows give equal results.
"""

from __future__ import annotations

import binascii
import bz2
import functools
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docketflow.llm.rows import map_rows

KINDS = ("assign", "access", "hex")
MAX_DECODED = 1 << 30
CHUNK = 1_000_000
WINDOW = 8_000_000
MIN_BASE64 = 18

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]+[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
#: How compressed data begin in base64: gzip, bz2, xz, zlib.
_MAGIC = re.compile(rb"H4sI|Qlpo|/Td6WF|e[AFJN]")
#: ASCII in UTF-32 or UTF-16, in either byte order.
_WIDE = re.compile("(?:[^\0]\0{3}){8,}[^\0]?|(?:[^\0]\0){8,}[^\0]?")
_URLSAFE = bytes.maketrans(b"-_", b"+/")
#: By byte: whether no finding and no encoded run can hold it.
_BREAKS = np.array([not re.match(rb"""[A-Za-z0-9+/_.=%\\{}:"'\x20\t\r\n\0-]""", bytes([i])) for i in range(256)])

Span = tuple[int, str, int]


def matches(text: str) -> list[tuple[str, int, int]]:
    """Findings of one text as (kind, start, end)."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def _replaced(text: str, begin: np.ndarray, end: np.ndarray, runs: list[tuple[int, int, str, list, list]]):
    """The text with runs replaced; each new character brings its own range inside the run."""
    parts, begins, ends, at = [], [], [], 0
    for start, stop, new, offsets, stops in runs:
        parts += [text[at:start], new]
        begins += [begin[at:start], begin[start + np.asarray(offsets, int)]]
        ends += [end[at:start], end[start + np.asarray(stops, int) - 1]]
        at = stop
    return ("".join([*parts, text[at:]]), np.concatenate([*begins, begin[at:]]), np.concatenate([*ends, end[at:]]))


def _from_utf8(data: bytes) -> tuple[str, list[int], list[int]] | None:
    """Text and the byte range of each character; None if it isn't UTF-8."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    sizes = np.fromiter((len(c.encode()) for c in text), int, len(text)) if not data.isascii() else np.ones(len(text), int)
    stops = np.cumsum(sizes)
    return text, list(stops - sizes), list(stops)


def _percent(text, begin, end):
    runs = []
    for m in _PERCENT.finditer(text):
        data = bytes.fromhex(m[0].replace("%", ""))
        made = _from_utf8(data) or (data.decode("latin-1"), list(range(len(data))), list(range(1, len(data) + 1)))
        runs.append((m.start(), m.end(), made[0], [3 * x for x in made[1]], [3 * x for x in made[2]]))
    if runs:
        yield _replaced(text, begin, end, runs)


def _escapes(text, begin, end):
    runs = []
    for m in _ESCAPE.finditer(text):
        new, offsets, stops, high = "", [], [], None
        for one in _ONE.finditer(m[0]):
            code = int(next(g for g in one.groups() if g), 16)
            if high is not None and 0xDC00 <= code < 0xE000:
                new, code = new[:-1], 0x10000 + ((high - 0xD800) << 10) + code - 0xDC00
                first = offsets.pop()
                stops.pop()
            else:
                first = one.start()
            high = code if 0xD800 <= code < 0xDC00 else None
            new += chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
            offsets.append(first)
            stops.append(one.end())
        runs.append((m.start(), m.end(), new, offsets, stops))
    if runs:
        yield _replaced(text, begin, end, runs)


def _packer(data: bytes):
    """What unpacks data that begin like this; None if nothing does."""
    makers = {b"\x1f\x8b": lambda: zlib.decompressobj(31), b"BZh": bz2.BZ2Decompressor, b"\xfd7zXZ": lzma.LZMADecompressor}
    make = next((f for magic, f in makers.items() if data.startswith(magic)), None)
    if make is None and len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0:
        make = zlib.decompressobj
    return make() if make else None


def _unpack(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of compressed data, member after member, as far as it can be read; nothing if it isn't compressed."""
    packer, rest = None, b""
    for chunk in chunks:
        rest += chunk
        while rest:
            if packer is None:
                rest = rest.lstrip(b"\0")   # padding between members
                if len(rest) < 6:
                    break
                packer = _packer(rest)
                if packer is None:
                    return
            try:
                made = packer.decompress(rest, CHUNK)
                while made:
                    yield made
                    rest, full = getattr(packer, "unconsumed_tail", b""), len(made) == CHUNK
                    made = packer.decompress(rest, CHUNK) if not packer.eof and (rest or full) else b""
            except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
                return
            rest = packer.unused_data if packer.eof else getattr(packer, "unconsumed_tail", b"")
            if not packer.eof:
                break
            packer = None


def _windows(chunks: Iterable[bytes]) -> Iterator[str]:
    """The bytes as Latin-1 text, cut only behind characters that no finding and no encoded run can hold."""
    held, size, wanted = [], 0, WINDOW
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size >= wanted:
            data = b"".join(held)
            breaks = np.flatnonzero(_BREAKS[np.frombuffer(data, np.uint8)])
            at = int(breaks[-1]) + 1 if len(breaks) else 0
            if at:
                yield data[:at].decode("latin-1")
            held, size = [data[at:]], len(data) - at
            wanted = max(WINDOW, 2 * size)
    if size:
        yield b"".join(held).decode("latin-1")


class _Room:
    """How many bytes may still be decoded."""

    def __init__(self, left: int = MAX_DECODED):
        self.left = left

    def take(self, size: int) -> bool:
        self.left -= size
        return self.left > 0


def _contents(encoded: Callable[[], Iterator[bytes]], begin: int, end: int, room: _Room) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Layers of compressed data, of what is compressed inside them, and so on."""
    known: set[bytes] = set()
    for depth in itertools.count(1):
        chunks, whole, empty = encoded(), hashlib.sha256(), True
        for _ in range(depth):
            chunks = _unpack(chunks)

        def counted(chunks=chunks, whole=whole):
            nonlocal empty
            for chunk in chunks:
                empty = False
                whole.update(chunk)
                yield chunk
                if not room.take(len(chunk)):
                    return

        for text in _windows(counted()):
            for one in itertools.chain([text], (made for made, _ in _wide(text))):
                yield one, np.broadcast_to(begin, len(one)), np.broadcast_to(end, len(one))
        if empty or room.left <= 0 or whole.digest() in known:   # some data unpack to themselves
            return
        known.add(whole.digest())


def _decoded(body: bytes, at: int) -> Iterator[bytes]:
    """The bytes of a base64 run from a place on, in growing stretches."""
    size = 256
    while at < len(body):
        part = body[at:at + size]
        part = part[:-1] if len(part) % 4 == 1 else part
        if not part:
            return
        yield binascii.a2b_base64(part + b"=" * (-len(part) % 4))
        at, size = at + size, min(4 * size, CHUNK)


def _wide(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """The plain text of each stretch of wide characters, and where its characters are."""
    for m in _WIDE.finditer(text) if "\0" in text else ():
        yield m[0].replace("\0", ""), m.start() + np.flatnonzero(np.frombuffer(m[0].encode("latin-1"), np.uint8))


def _base64(text, begin, end, room):
    """The bytes of each base64 run from its first four characters on; and an iterator over the layers of compressed data."""
    for m in itertools.chain(_WRAPPED.finditer(text), _BASE64.finditer(text)):
        signs = np.frombuffer(m[0].encode(), np.uint8)
        kept = np.flatnonzero((signs > 32) & (signs != 61))
        if len(kept) < MIN_BASE64:
            continue
        at, raw = m.start() + kept, signs[kept].tobytes()
        body = raw.translate(_URLSAFE)
        for shift in range(4):
            data = b"".join(_decoded(body, shift))
            first = shift + np.arange(len(data)) * 8 // 6
            last = shift - (-np.arange(1, len(data) + 1) * 8 // 6)
            ends = end[at[np.minimum(last, len(body)) - 1]].copy()
            ends[-1] = end[m.end() - 1]   # padding belongs to the last character
            begins = begin[at[first]]
            plain = data.decode("latin-1")
            yield plain, begins, ends
            for made, places in _wide(plain):
                yield made, begins[places], ends[places]
        for magic in _MAGIC.finditer(body):
            place = magic.start()
            if next(_unpack(_decoded(body, place)), None):
                yield _contents(functools.partial(_decoded, body, place), begin[at[place]], end[m.end() - 1], room)


def layers(text: str, room: _Room | None = None):
    """Every decoded layer below ``text`` as (text, begin, end), each once."""
    room = room or _Room()
    if not ("%" in text or "\\" in text or _BASE64.search(text) or _WRAPPED.search(text)):
        return
    whole = np.arange(len(text))
    waiting, seen = [(text, whole, whole + 1)], {(text, 0, len(text))}
    while waiting and room.left > 0:
        layer = waiting.pop()
        if isinstance(layer, Iterator):   # compressed data: one window at a time
            made = [m] if (m := next(layer, None)) else []
            if made:
                waiting.append(layer)
        else:
            made = itertools.chain(_percent(*layer), _escapes(*layer), _base64(*layer, room))
        for one in made:
            if isinstance(one, Iterator):
                waiting.append(one)
                continue
            if not one[0]:
                continue
            mark = (hashlib.sha256(one[0].encode("utf-8", "replace")).digest(), int(one[1][0]), int(one[2][-1]))
            if mark in seen:
                continue
            seen.add(mark)
            yield one
            if not room.take(len(one[0])):
                return
            waiting.append(one)


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], bool]:
    """(base findings, all findings) of a text, each by start, then kind, then end; and whether it was left unread."""
    text = text or ""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(matches(text), key=order)
    found, room = set(base), _Room(MAX_DECODED)
    for layer, begin, end in layers(text, room):
        found.update((kind, int(begin[s]), int(end[e - 1])) for kind, s, e in matches(layer))
    return base, sorted(found, key=order), room.left <= 0


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _digest(text: str | None) -> tuple[int, int, int, str, str, bool]:
    base, spans, stopped = scan(text)
    counts = [sum(kind == x for x, _, _ in base) for kind in KINDS]
    return (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), stopped)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, stopped of every row."""
    return map_rows(docs.select(key, text), _digest,
                    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, stopped boolean", keep=True)


def mask(text: str | None) -> str | None:
    """The text with every finding replaced by its kind; overlapping findings become one."""
    if text is None:
        return None
    parts, at, last = [], 0, None
    for kind, start, end in scan(text)[1]:
        if last is not None and start < last:
            last = at = max(last, end)
            continue
        parts += [text[at:start], f"<{kind}>"]
        last = at = end
    return "".join([*parts, text[at:]]) if parts else text


def masked(text: Column) -> Column:
    """The column with findings masked; null stays null."""
    return F.pandas_udf(lambda texts: texts.map(mask, na_action="ignore"), StringType())(text)
