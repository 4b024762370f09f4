"""Secrets in texts, also under layers of URL, Unicode-escape, base64 and compressed encoding.

A worklist holds layers: a text with, for each of its characters, the span of the original text it came
from. Base64 is read from single runs, from runs joined over single line ends (standing for the whole block), and
from inside a run, after '/', '-' and '_', where other characters are glued to it; compressed bytes also from percent-encoded
runs. A run of under 16 characters holds too few for any secret. A layer is scanned, then every decoder that finds something to
unwrap in it adds a layer; a layer whose text was seen before for the same part of the original is not added again (so cycles
end), and the work ends when the list is empty. Spans found in a layer are mapped to code points of the original.

Each decoder shortens its input except decompression, which is held to ``MAX_INFLATED`` bytes a text against
decompression bombs (equal streams are inflated and charged once). A text that meets this guard says so in
``inflate_limit_hit``, and redaction takes the whole of a token that was cut short. Of a damaged stream, the part before the
damage is read.

Edge cases: null and empty texts have no secrets. Base matches always stay, in whatever layers.
"""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import io
import lzma
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm._shared import prepare, read_table

#: Bytes inflated at a time.
PIECE = 1 << 20
KINDS = ("assign", "access", "hex")
MAX_INFLATED = 64 << 20


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(
    "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_HINT = re.compile("[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Kk][Ee][Yy]")
# a run shorter than the floor fails whole, and so does every part of it: the floor can stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# runs joined over single line ends; possessive, and begun at a run's start alone, so prose costs one pass
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
# percent-encoded gzip, bzip2, xz, zstd and zlib streams
_PACKED = re.compile(
    r"(?:%1[Ff]%8[Bb]|BZh[1-9]|%[Ff][Dd]7zXZ|(?:%28|\()%[Bb]5(?:%2[Ff]|/)%[Ff][Dd]|(?:%78|x)%(?:01|5[Ee]|9[Cc]|[Dd][Aa]))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~+()!*'/-])*"
)
_GLUE = re.compile("[/_-]")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
# decoded text of at least the shortest secret's length
_READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){16,}")


def scan(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base matches, by start and kind."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return [(s, KINDS[k], e) for s, k, e in out]


class _Layer:
    """A text; start[i]:end[i] is what its i-th character stands for in the original.

    Two numbers say that every character stands for the same span, None that it stands for itself.
    """

    def __init__(self, text: str, start=None, end=None) -> None:
        self.text, self.start, self.end = text, start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        if isinstance(self.start, int):
            return self.start, self.end
        return int(self.start[a]), int(self.end[b - 1])

    def key(self) -> bytes:
        """What tells a layer from others: its text and the spans."""
        made = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for x in (self.start, self.end):
            made.update(b"|" + (str(x).encode() if x is None or isinstance(x, int) else x.tobytes()))
        return made.digest()

    def inside(self, text: str, a: int, b: int) -> _Layer:
        """A layer of what the characters a:b hold."""
        return _Layer(text, *self.span(a, b))

    def replaced(self, parts: list[tuple[int, int, str]]) -> _Layer:
        """The layer with (a, b, new text) put in."""
        texts, at = [], 0
        for a, b, new in parts:
            texts += [self.text[at:a], new]
            at = b
        texts.append(self.text[at:])
        text = "".join(texts)
        if isinstance(self.start, int):
            return _Layer(text, self.start, self.end)
        n = len(self.text)
        start = np.arange(n) if self.start is None else self.start
        end = np.arange(1, n + 1) if self.end is None else self.end
        starts, ends, at = [], [], 0
        for a, b, new in parts:
            s, e = self.span(a, b)
            starts += [start[at:a], np.full(len(new), s)]
            ends += [end[at:a], np.full(len(new), e)]
            at = b
        starts.append(start[at:])
        ends.append(end[at:])
        return _Layer(text, np.concatenate(starts), np.concatenate(ends))


def _zlib_head(data: bytes) -> bool:
    return len(data) > 2 and data[0] & 0x0F == 8 and (data[0] << 8 | data[1]) % 31 == 0


def _compressed(data: bytes) -> bool:
    return _zlib_head(data) or data.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd"))


def _pieces(data: bytes) -> Iterator[bytes]:
    """What a stream inflates to, in pieces; ends, or raises, where the stream is damaged."""
    if data[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=io.BytesIO(data))
    elif data[:3] == b"BZh":
        stream = bz2.BZ2File(io.BytesIO(data))
    elif data[:6] == b"\xfd7zXZ\x00":
        stream = lzma.LZMAFile(io.BytesIO(data))
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data))
    else:
        plain, at = zlib.decompressobj(), 0
        while at < len(data) and not plain.eof:  # little by little, so that damage costs little of what stands before it
            part = plain.decompress(data[at : at + 256], PIECE)
            at += 256
            while part:
                yield part
                part = plain.decompress(plain.unconsumed_tail, PIECE) if plain.unconsumed_tail else b""
        return
    while part := stream.read1(PIECE) if hasattr(stream, "read1") else stream.read(PIECE):
        yield part


def _inflate(data: bytes, room: int) -> tuple[bytes, bool] | None:
    """(plain bytes, whether ``room`` cut them short), or None if nothing comes out."""
    parts, size = [], 0
    try:
        for part in _pieces(data):
            parts.append(part)
            size += len(part)
            if size > room:
                break
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
        pass  # looks like a stream but is none, is cut short, or other characters follow: what came before stays
    got = b"".join(parts)
    return (got[:room], size > room) if got else None


class _Work:
    """What the layers of one text share: the guard against bombs, what streams inflated to, and the spans of those cut short."""

    def __init__(self) -> None:
        self.room, self.known, self.cut = MAX_INFLATED, {}, set()

    def opened(self, data: bytes, span: tuple[int, int]) -> str | None:
        """The text in ``data``, through any number of compressions."""
        met = set()
        while (plain := _plain(data)) is None:
            key = hashlib.blake2b(data, digest_size=16).digest()
            if key in met or not _compressed(data):
                return None
            met.add(key)
            if key not in self.known:
                self.known[key] = got = _inflate(data, self.room)
                if got:
                    self.room = max(1, self.room - len(got[0]))
            if (got := self.known[key]) is None:
                return None
            data, short = got
            if short:
                self.cut.add(span)
        return plain


def _plain(data: bytes) -> str | None:
    """Bytes as text, if they are UTF-8 (or UTF-16 with a mark) and mostly printable."""
    try:
        text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8")
    except UnicodeDecodeError as error:
        # a cut stream may end inside a character
        if error.reason != "unexpected end of data" or error.start < len(data) - 3 or error.start == 0:
            return None
        text = data[: error.start].decode("utf-8")
    odd = sum(1 for c in text if not (c.isprintable() or c in "\t\r\n"))
    return text if text and odd * 10 <= len(text) else None


def _unbase64(token: str) -> bytes | None:
    core = token.rstrip("=").translate(_STANDARD)
    if len(core) % 4 == 1:
        return None
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4), validate=True)
    except ValueError:
        return None


_STANDARD = str.maketrans("-_", "+/")


def _restarts(token: str, starts: list[int]) -> list[tuple[int | None, int, bytes, bool]]:
    """(restart or None, first character, bytes, whether they begin a stream) inside a token that other characters may be glued to.

    The token is decoded at its four alignments, once each: a restart's bytes are the end of its alignment's. Readable
    text is taken wherever it stands, streams and UTF-16 where a restart has their mark.
    """
    core = token.rstrip("=").translate(_STANDARD)
    out = []
    for a in range(4):
        part = core[a:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        out += [(None, a + m.start() // 3 * 4, m[0], False) for m in _READABLE.finditer(data)]
        for o in starts:
            if o % 4 == a:
                at = (o - a) // 4 * 3
                head = data[at : at + 6]
                if _compressed(head) or head.startswith((b"\xff\xfe", b"\xfe\xff")):
                    out.append((o, o, data[at:], True))
    return out


def _glued(layer: _Layer, a: int, b: int, token: str, starts: list[int], whole: bool, work: _Work) -> list[_Layer]:
    """Layers of a token's restarts; they stand for the token from the restart on, or for the ``whole`` of it."""
    out = []
    for _, first, data, stream in _restarts(token, starts):
        begin = 0 if whole else max((o for o in starts if o <= first and (o - first) % 4 == 0), default=first)
        plain = work.opened(data, layer.span(a + begin, b)) if stream else data.decode("utf-8", "replace")
        if plain:
            out.append(layer.inside(plain, a + begin, b))
    return out


def unwrap(layer: _Layer, work: _Work) -> list[_Layer]:
    """The layers one step further in: one for URL and Unicode escapes each, one for each base64 token and percent-encoded stream."""
    text, out = layer.text, []
    if "%" in text:
        parts = []
        for m in _PERCENT.finditer(text):
            raw = bytes.fromhex(m[0].replace("%", ""))
            at = m.start()
            try:  # escapes of ASCII stand one by one; others as a whole run
                new = raw.decode("ascii")
                parts += [(at + 3 * i, at + 3 * i + 3, c) for i, c in enumerate(new)]
            except UnicodeDecodeError:
                parts.append((at, m.end(), raw.decode("utf-8", "replace")))
        if parts:
            out.append(layer.replaced(parts))
        for m in _PACKED.finditer(text):
            plain = work.opened(unquote_to_bytes(m[0].replace("+", " ")), layer.span(m.start(), m.end()))
            if plain:
                out.append(layer.inside(plain, m.start(), m.end()))
    if "\\" in text or "&#" in text:
        parts = []
        for m in _ESCAPE.finditer(text):
            code = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
            if code < 0x110000 and not 0xD800 <= code < 0xE000:
                parts.append((m.start(), m.end(), chr(code)))
        if parts:
            out.append(layer.replaced(parts))
    for m in _BASE64.finditer(text):
        data = _unbase64(m[0])
        plain = None if data is None else work.opened(data, layer.span(m.start(), m.end()))
        if plain:
            out.append(layer.inside(plain, m.start(), m.end()))
        out += _glued(layer, m.start(), m.end(), m[0], [x.end() for x in _GLUE.finditer(m[0])], False, work)
    for m in _WRAPPED.finditer(text):
        lines = _BREAK.split(m[0])
        token = "".join(lines)
        if len(token) >= 16:
            begins = np.cumsum([0, *map(len, lines[:-1])]).tolist()
            starts = sorted({*begins, *(x.end() for x in _GLUE.finditer(token))})
            out += _glued(layer, m.start(), m.end(), token, starts, True, work)
    return out


def find_secrets(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], list[tuple[int, int]]]:
    """(base matches, all matches, spans of tokens that the inflation guard cut short)."""
    base, whole = scan(text), _Layer(text)
    found, work = set(base), _Work()
    todo, seen = unwrap(whole, work), {whole.key()}
    while todo:
        layer = todo.pop()
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        for a, kind, b in scan(layer.text):
            s, e = layer.span(a, b)
            found.add((s, kind, e))
        todo += unwrap(layer, work)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(found, key=lambda x: (x[0], order[x[1]], x[2])), sorted(work.cut)


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, counts of the base kinds, digest of the base spans, all spans. One pass, no shuffle."""
    prepare(docs.sparkSession)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, inflate_limit_hit boolean")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every, cut = find_secrets(t or "")
            kinds = [k for _, k, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), bool(cut)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "inflate_limit_hit"])

    out = docs.select(F.col(id_col).alias("id"), scanned(F.col(text_col).cast("string")).alias("s"))
    return out.select(F.col("id").alias(id_col), "s.*")


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every secret span, and every token the guard cut short, merged where they overlap, replaced by ``mark``."""
    if not text:
        return text
    _, every, unread = find_secrets(text)
    spans = sorted([(s, e) for s, _, e in every] + unread)
    out, at = [], 0
    for s, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redact_column():
    """A column function: text -> text without secrets."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t) for t in texts], dtype=object)

    return clean


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return secret_spans(read_table(spark, sf_dir, "documents"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars follows the new text."""
    prepare(spark)
    out = docs.withColumn("text", redact_column()("text"))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))).select(docs.columns)
