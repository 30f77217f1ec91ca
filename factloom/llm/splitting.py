"""Splitting oversized items at natural boundaries (problem 10).

A text above the limit is rewritten as a proxy: one character per token, which
names the strongest boundary at the token's end.  A regular expression with
bounded quantifiers then takes pieces off the proxy: its alternatives are ordered
by the strength of the boundary, each consumes as much as the limit allows, and
single characters are the last resort.  SQL array functions turn the matches into
their lengths; summed up, these are token offsets, from which each piece looks back
by the overlap.  A piece is cut out of its text once, so the work is linear in the
text's length, however long it is.

Pieces of the same tokenizer are cut at its token ends, so a piece has as many
tokens as characters in the proxy, but for the white space at its ends; a reserve
covers that, every piece is counted again, and one that still exceeds the limit
is cut once more.

Defined results: texts within the limit (empty ones included) are one piece; null
texts are one piece with null text.  Keys may repeat; ``row`` tells them apart.
The cores (from ``core_start`` to ``core_end``, in code points) of a text's pieces
follow each other without gap and make up the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import encoding, ranks, vocabulary

LIMIT = 512
OVERLAP = 32
RESERVE = 8
#: Characters of pieces that a batch holds.
BATCH_CHARS = 8 << 20

# Boundaries by strength, as characters of the proxy: before a heading, after a
# paragraph, after a line, after a sentence, after a word, after a character, and
# inside of a character (no place to cut).
HEADING, PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER, INSIDE = "HPLSWCX"
_STRENGTH = {ord(c): i for i, c in enumerate(HEADING + PARAGRAPH + LINE + SENTENCE + WORD + CHARACTER + INSIDE)}

_IS_SPACE, _IS_END, _IS_WIDE_END, _IS_CLOSER, _IS_MARK, _IS_LINE = 1, 2, 4, 8, 16, 32
_KIND = np.zeros(0x10000, np.uint8)
_KIND[[i for i in range(0x3001) if chr(i).isspace()]] = _IS_SPACE
for _chars, _bit in ((".!?…", _IS_END), ("。！？", _IS_WIDE_END), ("\"'”’»)]", _IS_CLOSER), (".!?:;,", _IS_MARK), ("\n\r", _IS_LINE)):
    _KIND[[ord(c) for c in _chars]] |= _bit
_NUMBERED = re.compile(r"(?:[IVX]+|\d+(?:\.\d+)*)[.)]\s+[^\n]{1,80}(?:\n|$)")
_BLOCK_END = re.compile(r"</(?:p|div|li|tr|table|section|article|script|head|body)>", re.I)
_HTML_HEADING = re.compile(r"<h[1-6][\s>]", re.I)


def boundaries(text: str) -> np.ndarray:
    """The proxy character at each code point offset 0..len(text).

    Words end where white space begins or ends; sentences after a full stop (and
    closing quotes) before white space; lines and paragraphs where text begins again
    after one or more line ends.  Headings are lines that begin with #, a number or a
    heading tag, and lines of at most 80 characters without punctuation before an
    empty line.
    """
    cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(cp)
    at = np.full(n + 1, ord(CHARACTER), np.uint8)
    kind = _KIND[np.minimum(cp, 0xFFFF)]
    space = (kind & _IS_SPACE) != 0
    changes = np.flatnonzero(space[1:] != space[:-1]) + 1
    at[changes] = ord(WORD)
    # Before white space: the last character that closes nothing decides.
    before_space = changes[space[changes]]
    last = before_space - 1
    while len(closed := np.flatnonzero((kind[last] & _IS_CLOSER) != 0)) and (last[closed] > 0).any():
        last[closed] = np.maximum(last[closed] - 1, 0)
        if (last[closed] == 0).all():
            break
    at[before_space[(kind[last] & (_IS_END | _IS_WIDE_END)) != 0]] = ord(SENTENCE)
    at[np.flatnonzero((kind & _IS_WIDE_END) != 0) + 1] = ord(SENTENCE)

    line_end = (kind & _IS_LINE) != 0
    line_end[:-1] &= ~((cp[:-1] == 13) & (cp[1:] == 10))
    at_line_end = np.flatnonzero(line_end)
    begins = changes[~space[changes]]
    if len(begins):
        # The white space before a beginning starts at the change before it, or at 0.
        opened = np.searchsorted(before_space, begins) - 1
        since = np.where(opened >= 0, before_space[np.maximum(opened, 0)] if len(before_space) else 0, 0)
        gap = np.searchsorted(at_line_end, begins) - np.searchsorted(at_line_end, since)
        at[begins[gap == 1]] = ord(LINE)
        at[begins[gap > 1]] = ord(PARAGRAPH)
        if "</" in text:
            at[[m.end() for m in _BLOCK_END.finditer(text)]] = ord(PARAGRAPH)
        # Lines as [start, end), from their first solid character.
        stops = np.append(at_line_end, n)
        starts = np.append(0, at_line_end + 1)
        solid_before = np.concatenate([[0], np.cumsum(~space)])
        marks = np.flatnonzero((kind & _IS_MARK) != 0)
        after = np.append(stops[1:], n)
        letters = solid_before[stops] - solid_before[starts]
        short = (letters >= 3) & (stops - starts <= 80) & (np.searchsorted(marks, stops) == np.searchsorted(marks, starts)) & (solid_before[after] == solid_before[stops]) & (after > stops)
        solid = np.flatnonzero(~space)
        following = np.searchsorted(solid, starts)
        first = np.where(following < len(solid), solid[np.minimum(following, len(solid) - 1)], n)
        inside = (first < stops) & (letters > 0)
        heads = set(first[inside & short].tolist())
        lead = cp[np.minimum(first, n - 1)]
        heads.update(first[inside & (lead == 35)].tolist())
        maybe = inside & (stops - starts <= 100) & (((lead >= 48) & (lead <= 57)) | np.isin(lead, [73, 86, 88]))
        heads.update(p for p in first[maybe].tolist() if _NUMBERED.match(text, p))
        if "<h" in text or "<H" in text:
            heads.update(m.start() for m in _HTML_HEADING.finditer(text))
        heads.discard(0)
        at[list(heads)] = ord(HEADING)
    at[-1] = ord(HEADING)
    return at


def _token_lengths(path: str) -> np.ndarray:
    r = ranks(path)
    out = np.zeros(max(r.values()) + 1, np.int64)
    for b, i in r.items():
        out[i] = len(b)
    return out


def proxy(text: str, ids: list[int], lengths: np.ndarray) -> tuple[str, np.ndarray]:
    """A character per token, and the code point offset at which each token ends."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    lead = (raw & 0xC0) != 0x80
    ends = np.cumsum(lengths[np.asarray(ids)])
    points = np.concatenate([[0], np.cumsum(lead)])[ends]
    inside = np.append(lead, True)[ends] == False  # noqa: E712
    kind = boundaries(text)[points]
    kind[inside] = ord(INSIDE)
    return kind.tobytes().decode("ascii"), np.where(inside, points - 1, points)


def pattern(core: int, least: int) -> str:
    """Alternatives from the strongest boundary near the limit to any character."""
    half = max(core // 2, least)
    strong = [HEADING, PARAGRAPH, LINE, SENTENCE]
    alternatives = [f".{{{half - 1},{core - 1}}}{b}" for b in strong]
    alternatives += [f".{{{least - 1},{half - 1}}}{b}" for b in strong]
    alternatives += [f".{{{least - 1},{core - 1}}}{WORD}", f".{{0,{core - 1}}}[^{INSIDE}]", f".{{1,{core}}}"]
    return "(?:" + "|".join(alternatives) + ")"


def _within(text: str, spans: Iterable[tuple[int, int, int]], limit: int, enc) -> Iterator[tuple]:
    """(piece, part, start, core_start, core_end, n, text) of spans; what exceeds the limit is cut again at its strongest inner boundary.

    A core of one character whose overlap is too long keeps as much of it as fits.
    """
    for piece, span in enumerate(spans):
        part, todo = 0, [span]
        while todo:
            start, a, z = todo.pop()
            own = text[start:z]
            n = len(enc(own))
            if n > limit and z - a > 1:
                # The boundaries of the middle half, the strongest and then the most central.
                kinds = boundaries(text[a:z])[1:-1]
                at = np.arange(1, z - a)
                middle = np.abs(2 * at - (z - a)) <= (z - a + 1) // 2
                rank = np.array([_STRENGTH[k] for k in kinds])
                best = np.lexsort((np.abs(2 * at - (z - a)), rank, ~middle))[0]
                c = a + int(at[best])
                todo += [(max(start, c - (a - start)), c, z), (start, a, c)]
                continue
            if n > limit and start < a:
                todo.append(((start + a + 1) // 2, a, z))
                continue
            yield piece, part, start, a, z, n, own
            part += 1


def split_texts(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None) -> DataFrame:
    """(key, row, piece, part, start, core_start, core_end, n_tokens, piece_text) of every row of df.

    part is 0 but for pieces that had to be cut once more; (piece, part) is their order.
    """
    path = path or vocabulary()
    core = limit - overlap - RESERVE
    if core < 2 * max(1, overlap):
        raise ValueError("the overlap takes too much of the limit")
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoding(path).encode_ordinary, _token_lengths(path)
        for b in batches:
            p, e, n = [], [], []
            for t in b.column(1).to_pylist():
                ids = enc(t) if t else []
                n.append(len(ids))
                if len(ids) > limit:
                    s, ends = proxy(t, ids, lengths)
                    p.append(s)
                    e.append(ends.astype(np.int32))
                else:
                    p.append(None)
                    e.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32()), pa.array(p, pa.string()), pa.array(e, pa.list_(pa.int32()))], names=["key", "text", "row", "n", "proxy", "ends"])

    measured = rows.mapInArrow(measure, f"key {kind}, text string, row long, n int, proxy string, ends array<int>")

    # Runs in the JVM: the pieces of the proxy, as the lengths of the matches.
    sizes = F.transform(F.regexp_extract_all("proxy", F.lit(pattern(core, max(1, overlap))), F.lit(0)), lambda m: F.length(m))
    matched = measured.select("key", "row", "text", "n", "ends", sizes.alias("sizes"))
    names = ["key", "row", "piece", "part", "start", "core_start", "core_end", "n_tokens", "piece_text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Takes the pieces off the texts and counts each; batches are bounded in characters."""
        enc = encoding(path).encode_ordinary
        for b in batches:
            takes, columns, held = [], [[] for _ in names[2:]], 0

            def flush() -> pa.RecordBatch:
                at, i32 = pa.array(takes, pa.int64()), pa.int32()
                arrays = [b.column("key").take(at), b.column("row").take(at), *[pa.array(c, i32) for c in columns[:-1]], pa.array(columns[-1], pa.string())]
                return pa.RecordBatch.from_arrays(arrays, names=names)

            for i, (t, n, ends, sizes) in enumerate(zip(*[b.column(c) for c in ("text", "n", "ends", "sizes")])):
                t, n = t.as_py(), n.as_py()
                if n <= limit:
                    found = [(0, 0, 0, 0, len(t or ""), n, t)]
                else:
                    stops = np.cumsum(sizes.values.to_numpy())
                    points = np.concatenate([[0], ends.values.to_numpy()])
                    begins = np.concatenate([[0], stops[:-1]])
                    backs = np.where(begins > 0, np.maximum(begins - overlap, 0), 0)
                    found = _within(t, zip(points[backs].tolist(), points[begins].tolist(), points[stops].tolist()), limit, enc)
                for row in found:
                    takes.append(i)
                    for c, v in zip(columns, row):
                        c.append(v)
                    held += len(row[-1] or "")
                    if held > BATCH_CHARS:
                        yield flush()
                        takes, columns, held = [], [[] for _ in names[2:]], 0
            yield flush()

    exact = matched.mapInArrow(cut, f"key {kind}, row long, piece int, part int, start int, core_start int, core_end int, n_tokens int, piece_text string")
    return exact.withColumnRenamed("key", key)
