"""Byte-level BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .blocks import BLOCK_BYTES, block_count, dealt
from .common import fenced, fields_of, materialize, unfenced

#: A chunk ends where the low bits of the rolling hash of the last 32 bytes are zero: every 2 KiB on average.
CUT_MASK = np.uint32(2047)
LEAST_CHUNK, MOST_CHUNK = 256, 16384
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


_LONG_BLANK = regex.compile(r"\p{White_Space}{1000,}+")


class Coder:
    """A byte-level vocabulary: plain encoding of a piece of text, bytes of ids, and the special tokens found in texts."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = {k.encode(): v for k, v in special.items()}
        self.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        for token, rank in self.special.items():
            self.sizes[rank] = len(token)

    def plain(self, piece: bytes) -> list[int]:
        """Long runs of white space are cut out first, as the pre-tokenizer's look-ahead overflows its stack on them: all of a
        run but the last character, before something else, is one token's text."""
        text = piece.decode()
        if not (runs := list(_LONG_BLANK.finditer(text))):
            return self.encoding.encode_ordinary(text)
        out, pos = [], 0
        for m in runs:
            end = m.end() - (m.end() < len(text))
            out += self.encoding.encode_ordinary(text[pos : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end].encode())
            pos = end
        return out + self.encoding.encode_ordinary(text[pos:])

    def pieces(self, text: bytes) -> list[bytes | int]:
        """The text without special tokens, these as ids."""
        out: list[bytes | int] = [text]
        for token, rank in self.special.items():
            if token in text:
                out = [y for x in out for y in ([x] if isinstance(x, int) else [z for part in x.split(token) for z in (part, rank)][:-1])]
        return [x for x in out if x != b""]


@lru_cache(2)
def coder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> Coder:
    return Coder(ranks_path, pattern, dict(special))


def chunks(piece: bytes) -> list[bytes]:
    """Cut at content-defined places, never inside a character."""
    n = len(piece)
    if n <= LEAST_CHUNK:
        return [piece]
    data = np.frombuffer(piece, np.uint8)
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):  # each doubles the window
        h[step:] += h[:-step] << np.uint32(step)
    cuts = np.flatnonzero(((h[:-1] & (CUT_MASK << np.uint32(16))) == 0) & (data[1:] & 0xC0 != 0x80)) + 1
    out, start = [], 0
    for cut in [*cuts.tolist(), n]:
        while cut - start > MOST_CHUNK:
            end = start + MOST_CHUNK
            while data[end] & 0xC0 == 0x80:
                end -= 1
            out.append(piece[start:end])
            start = end
        if cut - start >= LEAST_CHUNK or cut == n:
            out.append(piece[start:cut])
            start = cut
    return [x for x in out if x]


# Places where the pre-tokenizer starts a new token whatever stands around: a run of letters, digits or other signs ends there (an
# apostrophe may go on with a letter). After white space it depends on what follows.
_SIGN = r"[^\s\p{L}\p{N}\p{C}]"
_STARTS = rf"(?<=\p{{L}})(?=\P{{L}})|(?<=\p{{N}})(?=\P{{N}})|(?<={_SIGN})(?=[\s\p{{N}}])|(?<=(?!'){_SIGN})(?=\p{{L}})"
_FIRST, _LAST = regex.compile(_STARTS), regex.compile("(?r)" + _STARTS)


def sure_starts(piece: bytes) -> tuple[int, int] | None:
    """The first and the last sure start of a token inside a piece, as byte offsets; None without one."""
    text = piece.decode()
    first = _FIRST.search(text)
    if not first:
        return None
    return tuple(len(text[: m.start()].encode()) for m in (first, _LAST.search(text)))


def encode_chunks(c: Coder, pieces: list[bytes], ids_of) -> np.ndarray:
    """Ids of joined pieces from the ids of each; joins are repaired by encoding anew what lies around them.

    At each join the text from the last sure start of a token before it to the first one after it is encoded anew. Both must fall
    on token borders of the pieces' own ids; where they don't agree, or a piece has no sure start at all, the piece is taken in
    too, and all that is held so is encoded once, when the next sure start is met or the text ends.
    """
    kind = np.uint16 if len(c.sizes) <= 65536 else np.uint32
    done: list[np.ndarray] = []
    held: list[bytes] = []
    for k, piece in enumerate(pieces):
        starts = sure_starts(piece)
        first = 0 if k == 0 else starts[0] if starts else -1
        last = len(piece) if k + 1 == len(pieces) else starts[1] if starts else -1
        inside = None
        if 0 <= first < last:
            ids = ids_of(piece)
            ends = np.concatenate([[0], np.cumsum(c.sizes[ids])])
            i, j = np.searchsorted(ends, (first, last)).tolist()
            inside = ids[i:j] if ends[i] == first and ends[min(j, len(ends) - 1)] == last else None
        if inside is None:
            held.append(piece)
            continue
        if first or held:
            done.append(np.array(c.plain(b"".join([*held, piece[:first]])), kind))
        done.append(inside)
        held = [piece[last:]] if last < len(piece) else []
    if held:
        done.append(np.array(c.plain(b"".join(held)), kind))
    return np.concatenate(done) if done else np.empty(0, kind)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], text: str = "text", keep: tuple[str, ...] = ("ids", "decoded_text"), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row without its text, with n_tokens, ids_sha256, decoded_sha256 and, as asked for in ``keep``, ids and decoded_text.

    Texts are cut into content-defined chunks. A chunk that documents share is encoded once: in the block of documents that
    owns it, if several blocks hold it, whose ids then go to the others. ids_sha256 is over the decimal ids joined by commas,
    decoded_sha256 over the UTF-8 of the text decoded from the ids (bytes that are no UTF-8 become U+FFFD).

    Null and empty texts have no tokens. Each of repeated rows is encoded. An empty table gives an empty result. Columns named
    like a result are replaced, all others carried along, whatever their names. Time grows with the text even where it has no
    place to cut it (digits, one letter, unspaced scripts): what is held there is encoded once.
    """
    results = ("n_tokens", "ids", "ids_sha256", "decoded_text", "decoded_sha256")
    rows, inner, outer = fenced(docs, {text: "text"}, (text, *results))
    blocks, _ = block_count(rows, "text", block_bytes)
    blocked = dealt(rows, "text", blocks, inner)
    spec = tuple(special.items())
    own = lambda: coder(ranks_path, pattern, spec)  # noqa: E731  in the worker
    wide = max([65535, *special.values()]) > 65535
    kind = np.uint32 if wide else np.uint16

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = own()
        for batch in batches:
            seen = {(block.as_py(), xxh3_128_digest(x)) for block, t in zip(batch.column(0), batch.column(1), strict=True) for p in c.pieces(t.as_py()) if not isinstance(p, int) for x in chunks(p)}
            cols = list(zip(*sorted(seen), strict=True)) if seen else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["block", "h"])

    def owned(table: pa.Table, wanted: pa.Table) -> pa.Table:
        c, left, out = own(), set(wanted["h"].to_pylist()), []
        for t in table["body"]:
            if not left:
                break
            for p in c.pieces(t.as_py()):
                for x in [] if isinstance(p, int) else chunks(p):
                    if (h := xxh3_128_digest(x)) in left:
                        left.remove(h)
                        out.append((h, np.array(c.plain(x), kind).tobytes()))
        return pa.table({"h": pa.array([x[0] for x in out], pa.binary()), "ids": pa.array([x[1] for x in out], pa.binary())})

    fields = [*fields_of(rows, inner), "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    fields += ["ids array<int>"] * ("ids" in keep) + ["decoded_text string"] * ("decoded_text" in keep)
    added = [f.split()[0] for f in fields[len(inner) :]]

    def encode(table: pa.Table, told: pa.Table) -> pa.Table:
        c = own()
        known = {h.as_py(): np.frombuffer(x.as_py(), kind) for h, x in zip(told["h"], told["ids"], strict=True)}

        def ids_of(x: bytes) -> np.ndarray:
            h = xxh3_128_digest(x)
            if (ids := known.get(h)) is None:
                ids = known[h] = np.array(c.plain(x), kind)
            return ids

        n, all_ids, shas, texts, back = [], [], [], [], []
        names = _decimals(len(c.sizes))
        for t in table["body"]:
            got = [np.array([p], kind) if isinstance(p, int) else encode_chunks(c, chunks(p), ids_of) for p in c.pieces(t.as_py())]
            ids = np.concatenate(got) if got else np.empty(0, kind)
            n.append(len(ids))
            listed = ids.tolist()
            shas.append(hashlib.sha256(b",".join(map(names.__getitem__, listed))).hexdigest())
            text_back = c.encoding.decode_bytes(listed).decode("utf-8", "replace")
            back.append(hashlib.sha256(text_back.encode()).hexdigest())
            if "ids" in keep:
                all_ids.append(ids)
            if "decoded_text" in keep:
                texts.append(text_back)
        out = {**{x: table[x] for x in inner}, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
        if "ids" in keep:
            flat = np.concatenate(all_ids).astype(np.int32) if all_ids else np.empty(0, np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat))
        if "decoded_text" in keep:
            out["decoded_text"] = pa.array(texts, pa.string())
        return pa.table(out)

    held = materialize(blocked.select("block", "body").mapInArrow(hashes, "block long, h binary").distinct())
    shared = held.groupBy("h").agg(F.min("block").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    wanted = shared.select(F.col("owner").alias("block"), "h")
    book = materialize(blocked.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(owned, "h binary, ids binary"))
    told = held.join(book, "h").select("block", "h", "ids")
    out = blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(encode, ", ".join(fields))
    return unfenced(out, inner, outer, added)


@lru_cache(2)
def _decimals(n: int) -> list[bytes]:
    return [str(i).encode() for i in range(n)]
