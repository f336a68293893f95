"""Token ids in patched frame-of-reference files, read back with an index.

Encoding. The tokenizer splits a text into pieces before it merges bytes, and
each piece is encoded on its own. A worker therefore cuts a batch of texts into
pieces with array operations, encodes every distinct piece once with the
tokenizers library, keeps its ids in a bounded table and joins them; the ids
equal those of encoding the whole text.

File format. Documents are range-sorted by doc_id; each task writes one shard of
pages, each page holding whole documents of about ``PAGE_IDS`` ids: doc_ids,
lengths, and a payload of blocks of 128 ids. A block stores its minimum, the
differences packed at the width that holds 90 % of them, and the larger ones in
an exception list; the payload starts with the blocks' start offsets, so any
block is decoded alone. The container is Parquet in the shared folder, which
every executor can read.

    payload = "PFOR" | u32 ids | u32 blocks | u32 minimum[blocks]
            | u8 width[blocks] | u8 exceptions[blocks] | u32 start[blocks + 1]
            | blocks: 16 * width bytes of packed bits,
                      u8 position[exceptions], u32 value[exceptions]

Defined results: null and empty texts hold only the end id; a null doc_id sorts
first; repeated rows are encoded each; extra columns are ignored; an empty table
gives empty files. Texts are encoded about a million characters at a time, a longer one
alone; a document is one run of ids of its page, whatever its length.
"""

from __future__ import annotations

import codecs
import functools
import operator
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import keyed, release_memory, staging_path

BLOCK = 128
PERCENTILE = 0.9
PAGE_IDS = 1 << 16
CACHE_PIECES = 400_000        # of each of two generations, about 200 bytes a piece
PIECES_A_CALL = 64            # new pieces the library is handed at once
TOKENIZER = "byte_bpe_50k.json"
END_TEXT = "<|endoftext|>"
_ID = operator.attrgetter("id")


class _Recent:
    """A bounded table of two generations: entries not asked for any more are let go."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys) -> list:
        """Keys in neither generation; those of the old one move to the new one."""
        out = []
        for k in keys:
            code = self.old.get(k)
            if code is None:
                out.append(k)
            else:
                self.new[k] = code
        return out

    def turn(self) -> None:
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}


# byte-level vocabularies spell a byte as a letter: printable Latin-1 as itself,
# the other bytes, in order, from U+0100 on
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_LETTERS = "".join(chr(_BYTE_LETTERS.get(b, b)) for b in range(256))     # as a table of bytes, which decodes ten times as fast
_NOT_UTF8 = (0xFF, 0xFE, 0xFD, 0xFC, 0xFB, 0xFA, 0xF9, 0xF8, 0xF7, 0xF6, 0xF5, 0xC1, 0xC0)


def byte_letters(piece: str | bytes) -> str:
    """The bytes of a piece as the vocabulary spells them."""
    return codecs.charmap_decode(piece.encode() if isinstance(piece, str) else piece, "strict", _LETTERS)[0]


_OTHER, _LETTER, _NUMBER, _SPACE, _EDGE = range(5)


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each code point as the piece pattern's properties have it."""
    import regex
    kinds = np.full(0x110000, _OTHER, np.uint8)
    points = "".join(map(chr, range(0x110000)))
    for kind, property_ in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for found in regex.finditer(property_, points):
            kinds[found.start():found.end()] = kind
    return kinds


def _piece_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Marks the code points at which the pieces of ``public_tokenizers.PATTERN`` start.

    ``points`` holds texts, each followed by one code point (an edge) that stands for the
    text's end and is a piece of its own. Pieces are runs of one kind, but for three rules: a
    space joins the run after it; the last white space before a run is cut off the white
    space before it; an apostrophe that starts a piece takes an ending such as ``'re``.
    """
    kind = _kinds()[points]
    kind[edges] = _EDGE
    word, space = kind < _SPACE, kind == _SPACE
    starts = np.ones(len(points), bool)
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts[1:] &= ~(word[1:] & (points[:-1] == 32))              # after a space, which is no edge: edges are line feeds
    starts[:-1] |= space[:-1] & word[1:]
    starts[edges] = True
    starts[edges[:-1] + 1] = True
    at = np.flatnonzero((points == 39) & starts)                 # never the last: an edge follows
    one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
    size = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
    for first, second in ("re", "ve", "ll"):
        size[(one == ord(first)) & (two == ord(second))] = 2
    at, size = at[size > 0], size[size > 0]
    starts[at + 1] = False
    starts[at + size + 1] = True
    return starts


def _binary(values: list[bytes]) -> pa.Array:
    return _binary_of(b"".join(values), np.append(0, np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))))


def _binary_of(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(offsets.astype(np.int64, copy=False)), pa.py_buffer(data)])


def _buffers(array: pa.Array) -> tuple[bytes, np.ndarray]:
    """Bytes and offsets of a binary array without nulls."""
    _, offsets, data = array.buffers()
    return (data.to_pybytes() if data else b"",
            np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1])


def _slices(data: bytes, offsets: np.ndarray) -> list[bytes]:
    at = offsets.tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


class Encoder:
    """Texts to little-endian uint32 ids; the library meets every distinct piece once."""

    def __init__(self, path: str, pattern: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        self._pieces = None if pattern == public_tokenizers.PATTERN else regex.compile(pattern).findall
        self._special = array("I", [self._tokenizer.token_to_id(END_TEXT)]).tobytes() if special else None
        self._known = _Recent(CACHE_PIECES)
        self._gap = self._unmerged_byte()

    def _unmerged_byte(self) -> int | None:
        """A byte that no text holds and no merge joins: pieces on both its sides merge as if alone."""
        model = self._tokenizer.model
        if type(model).__name__ != "BPE" or any(
                getattr(model, a) for a in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            return None
        merged = set().union(*(t for t in self._tokenizer.get_vocab(False) if len(t) > 1))
        return next((b for b in _NOT_UTF8 if _LETTERS[b] not in merged and model.token_to_id(_LETTERS[b]) is not None), None)

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces the table does not hold, many to a call of the library."""
        tokenize = self._tokenizer.model.tokenize
        if self._gap is None:
            return [array("I", map(_ID, tokenize(byte_letters(p)))).tobytes() for p in pieces]
        gap, out = bytes([self._gap]), []
        gap_id = self._tokenizer.model.token_to_id(_LETTERS[self._gap])
        for a in range(0, len(pieces), PIECES_A_CALL):
            some = pieces[a:a + PIECES_A_CALL]
            ids = np.fromiter(map(_ID, tokenize(byte_letters(gap.join(some)))), "<u4")
            raw, begin = ids.tobytes(), 0
            for end in [*(4 * np.flatnonzero(ids == gap_id)).tolist(), len(raw)]:
                out.append(raw[begin:end])
                begin = end + 4
        return out

    def _cut(self, parts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of the texts in a row, and how many pieces end with each text."""
        if self._pieces:
            pieces = [self._pieces(p) for p in parts]
            return (_binary([x.encode() for ps in pieces for x in ps]),
                    np.cumsum([len(ps) for ps in pieces], dtype=np.int64))
        joined = "\n".join(parts) + "\n"
        edges = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        first = np.flatnonzero(_piece_starts(points, edges))
        ends = np.searchsorted(first, edges)                     # edges are pieces as well
        data = joined.encode()
        if len(data) > len(points):
            width = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
            first = (np.cumsum(width, dtype=np.int64) - width)[first]
        inside = np.ones(len(first), bool)
        inside[ends] = False
        return _binary_of(data, np.append(first, len(data))).filter(pa.array(inside)), ends - np.arange(len(ends))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; with ``special``, the end marker's own id for its string."""
        if not texts:
            return []
        parts = [t.split(END_TEXT) if self._special and END_TEXT in t else [t] for t in texts]
        pieces, ends = self._cut([p for ps in parts for p in ps])
        met = pieces.dictionary_encode()
        distinct = _slices(*_buffers(met.dictionary))
        self._known.turn()
        known = self._known.new
        codes = list(map(known.get, distinct))
        holes = [i for i, c in enumerate(codes) if c is None]
        lack = self._known.missing([distinct[i] for i in holes])
        known.update(zip(lack, self._encode_pieces(lack), strict=True))
        for i in holes:
            codes[i] = known[distinct[i]]
        raw, offsets = _buffers(_binary(codes).take(met.indices))
        out = iter(_slices(raw, offsets[np.append(0, ends)]))
        return [next(out) if len(ps) == 1 else self._special.join([next(out) for _ in ps]) for ps in parts]


@functools.lru_cache(maxsize=2)
def encoder(name: str, special: bool) -> Encoder:
    import public_tokenizers
    return Encoder(public_tokenizers.path(name), public_tokenizers.PATTERN, special)


def encoded_texts(batch: pa.RecordBatch, column: str, code: Encoder, chars: int = 1 << 20):
    """(row, ids) of a batch, encoded in pieces of bounded size."""
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield from enumerate(code.encode(texts[at:end]), at)
        at = end


# ------------------------------------------------------------------ PFOR pages

def pack_page(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    if blocks == 0:
        return b"PFOR" + np.array([0, 0, 0], "<u4").tobytes()
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1]
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1)
    gap = rows - low[:, None]
    rank = int(PERCENTILE * BLOCK)
    typical = np.partition(gap, rank, axis=1)[:, rank].astype(np.int64)
    width = np.frexp(typical.astype(np.float64))[1].astype(np.int64)         # bit length
    over = (gap.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    extra = over.sum(axis=1)
    start = np.zeros(blocks + 1, np.int64)
    np.cumsum(width * (BLOCK // 8) + extra * 5, out=start[1:])
    body = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width):
        if w == 0:
            continue
        mine = np.flatnonzero(width == w)
        bits = np.unpackbits(gap[mine].astype("<u4").view(np.uint8).reshape(len(mine), BLOCK, 4),
                             axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(np.ascontiguousarray(bits).reshape(len(mine), -1), axis=1, bitorder="little")
        body[start[mine][:, None] + np.arange(packed.shape[1])] = packed
    b, place = np.nonzero(over)
    if len(b):
        first = np.cumsum(extra) - extra
        turn = np.arange(len(b)) - first[b]
        tail = start[b] + width[b] * (BLOCK // 8)
        body[tail + turn] = place
        value = gap[b, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        body[(tail + extra[b] + 4 * turn)[:, None] + np.arange(4)] = value
    return b"".join([b"PFOR", np.array([n, blocks], "<u4").tobytes(), low.astype("<u4").tobytes(),
                     width.astype(np.uint8).tobytes(), extra.astype(np.uint8).tobytes(),
                     start.astype("<u4").tobytes(), body.tobytes()])


def unpack_page(page: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """Ids of a page, or of the blocks ``first_block <= i < last_block`` alone."""
    if page[:4] != b"PFOR":
        raise ValueError("not a PFOR page")
    n, blocks = (int(x) for x in np.frombuffer(page, "<u4", 2, 4))
    if blocks == 0:
        return np.zeros(0, np.uint32)
    at = 12
    low = np.frombuffer(page, "<u4", blocks, at)
    width = np.frombuffer(page, np.uint8, blocks, at + 4 * blocks).astype(np.int64)
    extra = np.frombuffer(page, np.uint8, blocks, at + 5 * blocks).astype(np.int64)
    start = np.frombuffer(page, "<u4", blocks + 1, at + 6 * blocks).astype(np.int64)
    body = np.frombuffer(page, np.uint8, offset=at + 6 * blocks + 4 * (blocks + 1))
    last_block = blocks if last_block is None else last_block
    pick = slice(first_block, last_block)
    low, width, extra, begin = low[pick], width[pick], extra[pick], start[:-1][pick]
    gap = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width):
        if w == 0:
            continue
        mine = np.flatnonzero(width == w)
        packed = body[begin[mine][:, None] + np.arange(int(w) * (BLOCK // 8))]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(mine), BLOCK, int(w))
        wide = np.zeros((len(mine), BLOCK, 32), np.uint8)
        wide[:, :, :w] = bits
        gap[mine] = np.packbits(wide, axis=2, bitorder="little").view("<u4").reshape(len(mine), BLOCK)
    if extra.any():
        b = np.repeat(np.arange(len(low)), extra)
        turn = np.arange(len(b)) - np.repeat(np.cumsum(extra) - extra, extra)
        tail = begin[b] + width[b] * (BLOCK // 8)
        value = body[(tail + extra[b] + 4 * turn)[:, None] + np.arange(4)]
        gap[b, body[tail + turn]] = np.ascontiguousarray(value).view("<u4").ravel()
    return (gap + low[:, None]).ravel()[:min(n, last_block * BLOCK) - first_block * BLOCK]


_PAGE = pa.schema([("shard", pa.int64()), ("page", pa.int64()), ("n_ids", pa.int64()),
                   ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                   ("payload", pa.binary())])
_PAGE_SQL = ("shard long, page long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary")


def write_token_pages(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = 0) -> None:
    """Encode every text and write the pages in ascending doc_id order."""
    end = array("I", [end_id]).tobytes()

    def pages(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        code = encoder(tokenizer, True)
        held, ids, size, number = [], [], 0, 0

        def page():
            data = np.frombuffer(b"".join(held), "<u4")
            lengths = [len(h) // 4 for h in held]
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "page": number, "n_ids": len(data), "doc_ids": ids, "lengths": lengths,
                  "payload": pack_page(data)}], schema=_PAGE)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, text in encoded_texts(batch, "text", code):
                held.append(text + end)
                ids.append(names[row])
                size += len(text) // 4 + 1
                if size >= PAGE_IDS:
                    yield page()
                    held, ids, size, number = [], [], 0, number + 1
        if held:
            yield page()
        release_memory()

    ordered = (keyed(docs).select("doc_id", "rk", "text").repartitionByRange("doc_id", "rk")
               .sortWithinPartitions("doc_id", "rk").select("doc_id", "text"))
    ordered.mapInArrow(pages, _PAGE_SQL).write.parquet(path)


_DOC_SQL = "shard long, page long, place long, doc_id long, first long, n_tokens long, ids_crc32 long"
_DOC = pa.schema([(n, pa.int64()) for n in ("shard", "page", "place", "doc_id", "first", "n_tokens", "ids_crc32")])


def read_token_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start over all documents before it, length, crc.

    Page starts come from the page lengths alone: a running sum within a shard
    plus the sum of the shards before it (one row per shard). Payloads are
    decoded where they are read and never shuffled.
    """
    files = spark.read.schema(_PAGE_SQL).parquet(path)

    def decode(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                ids = unpack_page(row["payload"]).astype("<u4", copy=False)
                n = len(row["lengths"])
                lengths = np.array(row["lengths"], np.int64)
                first = np.cumsum(lengths) - lengths
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * (a + m)]) for a, m in zip(first.tolist(), row["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int64()), pa.array([row["page"]] * n, pa.int64()),
                     pa.array(np.arange(n)), pa.array(row["doc_ids"], pa.int64()), pa.array(first),
                     pa.array(lengths), pa.array(crc, pa.int64())], schema=_DOC)

    per_doc = files.select("shard", "page", "doc_ids", "lengths", "payload").mapInArrow(decode, _DOC_SQL)
    sizes = files.select("shard", "page", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shard_start"))
    within = Window.partitionBy("shard").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("_page_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
              .join(shards, "shard").select("shard", "page", (F.col("_page_start") + F.col("_shard_start")).alias("_s")))
    return (per_doc.join(starts, ["shard", "page"])
            .select("doc_id", (F.col("_s") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"))


def report(docs: DataFrame, **options) -> DataFrame:
    """Write the files to the shared folder and read the documents back."""
    spark = docs.sparkSession
    path = staging_path(spark, "token-pages")
    write_token_pages(docs, path, **options)
    return read_token_pages(spark, path)
