"""Packing by best-fit decreasing with a segment tree over the remaining capacities."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.session import stage

LENGTH = 1024
END_ID = 0
#: Pieces that one task packs; groups are cut by a hash so that each has about this many.
GROUP_PIECES = 50_000
#: Entries of a worker's chunk cache before it is emptied; a bound on memory only, results do not depend on it.
CACHE = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _at long"


class ChunkIds(dict):
    """Little-endian ids of text chunks that the tokenizer's pre-splitting never joins with their neighbours.

    With ``ranks``, the same vocabulary as a rank file, a chunk that is met first is encoded by the faster library of
    rank files; whole texts always go through the tokenizer itself.
    """

    def __init__(self, path: str, ranks: tuple[str, str] | None = None):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.quick = self.whole
        if ranks:
            import tiktoken

            place, pattern = ranks
            with open(place, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            coding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.quick = lambda text: struct.pack(f"<{len(ids := coding.encode_ordinary(text))}I", *ids)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        out = self.quick(chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = out
        return out

    def of(self, text: str) -> bytes:
        """Ids of the whole text. A single space before a word always starts a token, so the text may be cut there;
        texts with other runs of spaces or with a special token's string are encoded in one go."""
        if "<|" in text or "  " in text or not text.isprintable() and _odd_space(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        if not first or not rest or not rest[-1]:
            return self.whole(text)
        return self[first] + b"".join(map(self.__getitem__, [" " + x for x in rest]))


def _odd_space(text: str) -> bool:
    """Whether white space other than lone line feeds between words touches a space."""
    bare = text.replace("\n", "")
    return not bare.isprintable() or " \n" in text or "\n " in text


def token_pieces(
    batches: Iterator[pa.RecordBatch], path: str, ranks: tuple[str, str] | None, length: int
) -> Iterator[pa.RecordBatch]:
    """Full windows of each document and its rest; ids become checksums at once, so no ids are shuffled."""
    ids, at = ChunkIds(path, ranks), 0
    for batch in batches:
        out: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = ids.of(text.as_py() or "") + struct.pack("<I", END_ID)
            n = len(raw) // 4
            for start in range(0, n, length):
                piece = raw[4 * start : 4 * (start + length)]
                out.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, at))
                at += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_at"]
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


class Capacities:
    """Open windows by remaining capacity, under a segment tree of counts: the tightest that fits is found in log steps."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list] = [[] for _ in range(self.size)]

    def _count(self, room: int, change: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += change
            i >>= 1

    def put(self, room: int, window) -> None:
        self.open[room].append(window)
        self._count(room, 1)

    def tightest(self, need: int):
        """Remove and return (room, window) with the least room >= need; None if there is none."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        self._count(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], length: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece; lengths must fall."""
    rooms, out, windows = Capacities(length), [], 0
    for n in lengths:
        found = rooms.tightest(n)
        if found is None:
            found, windows = (length, windows), windows + 1
        room, window = found
        out.append((window, length - room))
        if room > n:
            rooms.put(room - n, window)
    return out


def _pack_group(table: pa.Table, length: int) -> pa.Table:
    keys = [("length", "descending"), *((k, "ascending") for k in ("doc_id", "start", "ids_crc32", "_at"))]
    table = table.sort_by(keys)
    placed = best_fit(table.column("length").to_pylist(), length)
    group = table.column("_group")[0].as_py() if table.num_rows else 0
    # the group's number stands above the window's: a group has fewer than 2**32 pieces
    sequence = pa.array([(group << 32) + w for w, _ in placed], pa.int64())
    offset = pa.array([o for _, o in placed], pa.int64())
    table = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return table.append_column("sequence_id", sequence).append_column("offset", offset)


def pack(
    docs: DataFrame,
    vocabulary: str,
    ranks: tuple[str, str] | None = None,
    length: int = LENGTH,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``ranks`` names the vocabulary's rank file and splitting pattern, if there is one. A document is cut into full windows and a rest. Pieces are dealt by a hash into groups of about ``group_pieces`` and
    each group is packed by best fit, longest first; only a group's last windows can stay far from full. Null text is an
    empty text (the end id alone); a null id stays null; repeated rows are packed each; an empty table gives no rows.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = stage(slim.mapInArrow(lambda batches: token_pieces(batches, vocabulary, ranks, length), PIECES), "pieces")
    groups = -(-pieces.count() // group_pieces) or 1
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_at"), F.lit(groups)))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(lambda table: _pack_group(table, length), out)
