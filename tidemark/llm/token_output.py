"""Token ids in a binary file format: Simple-8b words in blocks of whole documents.

The output is a folder of Parquet files; a row is one block:

* ``shard``, ``block``: the place in the order of documents; ``before``: ids of the shard's earlier blocks,
* ``doc_ids`` and ``counts``: the documents of the block and how many ids each has,
* ``payload``: ``S8B1``, the number of ids and the number of words (32 bits each, little-endian), then the
  words (64 bits each, little-endian).

The upper four bits of a word select how the lower sixty are cut (``SHAPES``: so many ids of so many
bits, the first id lowest); selector 15 is the escape for an id of more than sixty bits, which follows
whole in the next word; selector 14 is not used.  The last word of a block may be cut short by the number
of ids.  Because ``before`` and ``counts`` give every document's place, blocks are decoded on their own
and in any order, all words of one selector at a time.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, stored, text_session

# (ids, bits) by selector.
SHAPES = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
MAGIC = b"S8B1"
BLOCK_BYTES = 2_000_000
END_ID = 2
_U = np.uint64
_SMALL = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or ids.max() < 1 << 16:
        return _SMALL[ids.astype(np.uint16)]
    out = _SMALL[ids & _U(0xFFFF)]
    for shift in (16, 32, 48):
        part = (ids >> _U(shift)) & _U(0xFFFF)
        if part.any():
            out = np.where(part > 0, _SMALL[part] + np.uint8(shift), out)
    return out


def _reach(bits: np.ndarray) -> np.ndarray:
    """For every id, the selector of the word that would start there: the one that takes most ids."""
    n = len(bits)
    widest = {1: np.concatenate((bits, np.zeros(64, np.uint8)))}  # largest bit length among the next k ids

    def wider(k: int) -> np.ndarray:
        if k not in widest:
            half = max(x for x in widest if x < k)
            rest = wider(k - half) if k - half in widest else widest[max(x for x in widest if x <= k - half)]
            if k - half in widest:
                joined = np.maximum(widest[half][:n + 64 - k], rest[half:half + n + 64 - k])
            else:
                joined = np.maximum(widest[half][:n + 64 - k], widest[half][k - half:n + 64 - half])
            widest[k] = np.concatenate((joined, np.zeros(k, np.uint8)))
        return widest[k]

    chosen = np.full(n, ESCAPE, np.uint8)
    for selector in range(len(SHAPES) - 1, -1, -1):
        count, width = SHAPES[selector]
        chosen[wider(count)[:n] <= width] = selector
    return chosen


def pack(ids: np.ndarray) -> bytes:
    """One block's payload."""
    ids = np.ascontiguousarray(ids, _U)
    selectors = _reach(_bit_lengths(ids))
    counts = np.ones(16, np.int64)
    counts[:len(SHAPES)] = [c for c, _ in SHAPES]
    steps = counts[selectors].tolist()
    at, n, starts = 0, len(ids), []
    while at < n:  # the one sequential walk, a step per word
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    chosen = selectors[starts]
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(chosen == ESCAPE)[:-1])) if len(starts) else starts
    words = np.zeros(len(starts) + int((chosen == ESCAPE).sum()), _U)
    padded = np.concatenate((ids, np.zeros(64, _U)))
    for selector, (count, width) in enumerate(SHAPES):
        own = np.flatnonzero(chosen == selector)
        if len(own):
            value = np.full(len(own), selector << 60, _U)
            for k in range(count):
                value |= padded[starts[own] + k] << _U(k * width)
            words[place[own]] = value
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[place[escaped]] = _U(ESCAPE << 60)
    words[place[escaped] + 1] = ids[starts[escaped]]
    return MAGIC + struct.pack("<II", n, len(words)) + words.astype("<u8").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a block's payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, size = struct.unpack_from("<II", payload, 4)
    words = np.frombuffer(payload, "<u8", size, 12).astype(_U)
    selectors = (words >> _U(60)).astype(np.uint8)
    raw = np.zeros(size, bool)
    if (selectors == ESCAPE).any():  # a raw word follows an escape, whatever its upper bits say
        at = 0
        for at in np.flatnonzero(selectors == ESCAPE).tolist():
            if not raw[at]:
                raw[at + 1] = True
    counts = np.ones(16, np.int64)
    counts[:len(SHAPES)] = [c for c, _ in SHAPES]
    held = np.where(raw, 1, np.where(selectors == ESCAPE, 0, counts[selectors]))
    starts = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), _U)
    for selector, (count, width) in enumerate(SHAPES):
        own = np.flatnonzero((selectors == selector) & ~raw)
        mask = _U((1 << width) - 1)
        for k in range(count if len(own) else 0):
            out[starts[own] + k] = (words[own] >> _U(k * width)) & mask
    out[starts[raw]] = words[raw]
    return out[:n]


_WORD_START = re.compile(r"(?<=\S)(?= )")
_SPACES = re.compile(r"\s\s")
_STOPS = ".,"
LONGEST_KNOWN = 64


class Memory:
    """Ids of words in two generations of at most ``most`` words: the older one goes when the younger is full."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}
        self.passing: list[str] = []  # words of the texts at hand that are not worth keeping

    def missing(self, words: set[str]) -> set[str]:
        """Words in neither generation; those of the older one become young."""
        new = words.difference(self.young)
        if self.old:
            again = [w for w in new if w in self.old]
            self.young.update([(w, self.old[w]) for w in again])
            new.difference_update(again)
        return new

    def forget(self) -> None:
        """Drop the passing words, and the older generation if the younger is full."""
        for w in self.passing:
            self.young.pop(w, None)
        self.passing.clear()
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


class Encoder:
    """Encode texts with a tokenizers file, remembering the ids of words already met.

    A byte-level tokenizer never joins what stands before a space with the space after a visible
    character, so a text can be cut there and its parts encoded on their own.  A line feed between
    visible characters is a part of its own as well, so a text without neighbouring white space is cut
    into lines first.  A new word of letters alone goes straight to the model where the tokenizer is plainly of
    that kind.  At most twice ``known`` words are remembered, and those of the texts at hand.
    """

    def __init__(self, path: str, known: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Memory(known)  # words behind a space
        self.heads = Memory(known)  # words at the start of a line
        self.stops = dict(zip(_STOPS + "\n", self._ids([*_STOPS, "\n"])))
        self.letters = self._byte_letters()

    def _byte_letters(self) -> dict[int, str] | None:
        """How the tokenizer's model writes bytes, if a word of letters is one piece to it and nothing else touches it."""
        from tokenizers import models, pre_tokenizers

        cutter = self.tokenizer.pre_tokenizer
        plain = isinstance(cutter, pre_tokenizers.ByteLevel) and cutter.use_regex and not cutter.add_prefix_space
        added = any(t.content.strip().isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
        if not plain or added or self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.model, models.BPE):
            return None
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {ord(c): shown.pre_tokenize_str(c)[0][0] for c in map(chr, range(128))}
        # Bytes above 127 are met as the second byte of two: of U+0080 to U+00BF, and as the first of any longer code.
        for byte in range(0x80, 0xC0):
            letters[byte] = shown.pre_tokenize_str(chr(byte))[0][0][1]
        for byte in range(0xC2, 0xF5):
            code = bytes([byte]) + b"\xa0\x80\x80"[:1 if byte < 0xE0 else 2 if byte < 0xF0 else 3]
            code = b"\xf4\x80\x80\x80" if byte == 0xF4 else b"\xed\x80\x80" if byte == 0xED else code
            letters[byte] = shown.pre_tokenize_str(code.decode())[0][0][0]
        return letters

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words that stand alone or behind a space; those of letters alone go to the model itself."""
        if self.letters is None:
            return self._ids([before + w for w in words])
        tokens, letters, mark = self.tokenizer.model.tokenize, self.letters, "".join(self.letters[ord(c)] for c in before)
        found = {}
        for w in words:
            if w.isalpha():
                found[w] = array("I", [t.id for t in tokens(mark + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)))]).tobytes()
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self._ids([before + w for w in rest])))
        return [found[w] for w in words]

    def _learn(self, memory: Memory, words: set[str], before: str) -> None:
        """Remember words; those with a full stop or comma after a letter are put together from the bare word each time."""
        new, known = memory.missing(words), memory.young
        ended = [w for w in new if w[-1:] in _STOPS and w[-2:-1].isalpha()]
        bare = list(memory.missing(new.difference(ended).union([w[:-1] for w in ended])))
        known.update(zip(bare, self._word_ids(bare, before)))
        known.update([(w, known[w[:-1]] + self.stops[w[-1]]) for w in ended])
        memory.passing += ended
        memory.passing += [w for w in bare if len(w) > LONGEST_KNOWN]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        feed = self.stops["\n"]
        cut = []  # per text its lines, per line the first word and the words behind spaces
        for text in texts:
            if _SPACES.search(text):
                first, *rest = _WORD_START.split(text)
                cut.append([(first, [p[1:] for p in rest])])  # every later part starts with its space
            else:
                lines = [line.split(" ") for line in text.split("\n")]
                cut.append([(words.pop(0), words) for words in lines])
        words = set().union(*[rest for lines in cut for _, rest in lines])
        first = {w for lines in cut for w, _ in lines}
        self._learn(self.known, words, " ")
        self._learn(self.heads, first, "")
        get, head = self.known.young.__getitem__, self.heads.young
        out = [feed.join([head[w] + b"".join(map(get, rest)) for w, rest in lines]) for lines in cut]
        self.known.forget()
        self.heads.forget()
        return out


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One encoder per Python worker: its words stay known from task to task."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
                 path: str | None = None) -> DataFrame:
    """Encode every text, append ``end_id`` and write the blocks in ascending id order; returns the table read back.

    ``tokenizer`` is a file that every executor can open.  Null ids come first; rows of equal id follow
    each other, those with equal texts in any order.  Without a ``path`` the blocks go to the shared folder.
    """
    text_session(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(tokenizer), struct.pack("<I", end_id)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for batch in sliced(whole, "text", BLOCK_BYTES):
                encoded = [x + end for x in encoder.encode(batch.column(1).to_pylist())]
                counts = np.array([len(x) // 4 for x in encoded], np.int64)
                ids = np.frombuffer(b"".join(encoded), "<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                     pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.array(counts)),
                     pa.array([pack(ids)], pa.binary())],
                    names=["shard", "block", "before", "doc_ids", "counts", "payload"])
                block, before = block + 1, before + len(ids)

    blocks = ordered.mapInArrow(scan, f"shard int, block int, before long, doc_ids array<{kind}>, counts array<long>, payload binary")
    if path is None:
        return stored(blocks, "tokens")
    blocks.write.parquet(path)
    return docs.sparkSession.read.schema(blocks.schema).parquet(path)


def read_documents(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode written blocks: one row per document with its first place, ids (binary, 32 bits each) and their crc32."""
    sizes = blocks.groupBy("shard").agg(F.max(F.col("before") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    # One row per written file part, so this window is small whatever the number of documents.
    earlier = sizes.select("shard", F.coalesce(F.sum("ids").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    placed = blocks.join(stored(earlier, "token-shards"), "shard").select(
        (F.col("earlier") + F.col("before")).alias("start"), "doc_ids", "counts", "payload")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, names, counts, payload = (column[row] for column in batch.columns)
                counts = counts.values.to_numpy(zero_copy_only=False)
                ids = unpack(payload.as_py()).astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                texts = [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(starts + start.as_py()), pa.array(counts), pa.array(texts, pa.binary()),
                     pa.array([zlib.crc32(t) for t in texts], pa.int64())],
                    names=["id", "start", "n_tokens", "ids", "ids_crc32"])

    found = placed.mapInArrow(scan, f"id {kind}, start long, n_tokens long, ids binary, ids_crc32 long")
    return found.withColumnRenamed("id", id_col)


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all of ``docs`` and read them back: (id, ``start``, ``n_tokens``, ``ids``, ``ids_crc32``).

    Null and empty texts have the end id alone; repeated rows each get their place; an empty table gives
    an empty result; other columns are not looked at.
    """
    return read_documents(write_tokens(docs, tokenizer or default_tokenizer(), id_col, text_col, end_id), id_col)
