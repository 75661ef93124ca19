"""Token ids in patched frame-of-reference blocks.

Documents are tokenized in ascending order of their ids and their token ids
are written as one stream.  The stream is cut into segments, each a file: a
header, the documents in it, an index of block starts, and blocks of ``BLOCK``
ids.  A block stores its minimum and packs every id less that minimum in the
number of bits that a percentile of the block needs; ids that need more are
stored whole in the block's exception list.  Readers find a block by its index
entry and decode it alone.

Pieces are encoded once: if the tokenizer cuts texts as the byte-level pattern
does, a text is cut where that pattern's pre-tokens must end (before a space or
around a line end between two visible characters, and where ASCII letters,
digits and signs meet, but for letters after an apostrophe), so that the ids of
its pieces are the ids of the text.  Whole texts of any other tokenizer are its
pieces.  Cuts and hashes of pieces come from numpy over a slab of texts; only
pieces not seen before become strings and go to the tokenizer.  A hash only
finds a piece: the piece's bytes are compared with those that the ids belong
to, and pieces that differ are encoded by themselves.

Scale: one range shuffle by id; each task encodes and packs its own documents,
and writes segments of at most ``SEGMENT`` ids (or one longer document) as
files in the shared folder, under a name that a retry of the task takes again.
Only files that the table of finished tasks lists are read.  Starts come from
totals per segment, not from a pass over ids.

Defined results: a null text is an empty one and has the end id alone; rows
with equal ids follow one another, ordered by text; a null id comes first;
other columns are not read, whatever their names; an empty table writes no file
and gives an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, scratch_folder
from .language_id import slabs, text_buffer
from .shingles import range_hashes

MAGIC, BLOCK, SEGMENT, PERCENTILE = b"PFR2", 1024, 1 << 20, 0.97
HEADER = "<4sIIIQI"  # magic, part, number in the part, documents, ids, blocks
#: Distinct pieces a worker remembers; then it starts anew.
REMEMBERED = 1_000_000
#: Bytes of text encoded at once.
SLAB = 1 << 20


def pack_block(ids: np.ndarray) -> bytes:
    """One block: count, minimum, width, exceptions, packed ids."""
    low = int(ids.min())
    d = (ids - low).astype(np.uint32)
    cut = int(np.partition(d, int(PERCENTILE * (len(d) - 1)))[int(PERCENTILE * (len(d) - 1))])
    width = cut.bit_length()
    odd = np.flatnonzero(d >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    head = struct.pack("<HIBH", len(d), low, width, len(odd))
    patches = odd.astype("<u2").tobytes() + d[odd].astype("<u4").tobytes()
    if not width:
        return head + patches
    inside = d.copy()
    inside[odd] = 0
    size = 2 if width <= 16 else 4  # bytes that hold every packed value
    bits = np.unpackbits(inside.astype(f">u{size}").view(np.uint8).reshape(-1, size), axis=1)[:, 8 * size - width :]
    return head + patches + np.packbits(bits).tobytes()


def unpack_block(data: memoryview, at: int) -> np.ndarray:
    n, low, width, n_odd = struct.unpack_from("<HIBH", data, at)
    at += 9
    odd = np.frombuffer(data, "<u2", n_odd, at)
    values = np.frombuffer(data, "<u4", n_odd, at + 2 * n_odd)
    at += 6 * n_odd
    out = np.zeros(n, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-n * width // 8), at), count=n * width).reshape(n, width)
        size = 2 if width <= 16 else 4
        whole = np.zeros((n, 8 * size), np.uint8)
        whole[:, 8 * size - width :] = bits
        out = np.packbits(whole, axis=1).view(f">u{size}").ravel().astype(np.uint32)
    out[odd] = values
    return out + np.uint32(low)


def write_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, part: int = 0, nth: int = 0) -> bytes:
    """The bytes of a file of some documents' ids."""
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    head = struct.pack(HEADER, MAGIC, part, nth, len(doc_ids), len(ids), len(blocks)) + known.tobytes() + names.tobytes() + counts.astype("<u4").tobytes()
    first = len(head) + 8 * len(blocks)
    starts = first + np.concatenate([[0], np.cumsum([len(b) for b in blocks[:-1]])]) if blocks else np.zeros(0)
    return head + starts.astype("<u8").tobytes() + b"".join(blocks)


def read_segment(image: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """Part, number, document ids, counts and token ids of a file."""
    magic, part, nth, n_docs, n_ids, n_blocks = struct.unpack_from(HEADER, image, 0)
    if magic != MAGIC:
        raise ValueError("not a patched frame-of-reference file")
    at = struct.calcsize(HEADER)
    known = np.frombuffer(image, np.uint8, n_docs, at)
    names = np.frombuffer(image, "<i8", n_docs, at + n_docs)
    counts = np.frombuffer(image, "<u4", n_docs, at + 9 * n_docs)
    starts = np.frombuffer(image, "<u8", n_blocks, at + 13 * n_docs)
    view = memoryview(image)
    ids = [unpack_block(view, int(s)) for s in starts]
    return part, nth, [int(d) if k else None for d, k in zip(names, known)], counts, np.concatenate(ids) if ids else np.zeros(0, np.uint32)


#: Lead bytes of white space outside ASCII; next to them nothing is cut.
SPACE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a piece may begin at each byte: only where pre-tokens end."""
    visible = (data > 0x20) & (data < 0x7F)
    lead = data >= 0xC0
    good_lead = lead & ~np.isin(data, SPACE_LEADS)
    # a continuation byte belongs to the lead one to three bytes before it
    tail = np.zeros(len(data), bool)
    for back in (1, 2, 3):
        between = np.ones(len(data), bool)
        for k in range(1, back):
            between[k:] &= (data[:-k] & 0xC0) == 0x80
        tail[back:] |= good_lead[:-back] & between[back:]
    before = visible | ((data & 0xC0) == 0x80) & tail
    after = visible | good_lead
    out = np.zeros(len(data), bool)
    if len(data) > 2:
        gap = before[:-2] & after[2:]  # one byte between two visible characters
        line = (data[1:-1] == 0x0A) & gap
        out[1:-1] = (data[1:-1] == 0x20) & gap | line
        out[2:] |= line
    kind = KINDS[data]  # letters, digits and signs of ASCII; 0 for all else
    if len(data) > 1:
        meet = (kind[:-1] > 0) & (kind[1:] > 0) & (kind[:-1] != kind[1:])
        out[1:] |= meet & ~((data[:-1] == 0x27) & (kind[1:] == 1))
    return out


def _kinds() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        table[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
    return table


KINDS = _kinds()


def cut_by_pattern(path: str) -> bool:
    """Whether a tokenizer file cuts texts as ``cuts`` expects: byte level, by
    the pattern, with nothing before it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) for t in spec.get("added_tokens") or [])
    return (
        not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding") and plain
        and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        and model.get("type") == "BPE" and not model.get("dropout")
    )


class Encoder:
    """Whole texts to ids, encoding each distinct piece once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_pattern = cut_by_pattern(path)
        added = self.tok.get_added_tokens_decoder()
        self.whole = [t.content.encode() for t in added.values()]
        #: Between pieces that are encoded in one call; each then stands alone.
        self.mark = next(((t.content, i) for i, t in added.items()), None) if self.by_pattern else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        # per piece: its ids' place in flat and its bytes' place in text
        self.starts, self.sizes, self.text_at, self.long = (np.zeros(1 << 18, np.int64) for _ in range(4))
        self.flat, self.text = np.zeros(1 << 20, np.uint32), np.zeros(1 << 22, np.uint8)
        self.count = self.used = self.spelled = 0

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts encoded one by one, and how many each has."""
        each = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def _ids(self, texts: list[str], per_call: int = 50) -> tuple[np.ndarray, np.ndarray]:
        if not self.mark or not texts:
            return self._apart(texts)
        groups = [texts[i : i + per_call] for i in range(0, len(texts), per_call)]
        ids, sizes = [], []
        for group, e in zip(groups, self.tok.encode_batch_fast([self.mark[0].join(g) for g in groups], add_special_tokens=False)):
            got = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(got == self.mark[1])
            if len(cut) != len(group) - 1:  # a piece holds the mark itself
                got, many = self._apart(group)
            else:
                many = np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1
                got = np.delete(got, cut)
            ids.append(got)
            sizes.append(many)
        return np.concatenate(ids), np.concatenate(sizes)

    def _remember(self, pieces: list[bytes]) -> int:
        """Encode and keep pieces; the place of the first."""
        ids, sizes = self._ids([p.decode() for p in pieces])
        n, m = self.count, len(pieces)
        spelled = np.frombuffer(b"".join(pieces), np.uint8)
        self.flat, self.text = _room(self.flat, self.used + len(ids)), _room(self.text, self.spelled + len(spelled))
        self.starts, self.sizes, self.text_at, self.long = (_room(x, n + m) for x in (self.starts, self.sizes, self.text_at, self.long))
        self.flat[self.used : self.used + len(ids)] = ids
        self.text[self.spelled : self.spelled + len(spelled)] = spelled
        self.sizes[n : n + m], self.long[n : n + m] = sizes, [len(p) for p in pieces]
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.text_at[n : n + m] = self.spelled + np.cumsum(self.long[n : n + m]) - self.long[n : n + m]
        self.count, self.used, self.spelled = n + m, self.used + len(ids), self.spelled + len(spelled)
        return n

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one more than texts)."""
        import pandas as pd

        raw = data.tobytes()
        begin = cuts(data) if self.by_pattern else np.zeros(len(data), bool)
        for token in self.whole if self.by_pattern else []:  # which the tokenizer finds before it cuts
            found = raw.find(token)
            while found >= 0:
                begin[found + 1 : found + len(token)] = False
                found = raw.find(token, found + 1)
        begin[starts[:-1][np.diff(starts) > 0]] = True
        at = np.flatnonzero(begin)
        ends = np.append(at[1:], len(data))
        inverse, hashes = pd.factorize(range_hashes(data, at, ends))
        hashes = hashes.tolist()
        if self.count > REMEMBERED or self.used > 8 * REMEMBERED or self.spelled > 16 * REMEMBERED:
            self.forget()
        place = np.fromiter(map(self.place.get, hashes, repeat(-1)), np.int64, len(hashes))
        new = np.flatnonzero(place < 0)
        if len(new):
            first = np.zeros(len(hashes), np.int64)
            first[inverse[::-1]] = np.arange(len(at))[::-1]
            n = self._remember([raw[x:y] for x, y in zip(at[first[new]].tolist(), ends[first[new]].tolist())])
            place[new] = np.arange(n, n + len(new))
            self.place.update(zip([hashes[k] for k in new.tolist()], range(n, n + len(new))))
        place = place[inverse]
        odd = self._differ(data, at, ends, place)
        if len(odd):  # pieces whose hash belongs to other bytes
            n = self._remember([raw[at[k] : ends[k]] for k in odd])
            place[odd] = np.arange(n, n + len(odd))
        n = self.sizes[place]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.starts[place] - upto[:-1], n) + np.arange(upto[-1])] if len(n) else np.zeros(0, np.uint32)
        return ids, upto[np.searchsorted(at, starts)]

    def _differ(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Pieces whose bytes are not those kept at their places."""
        if not len(at):
            return at
        long = ends - at
        alike = self.long[place] == long
        shift = np.where(alike, self.text_at[place] - at, 0)
        kept = self.text[np.minimum(np.repeat(shift, long) + np.arange(at[0], len(data)), len(self.text) - 1)]
        return np.flatnonzero(~alike | np.logical_or.reduceat(kept != data[at[0] :], at - at[0]))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, or a copy with twice the room until ``n`` items fit."""
    size = len(x)
    while size < n:
        size *= 2
    return x if size == len(x) else np.concatenate([x, np.zeros(size - len(x), x.dtype)])


#: A worker's encoders; each lives as long as the worker.
_READY: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]


def _segments(path: str, end_id: int, folder: str):
    """Sorted (id, text) rows of a partition as files; a row for each."""

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ready, task = encoder(path), TaskContext.get()
        part, nth, end = task.partitionId(), 0, np.array([end_id], np.uint32).tobytes()
        files, root = fs.FileSystem.from_uri(folder)
        docs, streams, held = [], [], 0

        def flush():
            nonlocal nth, docs, streams, held
            counts = np.array([len(s) // 4 for s in streams], np.int64)
            image = write_segment(docs, counts, np.frombuffer(b"".join(streams), np.uint32), part, nth)
            name = f"{root}/{part:06d}-{nth:06d}"
            # whole files only: written under the attempt's name, then renamed
            with files.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
                out.write(image)
            files.move(f"{name}.{task.taskAttemptId()}", f"{name}.pfr")
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([held], pa.int64())], names=["part", "nth", "n_ids"])
            nth, docs, streams, held = nth + 1, [], [], 0
            return row

        for batch in batches:
            names = batch.column(0).to_pylist()
            data, offsets = text_buffer(batch, "text")
            for a, b in slabs(offsets, SLAB):
                ids, upto = ready.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw, upto = ids.tobytes(), upto.tolist()
                for k in range(b - a):
                    n = upto[k + 1] - upto[k] + 1
                    if held and held + n > SEGMENT:
                        yield flush()
                    docs.append(names[a + k])
                    streams.append(raw[4 * upto[k] : 4 * upto[k + 1]] + end)
                    held += n
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2, partitions: int | None = None) -> tuple[DataFrame, str]:
    """Tokenize ``docs`` in ascending order of id and write the files.  Returns
    the table of files (part, nth, n_ids) and the folder that holds them."""
    folder = scratch_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    rows = rows.sortWithinPartitions(*order)
    files = rows.mapInArrow(_segments(tokenizer, end_id, folder), "part int, nth int, n_ids long")
    return save(files, "token-files"), folder


def _documents(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for image in batch.column(0):
            part, nth, docs, counts, ids = read_segment(image.as_py())
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts.astype(np.int64))
            starts = ends - counts
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([nth] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts.astype(np.int64), pa.int64()), pa.array(crcs, pa.int64())],
                names=["part", "nth", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """One row per document of written files: doc_id, start, n_tokens, ids_crc32."""
    # a row per partition, then per segment of a partition: each a millionth of the ids
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", "nth", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("off")).join(parts, "part").select("part", "nth", (F.col("base") + F.col("off")).alias("base"))
    if files.isEmpty():
        return files.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    images = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(folder).select("content")
    docs = images.mapInArrow(_documents, "part int, nth int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(bases, ["part", "nth"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
